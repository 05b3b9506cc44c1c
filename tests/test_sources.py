"""Scans and sinks on temporary folders."""

import os
import re
import sys

import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_catalog import compare  # noqa: E402
from plumbline.functions.fingerprint import payload_kind, sha256_hex  # noqa: E402
from plumbline.plans.catalog import load  # noqa: E402
from plumbline.session import cut_lineage, ensure_checkpoint_dir  # noqa: E402
from plumbline.sources import scans, sinks  # noqa: E402


def test_asset_scan(spark, tmp_path):
    files = {"real/a.JPG": b"\xff\xd8\xff1", "real/deep/b.png": b"\x89PNG2", "fake/c.webp": b"RIFF0000WEBP", "fake/d.txt": b"no"}
    for name, data in files.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {(r.parent, r.file_name, r.extension, r.k) for r in scans.asset_files(spark, str(tmp_path), content=True).withColumn("k", payload_kind("content")).collect()}
    assert got == {("real", "a.JPG", "jpg", "jpg"), ("deep", "b.png", "png", "png"), ("fake", "c.webp", "webp", "webp")}
    plan = scans.asset_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_manifest_csv_and_json(spark, tmp_path):
    rows = [("1", "AI", "d", "s", "hi", "train", "ab", "parquet", "f:0", 12), ("2", "REAL", "d", 's,"x"', "lo", "test", "cd", "parquet", "f:1", None)]
    df = spark.createDataFrame(rows, scans.MANIFEST_SCHEMA)
    sinks.write_result(df, str(tmp_path / "csv"), "csv")
    sinks.write_result(df, str(tmp_path / "json"), "json")
    for fmt in ("csv", "json"):
        got = scans.read_manifest(spark, str(tmp_path / fmt), format=fmt).orderBy("sample_id").collect()
        assert [tuple(r) for r in got] == rows
    with pytest.raises(AnalysisException):
        sinks.write_result(df, str(tmp_path / "csv"), "csv")
    bad = tmp_path / "bad.csv"
    bad.write_text("sample_id,ground_truth,domain,source,resolution_type,split,sha256,storage_type,storage_ref,file_size_bytes\na,b,c,d,e,f,g,h,i,many\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        scans.read_manifest(spark, str(bad)).collect()


def test_prediction_schema_layout():
    assert scans.PREDICTION_SCHEMA.fieldNames()[:3] == ["candidate_id", "original_filename", "true_label"] and len(scans.PREDICTION_SCHEMA) == 13


def test_row_references(spark, tmp_path):
    spark.range(50).selectExpr("id", "id * 2 as v").repartition(3).write.parquet(str(tmp_path / "p"))
    source = scans.shards(spark, str(tmp_path / "p"))
    refs = source.where("id % 10 = 0").select(F.concat_ws(":", "shard", F.col("row_in_shard").cast("string")).alias("storage_ref"))
    got = scans.resolve_rows(refs.unionByName(spark.createDataFrame([("nope:3",)], "storage_ref string")), source).collect()
    assert sorted((r.id, r.v) for r in got) == [(i, 2 * i) for i in range(0, 50, 10)]


@pytest.mark.parametrize("name", ["scan_documents", "resolve_row_references"])
def test_table_of_several_files_is_one_shard(spark, sf, tmp_path, name):
    """Against the check SQL where the table is a folder of files whose rows are in no order."""
    spark.read.parquet(f"{sf}/documents.parquet").repartition(3, "lang", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    q = load()[name]
    problem, n = compare(q.run(spark, str(tmp_path)), con, q.sql)
    assert not problem and n > 50


def test_numbered_shard(spark):
    df = spark.createDataFrame([(5, "a"), (None, "z"), (-3, "b"), (2**60, "c")], "id bigint, v string").repartition(3)
    got = {r.v: (r.shard, r.row_in_shard) for r in scans.numbered_shard(df, "/x/t.parquet/", "id").collect()}
    assert got == {"b": ("t.parquet", 0), "a": ("t.parquet", 1), "c": ("t.parquet", 2), "z": ("t.parquet", 3)}


def test_label_conventions(spark):
    df = spark.createDataFrame([("x", 0), ("x", 1), ("y", 0), ("y", 7), ("z", 0)], "c string, raw int")
    got = [r[0] for r in df.select(scans.normalised_label("c", "raw", {"x": {0: "AI", 1: "REAL"}, "y": {0: "REAL"}})).collect()]
    assert got == ["AI", "REAL", "REAL", None, None]


def test_cached_table_is_built_once(spark, tmp_path):
    calls = []
    def build():
        calls.append(1)
        return spark.range(5)
    for _ in range(3):
        assert sinks.cached_table(spark, str(tmp_path / "idx"), build).count() == 5
    assert len(calls) == 1


def test_checkpoint_dir_of_the_session_is_kept(spark):
    first = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == first
    df = cut_lineage(spark.range(10).selectExpr("id * 2 as v"))
    # A table in that folder is read; nothing of what made it is left in the plan.
    assert all(first.split(":")[-1] in f for f in df.inputFiles()) and "Range" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 10


def test_pushdown_reaches_the_scan(spark, sf):
    q = scans.shards(spark, f"{sf}/documents.parquet").where("n_chars >= 1000").select("doc_id", sha256_hex("text"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n_chars,1000)" in plan and "lang" not in plan.split("ReadSchema")[-1]


def test_nested_report_and_percent(spark):
    df = spark.createDataFrame([("m2", "c1", 0.5), ("m1", "c2", 0.25), ("m1", "c1", 1.0)], "model string, cond string, f1 double")
    assert sinks.nested_report(df, "model", "cond", ["f1"]).first()[0] == '{"m1":{"c1":{"f1":1.0},"c2":{"f1":0.25}},"m2":{"c1":{"f1":0.5}}}'
    got = [r[0] for r in spark.createDataFrame([(0.00125,), (0.00375,)], "x double").select(sinks.percent("x")).collect()]
    assert got == [0.12, 0.38]


def test_a_report_has_a_bound_that_fails(spark, monkeypatch):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "o string, i string, v int")
    assert sinks.nested_report(df, "o", "i", ["v"]).first().report == '{"a":{"x":{"v":1},"y":{"v":2}},"b":{"x":{"v":3}}}'
    monkeypatch.setattr(sinks, "MAX_REPORT_ROWS", 2)
    with pytest.raises(Exception, match="more than 2 rows"):
        sinks.nested_report(df, "o", "i", ["v"]).collect()


def test_reference_index_follows_its_inputs(spark, tmp_path):
    from plumbline.sources.index import ReferenceIndex, key_bucket
    source, place = tmp_path / "ref", str(tmp_path / "index")
    spark.range(0, 100).repartition(2).write.parquet(str(source))
    built = []

    def rows(read):
        built.append(1)
        return read.select("file_id", (F.col("id") % 50).alias("key"), F.col("id").alias("member"))

    index = ReferenceIndex(spark, place, [str(source)], rows)
    assert index.refresh() == 2 and sorted(r.member for r in index.read().collect()) == list(range(100))
    written = sorted(str(p) for p in (tmp_path / "index").rglob("*"))
    assert index.refresh() == 0 and len(built) == 1  # a second call writes nothing
    assert sorted(str(p) for p in (tmp_path / "index").rglob("*")) == written
    spark.range(100, 110).coalesce(1).write.mode("append").parquet(str(source))
    assert index.refresh() == 1 and index.read().count() == 110  # only the new file is read
    gone = next(p for p in source.glob("part-*.parquet") if spark.read.parquet(str(p)).agg(F.max("id")).first()[0] < 100)
    lost = spark.read.parquet(str(gone)).count()
    gone.unlink()
    assert index.refresh() == 0 and index.read().count() == 110 - lost
    spark.range(500, 503).coalesce(1).write.mode("append").parquet(f"{place}/keys/batch=unfinished/bucket=1")  # left behind by a lost job
    cands = spark.createDataFrame([(7, "a"), (7, "b"), (999, "c"), (None, "d")], "k long, name string")
    found = index.search(cands, "k")
    want = [m for m in (r.member for r in index.read().collect()) if m % 50 == 7]
    assert sorted((r.name, r.member) for r in found.collect()) == sorted((n, m) for n in "ab" for m in want)
    buckets = {r[0] for r in spark.createDataFrame([(7,), (999,)], "k long").select(key_bucket(F.col("k"))).collect()}
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = index.search(cands, "k")._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"bucket#\d+ IN \(([\d,]+)\)", plan.split("PartitionFilters: ", 1)[1].split("PushedFilters")[0])
    assert read and set(read[0].split(",")) == {str(b) for b in buckets}  # no other folder is read
