"""Reading: Parquet shards with row provenance, asset files, manifests with fixed schemas, label conventions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import col
from plumbline.operators.prefix import SPLITS, running_totals, with_even_bucket
from plumbline.session import cut_lineage

# Asset extensions kept by a directory scan.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp")

MANIFEST_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in (
    "sample_id", "ground_truth", "domain", "source", "resolution_type", "split", "sha256", "storage_type", "storage_ref")]
    + [T.StructField("file_size_bytes", T.LongType())])

PREDICTION_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("candidate_id", "original_filename", "true_label", "category", "source", "generator", "model")]
    + [T.StructField(n, T.DoubleType()) for n in (
        "raw_ai_probability", "raw_real_probability", "calibrated_ai_probability", "calibrated_real_probability")]
    + [T.StructField("prediction", T.StringType()), T.StructField("correct", T.BooleanType())])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shards(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Parquet shards with the place of every row: ``shard`` (the file's path below the common root of the paths; its name where one file is read),
    ``file_name`` (for display: names may repeat) and ``row_in_shard``."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    bare = [p.split("://", 1)[-1].rstrip("/") for p in paths]
    common = bare[0].split("/")
    for p in bare[1:]:
        common = [a for a, b in zip(common, p.split("/")) if a == b] if common != p.split("/") else common
    tail = len("/".join(common)) if len(bare) > 1 else len(bare[0])
    root = bare[0][:tail]
    full, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    below = F.substring_index(full, root + "/", -1)
    return df.select("*", F.when(F.contains(full, F.lit(root + "/")), below).otherwise(name).alias("shard"), name.alias("file_name"), F.col("_metadata.row_index").alias("row_in_shard"))


def as_one_shard(df: DataFrame, path: str) -> DataFrame:
    """The rows of a table with ``shard``, its own name, whatever number of files holds it."""
    return df.select("*", F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("shard"))


def numbered_shard(df: DataFrame, path: str, key: str) -> DataFrame:
    """``as_one_shard`` with ``row_in_shard``: the row's place, from 0, in the order of the numeric column ``key`` over the whole table, NULL last."""
    rows = as_one_shard(df, path).withColumns({"_one": F.lit(1).cast("bigint"), "_none": F.col(key).isNull()})
    placed = with_even_bucket(cut_lineage(rows), key)
    last = F.when(F.col("_none"), F.lit(SPLITS + 1).cast("bigint")).otherwise(F.col("_bucket"))
    return running_totals(placed, [], ["_none", key], last, {"_place": "_one"}).select(*df.columns, "shard", (F.col("_place") - 1).alias("row_in_shard"))


def asset_files(spark: SparkSession, folder: str, extensions: Sequence[str] = IMAGE_EXTENSIONS, content: bool = False) -> DataFrame:
    """Files below a folder by extension (any case), the class being the parent folder's name. The bytes are
    read only when ``content`` is asked for."""
    glob = "*.{" + ",".join(sorted({v for e in extensions for v in (e.lower(), e.upper())})) + "}"
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder))
    cols = ["path", "length"] + (["content"] if content else [])
    return df.select(
        *cols, F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("parent"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"))


def read_manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST_SCHEMA, format: str = "csv") -> DataFrame:
    """A CSV or JSON manifest with its schema stated; malformed rows fail the read."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("header", "true").csv(path) if format == "csv" else reader.json(path)


def resolve_rows(manifest: DataFrame, source: DataFrame, reference: str = "storage_ref") -> DataFrame:
    """Join ``file:row`` references to the rows they name: one join for the whole manifest.

    ``source`` comes from ``shards``. References that name no row are dropped.
    """
    if "file_name" in manifest.columns:
        manifest = manifest.drop("file_name")
    ref = manifest.withColumn("shard", F.regexp_extract(reference, r"^(.*):[0-9]+$", 1)) \
                  .withColumn("row_in_shard", F.regexp_extract(reference, r":([0-9]+)$", 1).cast("bigint"))
    return ref.join(source, ["shard", "row_in_shard"], "inner")


def prioritised_union(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union of same-shaped sources with their name and priority (0 first)."""
    parts = [df.withColumn("origin", F.lit(n)).withColumn("source_priority", F.lit(i)) for i, (n, df) in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def normalised_label(convention: str | Column, raw: str | Column, conventions: Mapping[str, Mapping[int, str]]) -> Column:
    """REAL or AI from a source's own label code; NULL for a code the source does not define."""
    entries = [x for c, codes in conventions.items() for code, label in codes.items() for x in (F.lit(f"{c}:{code}"), F.lit(label))]
    return F.try_element_at(F.create_map(*entries), F.concat_ws(":", col(convention), col(raw).cast("string")))


def source_profile(df: DataFrame, source: str, label: str | Column, generator: str | Column) -> DataFrame:
    """Rows, real and AI rows, and distinct generators per source."""
    return df.groupBy(source).agg(
        F.count("*").alias("n_total"), F.count_if(col(label) == "REAL").alias("n_real"), F.count_if(col(label) == "AI").alias("n_ai"),
        F.count_distinct(col(generator)).alias("n_generators"))
