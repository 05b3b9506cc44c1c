"""Metric operators against plain computations and published confusion counts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalars import snapped
from plumbline.operators import curves, metrics as mt, robustness as rb
from plumbline.operators.prefix import describe, exact_quantiles, running_totals, seeded_rank, value_totals, with_even_bucket
from plumbline.plans import views as V
from plumbline.sources.reports import flatten_report

# Published counts (tp, tn, fp, fn) with the published F1, MCC and share of the clean F1 0.970176 retained.
PUBLISHED = [
    ((1749, 4222, 278, 2751), 0.535928, 0.391269, 0.552403), ((3570, 1708, 2792, 930), 0.657338, 0.189909, 0.677545),
    ((4407, 207, 4293, 93), 0.667727, 0.070564, 0.688254),
]


def test_rates_reproduce_published_table(spark):
    df = spark.createDataFrame([(i, *c) for i, (c, *_) in enumerate(PUBLISHED)], "condition int, tp bigint, tn bigint, fp bigint, fn bigint")
    m = mt.with_rates(df, ("f1", "mcc")).withColumn("model", F.lit("m"))
    clean = spark.createDataFrame([(-1, 1, 1, 1, 1, 0.970176, 0.0, "m")], m.schema)
    t = rb.against_clean(m.unionByName(clean), ["f1"], F.col("condition") == -1).select("*", rb.retention("f1")["f1_retention"].alias("kept"))
    got = {r.condition: r for r in t.collect()}
    for i, (_, f1, mcc, kept) in enumerate(PUBLISHED):
        assert abs(got[i].f1 - f1) < 1e-6 and abs(got[i].mcc - mcc) < 1e-6 and abs(got[i].kept - kept) < 1e-6


def test_undefined_and_single_class(spark):
    df = spark.createDataFrame([(5, 0, 0, 3), (0, 0, 0, 0)], "tp bigint, tn bigint, fp bigint, fn bigint")
    a = mt.with_rates(df).collect()
    assert a[0].balanced_accuracy == a[0].accuracy == 5 / 8 and a[0].mcc == 0.0 and a[1].accuracy == 0.0
    assert mt.with_rates(df, single_class="half").collect()[0].balanced_accuracy == 5 / 16
    assert mt.with_rates(df, undefined=None).collect()[0].specificity is None


def test_mcc_of_huge_counts_does_not_overflow(spark):
    n = 3_000_000_000_000
    r = mt.with_rates(spark.createDataFrame([(n, n, n // 10, n // 10)], "tp bigint, tn bigint, fp bigint, fn bigint"), ("mcc",)).first()
    assert abs(r.mcc - (1 - 0.01) / 1.21) < 1e-9


def scored(seed, n=400, digits=2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    return y, np.round(np.clip(0.3 * y + 0.7 * rng.random(n), 0, 1), digits)


def plain_roc(y, s):
    order = sorted(set(s), reverse=True)
    p, n = y.sum(), len(y) - y.sum()
    return [0.0] + [((s >= t) & (y == 0)).sum() / n for t in order], [0.0] + [((s >= t) & (y == 1)).sum() / p for t in order]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_curve_metrics(spark, seed):
    y, s = scored(seed)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    pts = curves.curve_points(curves.score_histogram(df, []), [])
    m = curves.curve_metrics(pts, []).first()
    fpr, tpr = map(np.array, plain_roc(y, s))
    assert abs(m.auroc - np.trapezoid(tpr, fpr)) < 1e-12
    assert abs(curves.auroc_rank_sum(pts, []).first().auroc - m.auroc) < 1e-12
    for x, v in ((0.01, m.tpr_at_fpr_1), (0.05, m.tpr_at_fpr_5), (0.10, m.tpr_at_fpr_10)):
        assert abs(v - np.interp(x, fpr, tpr)) < 1e-12
    i = int(np.argmin(np.abs(fpr - (1 - tpr))))
    assert abs(m.eer - (fpr[i] + 1 - tpr[i]) / 2) < 1e-12
    order = sorted(set(s), reverse=True)
    ap = sum((tpr[k + 1] - tpr[k]) * y[s >= t].mean() for k, t in enumerate(order))
    assert abs(m.average_precision - ap) < 1e-12


def test_one_class_auroc_is_half(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, score double")
    m = curves.ranking_metrics(df, []).first()
    assert m.auroc == 0.5


def test_bins_use_the_double_edges(spark):
    edges = np.linspace(0.0, 1.0, 11)
    values = sorted({float(e) for e in edges} | {i / 1000 for i in range(1001)} | {0.3, 0.6, 0.7})
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", mt.bin_index(F.col("v"), 10).alias("b")).collect()
    for r in got:
        want = next(i for i in range(10) if edges[i] <= r.v < edges[i + 1] or (i == 9 and r.v <= edges[10]))
        assert r.b == want, r.v


def test_calibration_error_matches_definition(spark):
    y, s = scored(7, digits=3)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    for on in ("probability", "confidence"):
        got = mt.calibration_error(mt.reliability_bins(df, [], bin_on=on), []).first()
        conf, right = np.maximum(s, 1 - s), ((s >= 0.5).astype(int) == y)
        v, edges = (s if on == "probability" else conf), np.linspace(0, 1, 11)
        ece, mce = 0.0, 0.0
        for i in range(10):
            k = (v >= edges[i]) & ((v <= edges[i + 1]) if i == 9 else (v < edges[i + 1]))
            if k.any():
                e = abs(right[k].mean() - conf[k].mean())
                ece, mce = ece + k.mean() * e, max(mce, e)
        assert abs(got.ece - ece) < 1e-9 and abs(got.mce - mce) < 1e-9


def test_verdict_rates_count_abstention_as_miss(spark):
    rows = [("REAL_ORIGINAL", "REAL_ORIGINAL")] * 6 + [("REAL_ORIGINAL", "UNCERTAIN")] * 2 + [("AI_GENERATED", "AI_GENERATED")] * 3 + [("AI_MANIPULATED", "nonsense")] * 1
    r = mt.verdict_rates(mt.verdict_confusion(spark.createDataFrame(rows, "truth string, verdict string"), [])).first()
    assert r.accuracy == 9 / 12 and r.uncertain_rate == 3 / 12
    assert r.recall_real_original == 6 / 8 and r.precision_real_original == 1.0 and r.recall_ai_manipulated == 0.0


def test_quantiles_and_description(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([np.round(rng.random(777), 4), np.full(400, 0.25)])
    df = spark.createDataFrame([("g", float(x)) for x in v] + [("g", None), ("h", 0.5)], "k string, v double")
    q = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"q25": 0.25, "q50": 0.5, "q975": 0.975}).collect()}
    for n, p in (("q25", 0.25), ("q50", 0.5), ("q975", 0.975)):
        assert abs(q["g"][n] - np.quantile(v, p)) < 1e-12 and q["h"][n] == 0.5
    d = {r.k: r for r in describe(df, ["k"], "v", {"median": 0.5}, {"half": 0.5}).collect()}["g"]
    assert d.n == len(v) and abs(d["mean"] - v.mean()) < 1e-12 and abs(d["std"] - v.std()) < 1e-9 and abs(d.half - 100 * (v >= 0.5).mean()) < 1e-9


def test_running_totals_in_buckets(spark):
    rng = np.random.default_rng(9)
    rows = [("a" if i % 3 else "b", float(x), int(c)) for i, (x, c) in enumerate(zip(np.unique(rng.random(500)), rng.integers(1, 9, 500)))]
    df = spark.createDataFrame(rows, "k string, x double, c int")
    for splits, desc in ((4, False), (1024, True)):
        got = {(r.k, r.x): (r.t, r.t_all) for r in running_totals(with_even_bucket(df, "x", splits), ["k"], ["x"], "_bucket", {"t": "c"}, desc).collect()}
        for k in "ab":
            mine = sorted([r for r in rows if r[0] == k], key=lambda r: r[1], reverse=desc)
            acc = 0
            for r in mine:
                acc += r[2]
                assert got[(k, r[1])] == (acc, sum(m[2] for m in mine))


def test_value_buckets_are_even_whatever_the_values(spark):
    rng = np.random.default_rng(4)
    crowded = 1 / (1 + np.exp(-rng.normal(14, 3, 20_000)))
    for values in (np.unique(crowded), 1e9 + np.arange(5000), np.unique(rng.integers(-2**62, 2**62, 5000)).astype(float), np.array([1.0, 1.0 + 1e-12])):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        sizes = [r["count"] for r in with_even_bucket(df, "v", 256).groupBy("_bucket").count().collect()]
        assert len(sizes) <= 257 and max(sizes) <= max(2, 3 * len(values) / 256)
    odd = spark.createDataFrame([(v,) for v in (None, float("-inf"), -1.0, 0.0, 3.0, float("inf"), float("nan"))], "v double").withColumn("c", F.lit(1))
    assert [r.t for r in value_totals(odd, [], "v", {"t": "c"}).orderBy(F.asc_nulls_first("v")).collect()] == [1, 2, 3, 4, 5, 6, 7]


def test_large_values_keep_their_spread(spark):
    df = spark.createDataFrame([("g", 1e9), ("g", 1e9 + 1), (None, 5.0), (None, 7.0)], "k string, v double")
    got = {r.k: (r["std"], r.m) for r in describe(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"g": (0.5, 1e9 + 0.5), None: (1.0, 6.0)}


def test_ranks_read_and_shuffle_rows_once(spark, tmp_path):
    spark.range(5000).selectExpr("id", "id % 7 as k").write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = seeded_rank(spark.read.parquet(str(tmp_path / "t")), ["k"], "id", "s")
        assert df.count() == 5000
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("FileScan parquet") == 1 and plan.count("REPARTITION_BY_COL") <= 2 and "ReusedExchange" in plan
    full = [x for x in plan.splitlines() if " Exchange " in x and "REPARTITION_BY_COL" in x and "ReusedExchange" not in x]
    assert len(full) == 1


def test_seeded_rank_is_a_permutation_and_ignores_partitioning(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") % 3 == 0).cast("int"))
    a = {r.id: (r["rank"], r.n_group) for r in seeded_rank(df, ["k"], "id", "s").collect()}
    b = {r.id: (r["rank"], r.n_group) for r in seeded_rank(df.repartition(7), ["k"], "id", "s").collect()}
    assert a == b
    for k in (0, 1):
        ids = [i for i in range(1000) if int(i % 3 == 0) == k]
        assert sorted(a[i][0] for i in ids) == list(range(1, len(ids) + 1)) and {a[i][1] for i in ids} == {len(ids)}


def test_report_flattening(spark):
    text = '{"models": {"m1": {"75": {"accuracy": 0.5, "f1": 0.4, "true_positive": 3, "total": 8}}, "m2": {"50": {"accuracy": 0.6}}}}'
    got = flatten_report(spark.createDataFrame([(text,)], "t string"), "t").orderBy("model").collect()
    assert [(r.model, r.condition, r.accuracy) for r in got] == [("m1", "75", 0.5), ("m2", "50", 0.6)] and got[0].total == 8


def test_risk_coverage_of_nothing(spark):
    df = spark.createDataFrame([(1, 0.55), (0, 0.52)], "y int, score double")
    got = {round(r.level, 2): r for r in mt.risk_coverage(df, []).collect()}
    assert got[0.95].covered == 0 and got[0.95].selective_accuracy == 1.0 and got[0.95].selective_risk == 0.0 and got[0.5].covered == 2


def test_condition_shifts_are_counted_as_the_rows_are(spark, sf):
    """Shifts of every condition are counted where the scores are made; the counts are those of the rows."""
    shift = snapped(F.col("score") - F.col("clean_score"), 9)
    want = {tuple(r) for r in V.cond(spark, sf).groupBy("condition", "gt", shift.alias("delta")).agg(F.count("*").alias("n")).collect()}
    counted = V.cond_shifts(spark, sf)
    assert {tuple(r) for r in counted.collect()} == want and len(want) > 10_000
    none = pa.RecordBatch.from_pydict({"gt": pa.array([None, 1], pa.int32()), "name": ["A:1", "A:2"], "score": [0.5, 0.0]})
    got = pa.Table.from_batches(V._shift_counts(iter([none, none])))
    assert sum(got["n"].to_pylist()) == 4 * len(V.CONDITIONS) and set(got["gt"].to_pylist()) == {None, 1}
