"""Resampling, paired tests and fits against plain computations."""

import math
from hashlib import md5
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions.digest import md5_heads, message_words, text_bytes
from plumbline.functions.scalars import chi2_1df_p, normal_tail, sigmoid, softplus
from plumbline.operators import calibration as cal, fusion as fu, stats as st
from plumbline.sources.scoring import linear_scorer, score_batches


def test_normal_tail_and_chi2(spark):
    zs = [0.0, 0.3, 1.0, 1.96, -2.5, 5.0, 7.0, 7.1, 9.0, 20.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_tail("z").alias("p"), chi2_1df_p(F.col("z") * F.col("z")).alias("c")).collect()
    for r in got:
        want = 0.5 * math.erfc(abs(r.z) / math.sqrt(2))
        assert abs(r.p - want) <= 1e-12 + 1e-6 * want and abs(r.c - min(1, 2 * want)) <= 1e-9


def test_sigmoid_and_softplus_do_not_overflow(spark):
    r = spark.createDataFrame([(-800.0,), (800.0,), (0.0,)], "x double").select(sigmoid("x").alias("s"), softplus("x").alias("l")).collect()
    assert [x.s for x in r] == [0.0, 1.0, 0.5] and r[1].l == 800.0 and r[0].l == 0.0


def plain_signed_rank(d):
    d = np.array([x for x in d if x != 0])
    a = np.abs(d)
    ranks = np.array([(a < x).sum() + ((a == x).sum() + 1) / 2 for x in a])
    return len(d), ranks[d > 0].sum(), ranks[d < 0].sum()


def test_signed_rank_with_ties_and_zeros(spark):
    rng = np.random.default_rng(1)
    d = np.round(rng.normal(0.02, 0.1, 300), 2)
    r = st.signed_rank(spark.createDataFrame([(float(x),) for x in d], "d double"), [], "d").first()
    n, wp, wm = plain_signed_rank(d)
    assert (r.n, r.w_plus, r.w_minus) == (n, wp, wm) and r.has_ties
    _, t = np.unique(np.abs(d[d != 0]), return_counts=True)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (t ** 3 - t).sum() / 48)
    assert abs(r.p_value - math.erfc(abs((wp - n * (n + 1) / 4) / sd) / math.sqrt(2))) < 1e-9


def by_enumeration(d):
    """Exact two-sided p over all sign patterns, with mid-ranks."""
    n, wp, wm = plain_signed_rank(np.array(d))
    a = np.abs(np.array([x for x in d if x]))
    ranks = [(a < x).sum() + ((a == x).sum() + 1) / 2 for x in a]
    ways = sum(1 for s in product([0, 1], repeat=n) if sum(r for r, x in zip(ranks, s) if x) <= min(wp, wm))
    return min(1.0, 2 * ways / 2 ** n)


def test_signed_rank_exact(spark):
    groups = {"plain": [0.5, -0.1, 0.9, 1.3, 0.25, -0.35, 0.8], "ties": [0.5, 0.5, -0.5, 0.2, 0.2, -0.1, 0.9, 0.0, 0.9], "two": [0.5, 0.5], "all": [0.3] * 9 + [-0.3] * 2}
    rows = [(k, x) for k, d in groups.items() for x in d]
    tested = st.signed_rank(spark.createDataFrame(rows, "k string, d double"), ["k"], "d", cells=True)
    got = {r.k: r for r in st.with_p_method(tested, "exact").collect()}
    for k, d in groups.items():
        assert got[k].p_method == "exact" and got[k].p_error == 0 and abs(got[k].p_value - by_enumeration(d)) < 1e-12
    normal = st.with_p_method(st.signed_rank(spark.createDataFrame(rows, "k string, d double"), ["k"], "d"), "normal")
    assert {r.p_method for r in normal.collect()} == {"normal"} and "rank_cells" not in normal.columns


def test_rank_cells_are_plain_numbers(spark):
    """The exact test's Python gets arrays of numbers, no object for each cell; ranks and ties of the largest group fit."""
    rows = [(0, float(i // 2)) for i in range(2, 1002)] + [(1, 1.0)] * 1000
    t = st.signed_rank(spark.createDataFrame(rows, "k int, d double"), ["k"], "d", cells=True)
    assert t.schema["rank_cells"].dataType.simpleString() == "array<int>"
    cells = {r.k: [divmod(c, st.CELL_BASE) for c in r.rank_cells] for r in t.collect()}
    assert cells == {0: [(4 * i + 3, 2) for i in range(500)], 1: [(1001, 1000)]}
    assert {r.k: r.p_value for r in st.with_p_method(t, "exact").collect()} == pytest.approx({0: 2.0 ** -999, 1: 2.0 ** -999}, rel=1e-9, abs=0)


def test_signed_rank_of_any_size_has_a_p_value(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(x)) for k, n, shift, digits in (("a", 300, .1, 6), ("b", 900, .08, 1), ("c", 1100, .05, 3)) for x in np.round(rng.normal(shift, 1, n), digits)]
    tested = st.signed_rank(spark.createDataFrame(rows, "k string, d double"), ["k"], "d", cells=True)
    mixed = {r.k: r for r in st.with_p_method(tested, "exact_or_series").collect()}
    assert {k: r.p_method for k, r in mixed.items()} == {"a": "exact", "b": "exact", "c": "series"}
    assert all(0 < r.p_value <= 1 and r.p_error < 1e-4 for r in mixed.values())
    series = {r.k: r for r in st.with_p_method(tested, "series").collect()}
    for k in "ab":  # ties are the reason for the wider margin: the steps of b are no longer alike
        assert abs(series[k].p_value - mixed[k].p_value) < (2e-6 if k == "a" else 1e-3)
    with pytest.raises(Exception, match="more than 1000 pairs"):
        st.with_p_method(tested, "exact").collect()
    tested = st.signed_rank(spark.createDataFrame(rows[:7], "k string, d double"), ["k"], "d", cells=True)
    with pytest.raises(ValueError):
        st.with_p_method(tested, "whichever fits")


def test_mcnemar(spark):
    m = st.mcnemar(F.col("b"), F.col("c"))
    r = spark.createDataFrame([(10, 3), (0, 0)], "b int, c int").select(*[v.alias(k) for k, v in m.items()]).collect()
    assert abs(r[0].statistic - 36 / 13) < 1e-12 and abs(r[0].p_value - math.erfc(math.sqrt(36 / 13 / 2))) < 1e-9
    assert (r[1].statistic, r[1].p_value) == (0.0, 1.0)


def test_holm_stops_at_the_first_failure(spark):
    df = spark.createDataFrame([("a", 0.001), ("b", 0.03), ("c", 0.02), ("d", 0.045)], "t string, p_value double")
    step = {r.t: r.holm_significant for r in st.correct_multiple(df).collect()}
    row = {r.t: r.holm_significant for r in st.correct_multiple(df, mode="per_row").collect()}
    assert step == {"a": True, "b": False, "c": False, "d": False} and row == {"a": True, "b": False, "c": False, "d": True}
    assert {r.t for r in st.correct_multiple(df).where("bonferroni_significant").collect()} == {"a"}


def wide(spark, n=3000):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, n)
    rows = [(i, int(v), int(v if rng.random() < 0.8 else 1 - v), int(v if rng.random() < 0.7 else 1 - v)) for i, v in enumerate(y)]
    return rows, spark.createDataFrame(rows, "sample_id int, y int, pred_A int, pred_B int")


@pytest.mark.parametrize("mode", ["poisson", "multinomial"])
def test_bootstrap_agrees_with_theory(spark, mode):
    rows, df = wide(spark)
    cells = st.bootstrap_cells(df, "y", ["pred_A", "pred_B"], 300, "s", mode)
    totals = cells.groupBy("replicate").agg(F.sum("n").alias("n")).collect()
    assert len(totals) == 300
    if mode == "multinomial":
        assert {r.n for r in totals} == {3000}
    rep = st.replicate_metrics(cells, "y", {"A": "pred_A", "B": "pred_B"}, ["accuracy"]).withColumnRenamed("accuracy", "value").withColumn("metric", F.lit("accuracy"))
    got = {r.model: r for r in st.interval(rep, ["model"]).collect()}
    for k, i in (("A", 2), ("B", 3)):
        acc = np.mean([r[i] == r[1] for r in rows])
        se = math.sqrt(acc * (1 - acc) / 3000)
        assert abs(got[k].boot_mean - acc) < 4 * se / math.sqrt(300) + 1e-3 and 0.8 * se < got[k].std_error < 1.2 * se
        assert got[k].ci_low < acc < got[k].ci_high
    pair = st.paired_interval(rep, [("A", "B")], 300).first()
    assert pair.significant and pair.p_value == pytest.approx(1 / 300)


def test_drawn_counts_are_poisson(spark):
    """Mean, variance, skew and both ends of draws, by one rule for small and large means."""
    draws, at = 40_000, (1, 8, 16, 100, 1_000_000)
    cells = spark.createDataFrame([(n, n) for n in at], "k int, n long")
    rows = st.poisson_cells(cells, ["k"], draws, "s").select("k", "n").toPandas()
    for n in at:
        x = np.zeros(draws)
        got = rows[rows.k == n].n.to_numpy()
        x[: got.size] = got
        d = (x - n) / math.sqrt(n)
        assert abs(d.mean()) < 5 / math.sqrt(draws) and abs(d.var() - 1) < 5 * math.sqrt((2 + 1 / n) / draws)
        assert abs((d ** 3).mean() - 1 / math.sqrt(n)) < 5 * math.sqrt((15 + 40 / n) / draws)
        for q, share in ((n - 1.96 * math.sqrt(n), None), (n + 1.96 * math.sqrt(n), None)):
            true = poisson_below(n, math.floor(q))
            assert abs((x <= math.floor(q)).mean() - true) < 5 * math.sqrt(max(true * (1 - true), 1e-4) / draws)
    scores = spark.createDataFrame([("m", i % 2, round(i / 40, 3)) for i in range(40)] * 3, "model string, y int, score double")
    hist = st.bootstrap_scores(scores, ["model"], "y", "score", 500, "s")
    assert abs(hist.agg(F.sum(F.col("pos") + F.col("neg"))).first()[0] / 500 - 120) < 3


def poisson_below(n, q):
    """P(X <= q) of the Poisson distribution of mean n."""
    return 0.0 if q < 0 else math.fsum(math.exp(k * math.log(n) - n - math.lgamma(k + 1)) for k in range(max(0, int(n - 40 * math.sqrt(n))), q + 1))


def test_poisson_table_is_the_distribution(spark):
    means = spark.createDataFrame([(n,) for n in (1, 2, 16, 500, 250_000)], "n long")
    rows = st.poisson_table(means).select("n", "k", "low", "high").distinct().toPandas()
    for n, t in rows.groupby("n"):
        t = t.sort_values("k")
        low, high = t.low.to_numpy(), t.high.to_numpy()
        assert low[0] == 0 and high[-1] == 1 and (low[1:] == high[:-1]).all()
        width = np.array([math.exp(k * math.log(n) - n - math.lgamma(k + 1)) for k in t.k])
        assert np.abs((high - low) - width).max() < 1e-11


def test_binomial_draws(spark):
    """Shares of every outcome of a small case, and moments of large and lopsided ones."""
    cases = [(5, 0.3), (40, 0.9), (1000, 0.001), (10**6, 0.25), (10**10, 0.5)]
    draws = 20_000
    df = spark.range(draws).select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).cast("bigint").alias("n"), F.lit(p).alias("p")) for i, (n, p) in enumerate(cases)])).alias("c")).select("id", "c.*")
    rows = df.select("i", st.binomial_draw(F.col("n"), F.col("p"), F.lit(1.0) - F.col("p"), [F.lit("t"), F.col("id"), F.col("i")]).alias("k")).toPandas()
    for i, (n, p) in enumerate(cases):
        k = rows[rows.i == i].k.to_numpy()
        assert k.size == draws and k.min() >= 0 and k.max() <= n
        sd = math.sqrt(n * p * (1 - p))
        d = (k - n * p) / sd
        assert abs(d.mean()) < 5 / math.sqrt(draws) and abs(d.var() - 1) < 0.06 and abs((d ** 3).mean() - (1 - 2 * p) / sd) < 0.15 + 0.4 * abs(1 - 2 * p) / sd
        if n <= 40:
            for j in range(n + 1):
                true = math.comb(n, j) * p ** j * (1 - p) ** (n - j)
                assert abs((k == j).mean() - true) < 5 * math.sqrt(max(true * (1 - true), 1e-5) / draws)
    edge = spark.range(3).select(*[st.binomial_draw(F.lit(n).cast("bigint"), F.lit(p), F.lit(q), [F.col("id")]).alias(f"c{i}") for i, (n, p, q) in enumerate([(0, .5, .5), (7, 1.0, 0.0), (7, 0.0, 1.0)])]).first()
    assert tuple(edge) == (0, 7, 0)


def test_multinomial_of_many_cells(spark):
    """Cells of scores: counts of each replicate add up, and those of a cell vary as they should."""
    cells = spark.range(700).select(F.col("id").alias("score"), (F.col("id") % 5 + 1).alias("n"))
    drawn = st.multinomial_replicates(cells, ["score"], 400, "s")
    total = 700 * 3
    per = drawn.groupBy("replicate").agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()
    assert len(per) == 400 and {r.n for r in per} == {total} and max(r.c for r in per) < 700
    got = drawn.groupBy("score").agg((F.sum("n") / 400).alias("m"), (F.sum(F.col("n") * F.col("n")) / 400).alias("s")).toPandas().set_index("score")
    z = [(got.m.get(i, 0) - (i % 5 + 1)) / math.sqrt((i % 5 + 1) / 400) for i in range(700)]
    assert abs(np.mean(z)) < .2 and 0.85 < np.std(z) < 1.15 and max(map(abs, z)) < 5
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "collect_list" not in plan
    assert st.multinomial_replicates(cells.limit(0), ["score"], 4, "s").count() == 0


def test_joint_curves_are_those_of_the_drawn_cells(spark, monkeypatch):
    """Counted where they are drawn, in tiles: no row for each cell and replicate is made, and the histograms are those of such rows."""
    rows = [(i % 2, (i * 7 % 13) / 13 if i % 11 else None, (i * 5 % 9) / 9) for i in range(300)] + [(1, .5, .25)] * 400 + [(None, .5, .5)]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    cells = df.groupBy("y", "a", "b").agg(F.count("*").alias("n"))
    want = st.model_histograms(st.poisson_cells(cells, ["y", "a", "b"], 12, "s"), "y", {"A": "a", "B": "b"}).where("pos + neg > 0")
    want = {tuple(r) for r in want.collect()}
    for lot in (2**18, 40):
        monkeypatch.setattr(st, "LOT", lot)
        got = st.bootstrap_joint_curves(df, "y", {"A": "a", "B": "b"}, 12, "s")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "md5" not in plan
        assert {tuple(r) for r in got.collect()} == want
    assert st.bootstrap_joint_curves(df.limit(0), "y", {"A": "a", "B": "b"}, 12, "s").count() == 0


def test_digests_of_many_texts():
    """Texts and leads of every length around the ends of words and blocks, against hashlib."""
    rng = np.random.default_rng(5)
    texts = ["", *("".join(map(chr, rng.integers(32, 127, int(n)))) for n in rng.integers(0, 150, 300)), "0.\u00e9\u4e2d"]
    laid, sizes = text_bytes(pa.array(["left out", *texts])[1:])
    for lead in (0, 1, 4, 9, 55, 56, 63, 64, 130):
        leads = [rng.integers(0, 256, lead).astype("u1").tobytes() for _ in range(3)]
        got = md5_heads(leads, *message_words(laid, sizes, lead))
        assert got.tolist() == [[int.from_bytes(md5(a + t.encode()).digest()[:4]) for t in texts] for a in leads]


@pytest.mark.parametrize("mean", [1, 3, 400, 10**6])
def test_counts_from_the_head_of_a_draw(mean):
    """The first 32 bits decide the count, but where a bound lies among the draws that begin with them: these are asked for."""
    first, high = st.poisson_bounds(mean)
    rng = np.random.default_rng(mean)
    edges = (np.unique(high[high < 1]) * 2.0**52).astype("int64")
    u = np.concatenate([rng.integers(0, 2**52, 6000), *(np.clip(edges + d, 0, 2**52 - 1) for d in (-2**21, -1, 0, 1, 2**21))])
    want = first + np.searchsorted(high, u / 2.0**52, side="right")
    for some in (slice(None), slice(5900, None)):
        asked = []
        got = st.poisson_counts((u[some] >> 20).astype("u4"), mean, lambda i: asked.append(i) or u[some][i] / 2.0**52)
        assert (got == want[some]).all() and 0 < len(asked) <= 5 * len(edges) + 10


def test_draws_of_joint_cells_are_hashed_together(monkeypatch):
    """A tile of 4,000 cells and 60 replicates: histograms as of single digests, of which next to none is made."""
    rng = np.random.default_rng(2)
    a, y, n = rng.integers(0, 50, 4000) / 50, rng.integers(0, 2, 4000), np.where(rng.random(4000) < .1, rng.integers(2, 40, 4000), 1)
    names = [f"{c}:{x}:{i}" for i, (c, x) in enumerate(zip(y, a))]
    cells = pa.RecordBatch.from_arrays([pa.array(names), pa.array(n), pa.array(y.astype("int32")), pa.array(a)], names=["name", "n", "y", "s0"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, cells.schema) as stream:
        stream.write_batch(cells)
    tile = pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([sink.getvalue().to_pybytes()])], names=["block", "cells"])
    asked = []
    monkeypatch.setattr(st, "md5", lambda x: asked.append(x) or md5(x))
    got = {(r["replicate"], r["score"]): (r["neg"], r["pos"]) for batch in st._tile_histograms(["A"], "s", 120, 2)(iter([tile])) for r in batch.to_pylist()}
    assert len(asked) < 5
    want = {}
    for replicate in range(60, 120):
        for name, c, x, mean in zip(names, y, a, n.tolist()):
            first, high = st.poisson_bounds(mean)
            k = first + int(np.searchsorted(high, (int(md5(f"s:{replicate}:{name}".encode()).hexdigest()[:13], 16)) / 2.0**52, side="right"))
            want.setdefault((replicate, x), [0, 0])[c] += k
    assert got == {k: tuple(v) for k, v in want.items() if any(v)}


def test_paired_bootstrap_puts_samples_together_once(spark, sf, monkeypatch):
    """Patterns, joint cells and whole histograms come from one staged table of samples."""
    from plumbline.plans import statistics as ps
    made = []
    monkeypatch.setattr(ps, "REPLICATES", 3)
    monkeypatch.setattr(ps, "wide", lambda *x, real=ps.wide: made.append(x) or real(*x))
    assert ps.paired_bootstrap(spark, sf).count() == 48 and len(made) == 1


@pytest.mark.parametrize("mean", [1, 7, 50, 3000, 10**7])
def test_poisson_bounds_are_those_of_the_table(spark, mean):
    first, high = st.poisson_bounds(mean)
    table = st.poisson_table(spark.createDataFrame([(mean,)], "n bigint")).select("k", "high").distinct().collect()
    assert all(abs(high[r.k - first] - r.high) < 1e-11 for r in table) and high[-1] == 1.0


def test_bootstrap_is_repeatable_under_repartitioning(spark):
    _, df = wide(spark, 500)
    for mode in ("poisson", "multinomial"):
        a, b = ({tuple(r) for r in st.bootstrap_cells(x, "y", ["pred_A", "pred_B"], 8, "s", mode).collect()} for x in (df, df.repartition(5)))
        assert a == b


def logits(spark, a=0.5, b=0.3, n=4000, seed=3):
    rng = np.random.default_rng(seed)
    s = np.round(rng.normal(0, 3, n), 2)
    y = (rng.random(n) < 1 / (1 + np.exp(-(a * s + b)))).astype(int)
    return s, y, spark.createDataFrame([(float(x), int(v)) for x, v in zip(s, y)], "s double, y int")


def nll(s, y, a, b):
    z = a * s + b
    return np.mean(np.logaddexp(0, z) - y * z)


def test_temperature_fit(spark):
    s, y, df = logits(spark, b=0.0)
    c = cal.fit_temperature(df)
    best = min(np.linspace(0.5, 5, 4501), key=lambda t: nll(s, y, 1 / t, 0))
    assert abs(c.T - best) < 2e-3
    always = spark.createDataFrame([(1.0, 1), (2.0, 1), (-1.0, 0)], "s double, y int")
    assert cal.fit_temperature(always).T < 0.1      # separable: towards the bound, until the loss is flat
    wrong = spark.createDataFrame([(1.0, 0), (-2.0, 1)], "s double, y int")
    assert cal.fit_temperature(wrong).T == pytest.approx(10.0)


def test_platt_fit(spark):
    s, y, df = logits(spark)
    c = cal.fit_platt(df)
    obj = lambda a, b: nll(s, y, a, b) + 1e-5 * (a * a + b * b)
    here = obj(c.A, c.B)
    assert all(obj(c.A + da, c.B + db) >= here - 1e-12 for da, db in product((-1e-3, 0, 1e-3), repeat=2))
    flipped = spark.createDataFrame([(float(x), int(1 - v)) for x, v in zip(s, y)], "s double, y int")
    assert cal.fit_platt(flipped).A == pytest.approx(1e-4)


def test_apply_calibration(spark):
    df = spark.createDataFrame([(0.9,), (0.0,), (1.0,)], "p double")
    t = [r[0] for r in df.select(cal.apply_calibration("p", cal.Calibration("temperature", T=2.0))).collect()]
    assert abs(t[0] - 1 / (1 + math.exp(-math.log(9) / 2))) < 1e-12 and 0 < t[1] < t[2] < 1
    assert [r[0] for r in df.select(cal.apply_calibration("p", None)).collect()] == [0.9, 0.0, 1.0]
    with pytest.raises(ValueError):
        cal.apply_calibration("p", cal.Calibration("isotonic"))


def test_fusion_training_recovers_a_model(spark):
    rng = np.random.default_rng(4)
    w, b = np.array([[-2.0, -3.0], [4.0, -2.0], [-2.0, 5.0]]), np.array([2.0, -1.0, -1.0])
    x = rng.random((6000, 2))
    z = x @ w.T + b
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = [rng.choice(3, p=q) for q in p]
    from plumbline.operators.rules import LABELS
    df = spark.createDataFrame([(LABELS[k], float(a), float(c)) for k, (a, c) in zip(y, x)], "truth string, p_generated double, p_manipulated double")
    m = cal.fit_fusion(df, "truth")
    assert np.abs(np.array(m.weights) - w).max() < 0.6 and abs(sum(m.biases)) < 1e-9


def test_fusion_rules(spark):
    df = spark.createDataFrame([(0.1, 0.9, 0.4, 0.6)], "p_a double, p_b double, p_c double, p_d double")
    c = [F.col(f"p_{x}") for x in "abcd"]
    row = df.select(*[fu.fused(c, r).alias(r) for r in ("mean", "median", "max", "min", "trimmed_mean")], fu.fused(c[:3], "median").alias("m3")).first()
    assert row["mean"] == 0.5 and row["median"] == 0.5 and row["max"] == 0.9 and row["min"] == 0.1 and row["trimmed_mean"] == 0.5 and row["m3"] == 0.4
    with pytest.raises(ValueError):
        fu.fused(c[:2], "trimmed_mean")
    assert fu.leave_one_out(("a", "b"), ("b",)) == {"full": ("a", "b"), "without_b": ("a",)}


def test_missing_view_fails_the_job(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.6), (2, "a", 0.7)], "id int, view string, p double")
    with pytest.raises(Exception, match="lacks a score"):
        fu.require_complete(fu.collect_views(df, ["id"], "view", "p", ["a", "b"]), ["p_a", "p_b"]).collect()


def test_scoring(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, -3.0])], "id bigint, x array<double>")
    got = {r.sample_id: (r.score, r.pred, r.model) for r in score_batches(df, "id", "x", "lin", linear_scorer([1.0, 1.0])).collect()}
    assert got[1][0] == pytest.approx(1 / (1 + math.exp(-3))) and got[2][1] == 0 and got[1][2] == "lin"


def test_fusion_weights_ignore_stray_labels(spark):
    rng = np.random.default_rng(2)
    rows = [(("REAL_ORIGINAL", "AI_GENERATED", "AI_MANIPULATED")[i % 3], float(rng.random()), float(rng.random())) for i in range(300)]
    clean = cal.fit_fusion(spark.createDataFrame(rows, "truth string, p_generated double, p_manipulated double"), "truth")
    stray = cal.fit_fusion(spark.createDataFrame([("A_STRAY", .5, .5), (None, .1, .2), *rows], "truth string, p_generated double, p_manipulated double"), "truth")
    assert np.allclose(clean.weights, stray.weights, atol=1e-6) and np.allclose(clean.biases, stray.biases, atol=1e-6)
    with pytest.raises(ValueError):
        cal.fit_fusion(spark.createDataFrame([("A_STRAY", .5, .5)], "truth string, p_generated double, p_manipulated double"), "truth")


def test_fusion_certificate_tells_a_minimum(spark):
    rng = np.random.default_rng(6)
    rows = [(t, float(np.round(rng.beta(2 + 3 * (t == "AI_GENERATED"), 3), 3)), float(np.round(rng.beta(2 + 3 * (t == "AI_MANIPULATED"), 3), 3))) for t in rng.choice(["REAL_ORIGINAL", "AI_GENERATED", "AI_MANIPULATED"], 900, p=[.6, .3, .1])]
    df = spark.createDataFrame([(str(t), g, m) for t, g, m in rows], "truth string, p_generated double, p_manipulated double")
    fitted = cal.fit_fusion(df, "truth")
    good = cal.fusion_certificate(df, "truth", fitted).collect()
    assert len(good) == 3 and max(r.residual for r in good) < 1e-10 and all(abs(r.model_share - 1 / 3) < 1e-10 for r in good)
    moved = type(fitted)(tuple(tuple(x + .05 * (i == j) for j, x in enumerate(w)) for i, w in enumerate(fitted.weights)), fitted.biases, fitted.labels)
    assert max(r.residual for r in cal.fusion_certificate(df, "truth", moved).collect()) > 1e-4


def test_condition_study_against_plain_numbers(spark):
    from plumbline.operators import robustness as rb
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        base, y = round(float(rng.random()), 3), int(rng.random() < .4)
        rows += [(c, y, base, round(min(1.0, max(0.0, base + float(rng.normal(m, s)))), 3)) for c, m, s in (("base", 0, 0), ("same", 0, 0), ("soft", -.02, .05), ("hard", -.1, .2))]
    out = {r.c: r for r in rb.condition_study(spark.createDataFrame(rows, "c string, y int, base double, s double"), "c", "base", "y", "base", "s", inclusive=False).collect()}
    assert set(out) == {"base", "same", "soft", "hard"}
    for c, r in out.items():
        for who, ys in (("all", (0, 1)), ("positive", (1,)), ("negative", (0,))):
            d = np.round(np.array([s - b for k, y, b, s in rows if k == c and y in ys]), 9)
            assert r[f"{who}_n"] == d.size and abs(r[f"{who}_mean"] - d.mean()) < 1e-9 and abs(r[f"{who}_median"] - np.median(d)) < 1e-9 and abs(r[f"{who}_std"] - d.std()) < 1e-7
            shares = [(d < -.1).mean(), ((d >= -.1) & (d < -.05)).mean(), (abs(d) <= .05).mean(), ((d > .05) & (d <= .1)).mean(), (d > .1).mean()]
            assert [r[f"{who}_{b}"] for b in rb.SHIFT_BUCKETS] == pytest.approx([x * 100 for x in shares])
        assert r.tp == sum(k == c and y == 1 and s > .5 for k, y, _, s in rows)
        d = np.round(np.array([s - b for k, y, b, s in rows if k == c and y == 1]), 9)
        if c in ("base", "same"):
            assert (r.statistic, r.p_value, r.bonferroni_significant) == (0, 1, False)
        else:
            n, wp, wm = plain_signed_rank(d)
            assert r.statistic == min(wp, wm) and r.bonferroni_significant == (r.p_value < .05 / 3)
    assert out["hard"].bonferroni_significant
