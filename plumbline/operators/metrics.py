"""Confusion counts, rates, proper scores, calibration bins, selective metrics.

Every function takes the grouping columns, so the same code serves per-model, per-generator,
per-condition and per-subgroup tables. Counting collapses map-side; no fact row leaves its task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import clip, confidence, ratio

COUNTS = ("tp", "tn", "fp", "fn")


def cell_counts(y: str | Column, pred: str | Column, weight: Column | None = None) -> list[Column]:
    """The four confusion counts as aggregates. ``y`` and ``pred`` are 0/1 with 1 the positive class."""
    y = F.col(y) if isinstance(y, str) else y
    pred = F.col(pred) if isinstance(pred, str) else pred
    def count(cond: Column) -> Column:
        if weight is None:
            return F.count_if(cond)
        return F.coalesce(F.sum(F.when(cond, weight)), F.lit(0)).cast("bigint")
    return [
        count((y == 1) & (pred == 1)).alias("tp"),
        count((y == 0) & (pred == 0)).alias("tn"),
        count((y == 0) & (pred == 1)).alias("fp"),
        count((y == 1) & (pred == 0)).alias("fn"),
    ]


def rate_columns(single_class: str = "accuracy", undefined: float | None = 0.0) -> dict[str, Column]:
    """Rates from tp/tn/fp/fn. Products are taken as doubles: four counts multiplied overflow a BIGINT.

    ``single_class``: balanced accuracy when one class is absent is the accuracy ("accuracy") or the mean
    with a zero ("half"). ``undefined``: what an undefined ratio becomes, 0.0 or None for NULL.
    """
    tp, tn, fp, fn = (F.col(c).cast("double") for c in COUNTS)
    total = tp + tn + fp + fn
    accuracy = ratio(tp + tn, total, undefined)
    precision, recall = ratio(tp, tp + fp, undefined), ratio(tp, tp + fn, undefined)
    specificity = ratio(tn, tn + fp, undefined)
    f1 = ratio(F.lit(2.0) * precision * recall, precision + recall, undefined)
    halves = (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2.0
    balanced = F.when(((tp + fn) > 0) & ((tn + fp) > 0), halves).otherwise(accuracy) if single_class == "accuracy" else halves
    mcc = ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn), undefined)
    neg_precision = ratio(tn, tn + fn, undefined)
    neg_f1 = ratio(F.lit(2.0) * neg_precision * specificity, neg_precision + specificity, undefined)
    return {
        "accuracy": accuracy, "precision": precision, "recall": recall, "f1": f1, "specificity": specificity,
        "fpr": ratio(fp, tn + fp, undefined), "fnr": ratio(fn, tp + fn, undefined),
        "balanced_accuracy": balanced, "mcc": mcc,
        "negative_precision": neg_precision, "negative_f1": neg_f1,
        "macro_precision": (precision + neg_precision) / 2.0,
        "macro_recall": (recall + specificity) / 2.0, "macro_f1": (f1 + neg_f1) / 2.0,
    }


MAIN_RATES = ("accuracy", "precision", "recall", "f1", "specificity", "fpr", "fnr", "balanced_accuracy", "mcc")
MACRO_RATES = ("macro_precision", "macro_recall", "macro_f1", "negative_precision", "negative_f1")


def with_rates(counts: DataFrame, names: Sequence[str] = MAIN_RATES, single_class: str = "accuracy",
               undefined: float | None = 0.0) -> DataFrame:
    rates = rate_columns(single_class, undefined)
    return counts.select("*", *[rates[n].alias(n) for n in names])


def confusion(df: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "pred",
              positive: int = 1) -> DataFrame:
    """Confusion counts per group. ``positive`` names the label value treated as the positive class."""
    yy = (F.col(y) == positive).cast("int")
    pp = (F.col(pred) == positive).cast("int")
    return df.groupBy(*keys).agg(*cell_counts(yy, pp))


def binary_metrics(df: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "pred",
                   names: Sequence[str] = MAIN_RATES, **how) -> DataFrame:
    return with_rates(confusion(df, keys, y, pred), names, **how)


# --------------------------------------------------------------------------- verdicts with abstention

TRUTHS = ("REAL_ORIGINAL", "AI_GENERATED", "AI_MANIPULATED")
ABSTAIN = "UNCERTAIN"


def verdict_confusion(df: DataFrame, keys: Sequence[str], truth: str = "truth", verdict: str = "verdict") -> DataFrame:
    """One row per group with the 3x4 confusion counts n_<truth>_<verdict>; unknown verdicts abstain."""
    known = F.col(verdict).isin(*TRUTHS)
    v = F.when(known, F.col(verdict)).otherwise(F.lit(ABSTAIN))
    cells = df.groupBy(*keys, F.col(truth).alias("_t"), v.alias("_v")).agg(F.count("*").alias("_n"))
    return verdict_table(cells, keys, "_t", "_v", "_n")


def verdict_table(cells: DataFrame, keys: Sequence[str], truth: str, verdict: str, n: str) -> DataFrame:
    out = []
    for t in TRUTHS:
        for v in (*TRUTHS, ABSTAIN):
            hit = (F.col(truth) == t) & (F.col(verdict) == v)
            out.append(F.coalesce(F.sum(F.when(hit, F.col(n))), F.lit(0)).cast("bigint").alias(f"n_{t}_{v}"))
    return cells.groupBy(*keys).agg(*out, F.sum(n).cast("bigint").alias("n_total"))


def verdict_rates(table: DataFrame, keep_counts: bool = False) -> DataFrame:
    """Accuracy, per-class and macro P/R/F1, abstention rate. An abstention is a miss of its true class
    and nobody's false alarm."""
    n = lambda t, v: F.col(f"n_{t}_{v}").cast("double")
    add = lambda cs: sum(cs[1:], cs[0])
    total = F.col("n_total").cast("double")
    cols, per = {}, {"precision": [], "recall": [], "f1": []}
    cols["accuracy"] = ratio(add([n(t, t) for t in TRUTHS]), total)
    for t in TRUTHS:
        tp = n(t, t)
        p = ratio(tp, add([n(o, t) for o in TRUTHS]))
        r = ratio(tp, add([n(t, v) for v in (*TRUTHS, ABSTAIN)]))
        f = ratio(F.lit(2.0) * p * r, p + r)
        for k, c in (("precision", p), ("recall", r), ("f1", f)):
            per[k].append(c)
            cols[f"{k}_{t.lower()}"] = c
    for k in per:
        cols[f"macro_{k}"] = add(per[k]) / F.lit(3.0)
    cols["uncertain_rate"] = ratio(add([n(t, ABSTAIN) for t in TRUTHS]), total)
    kept = [c for c in table.columns if keep_counts or not c.startswith("n_")]
    return table.select(*kept, *[c.alias(k) for k, c in cols.items()])


# --------------------------------------------------------------------------- proper scores, calibration

def proper_scores(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "score", eps: float = 1e-12) -> DataFrame:
    q = clip(p, eps, 1.0 - eps)
    yy = F.col(y).cast("double")
    nll = -(yy * F.log(q) + (F.lit(1.0) - yy) * F.log(F.lit(1.0) - q))
    err = F.col(p) - yy
    return df.groupBy(*keys).agg(F.avg(nll).alias("nll"), F.avg(err * err).alias("brier"))


def bin_index(c: Column, bins: int) -> Column:
    """Bin of a value in [0, 1] against the edges i * (1/bins) as doubles, corrected for the product's rounding."""
    step = F.lit(1.0 / bins)
    guess = F.floor(c * F.lit(float(bins)))
    exact = F.when(c < guess * step, guess - 1).when(c >= (guess + 1) * step, guess + 1).otherwise(guess)
    return F.greatest(F.least(exact, F.lit(bins - 1)), F.lit(0)).cast("int")


def reliability_bins(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "score", bins: int = 10,
                     bin_on: str = "probability") -> DataFrame:
    """Count, accuracy, confidence, mean score and positive share per bin; empty bins are kept.

    Bins are closed on the left, the last one on both sides. ``bin_on`` picks the binned quantity:
    the probability of the positive class, or the confidence of the decision.
    """
    keys = list(keys)
    pred = (F.col(p) >= 0.5).cast("int")
    conf = confidence(p)
    binned = F.col(p) if bin_on == "probability" else conf
    b = bin_index(binned, bins)
    filled = df.groupBy(*keys, b.alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg((pred == F.col(y)).cast("double")).alias("bin_accuracy"),
        F.avg(conf).alias("bin_confidence"),
        F.avg(F.col(p)).alias("mean_score"),
        F.avg(F.col(y).cast("double")).alias("positive_share"),
    )
    # The full set of bins per group comes from the aggregated rows, not from the facts.
    frame = filled.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = frame.join(filled, [*keys, "bin"], "left")
    mid = (F.col("bin") + F.lit(0.5)) / F.lit(float(bins))
    return out.select(
        *keys, "bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "bin_accuracy", "bin_confidence",
        F.coalesce("mean_score", mid).alias("mean_score"), "positive_share")


def calibration_error(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ECE (count-weighted) and MCE (largest) of |accuracy - confidence| over the bins."""
    gap = F.abs(F.col("bin_accuracy") - F.col("bin_confidence"))
    return bins.groupBy(*keys).agg(
        ratio(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"), F.coalesce(F.max(gap), F.lit(0.0)).alias("mce"))


# Confidence levels of the risk-coverage table.
COVERAGE_LEVELS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)


def level_index(c: Column, levels: Sequence[float]) -> Column:
    """How many of the ascending levels are <= the value: lets one pass serve every threshold."""
    return F.coalesce(sum([(c >= F.lit(float(t))).cast("int") for t in levels[1:]], (c >= F.lit(float(levels[0]))).cast("int")), F.lit(0))


def risk_coverage(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "score",
                  levels: Sequence[float] = COVERAGE_LEVELS) -> DataFrame:
    """Coverage, selective accuracy, risk and F1 at each confidence level; accuracy is 1 when nothing is covered.

    The facts are reduced to at most len(levels)+1 cells per group before the levels are multiplied out.
    """
    keys = list(keys)
    cells = df.groupBy(*keys, level_index(confidence(p), levels).alias("_i")).agg(
        *cell_counts(F.col(y), (F.col(p) >= 0.5).cast("int")))
    level = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("need"), F.lit(float(t)).alias("level")) for i, t in enumerate(levels)]))
    spread = cells.withColumn("_l", level).select(*keys, F.col("_l.level").alias("level"), "_i", F.col("_l.need").alias("_need"), *COUNTS)
    covered = F.col("_i") >= F.col("_need")
    summed = spread.groupBy(*keys, "level").agg(
        F.sum(sum([F.col(c) for c in COUNTS[1:]], F.col(COUNTS[0]))).alias("n_total"),
        *[F.sum(F.when(covered, F.col(c)).otherwise(0)).alias(c) for c in COUNTS])
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    rates = rate_columns()
    accuracy = ratio(F.col("tp") + F.col("tn"), n, 1.0)
    return summed.select(
        *keys, "level", n.alias("covered"), (F.col("n_total") - n).alias("abstained"),
        ratio(n, F.col("n_total")).alias("coverage"), accuracy.alias("selective_accuracy"),
        (F.lit(1.0) - accuracy).alias("selective_risk"), rates["f1"].alias("selective_f1"))


# --------------------------------------------------------------------------- thresholds

def error_bands(y: str = "y", pred: str = "pred", p: str = "score") -> list[Column]:
    """Counts of false alarms, misses and weak hits by how sure the model was."""
    y_, d, s = F.col(y), F.col(pred), F.col(p)
    fp, fn = (y_ == 0) & (d == 1), (y_ == 1) & (d == 0)
    hit, conf = y_ == d, confidence(p)
    return [
        F.count_if(fp & (s >= 0.90)).alias("fp_ge_90"),
        F.count_if(fp & (s >= 0.70) & (s < 0.90)).alias("fp_70_90"),
        F.count_if(fp & (s >= 0.50) & (s < 0.70)).alias("fp_50_70"),
        F.count_if(fn & (s < 0.10)).alias("fn_lt_10"),
        F.count_if(fn & (s >= 0.10) & (s < 0.30)).alias("fn_10_30"),
        F.count_if(fn & (s >= 0.30) & (s < 0.50)).alias("fn_30_50"),
        F.count_if(hit & (conf < 0.60)).alias("correct_conf_lt_60"),
        F.count_if(~hit & (conf >= 0.90)).alias("errors_conf_ge_90"),
        F.count_if(~hit & (conf >= 0.70)).alias("errors_conf_ge_70"),
    ]


def shift_buckets(delta: str | Column) -> list[Column]:
    """Shares (percent) of rows by size and sign of a score shift."""
    d = F.col(delta) if isinstance(delta, str) else delta
    pct = lambda c: (ratio(F.count_if(c), F.count("*")) * 100.0)
    return [
        pct(d < -0.10).alias("pct_dec_gt10"),
        pct((d >= -0.10) & (d < -0.05)).alias("pct_dec_5_10"),
        pct(F.abs(d) <= 0.05).alias("pct_chg_lt5"),
        pct((d > 0.05) & (d <= 0.10)).alias("pct_inc_5_10"),
        pct(d > 0.10).alias("pct_inc_gt10"),
    ]


def rank_within(df: DataFrame, keys: Sequence[str], *order: Column, name: str = "rank") -> DataFrame:
    """Position 1..n by the order. For small result tables; seeded_rank does this for fact tables."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
