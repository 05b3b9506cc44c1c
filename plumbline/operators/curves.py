"""ROC and precision-recall quantities from score histograms.

Rows are first reduced to one row per (group, distinct score); ties thus become one curve point by
construction. The running counts come from ``value_totals``, so one model's scores are not sorted on a
single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import ratio
from plumbline.operators.prefix import SPLITS, value_totals


def score_histogram(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score",
                    weight: str | None = None) -> DataFrame:
    """Positives and negatives per (group, score)."""
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(y) == 0, w).otherwise(0)).alias("neg"))


def curve_points(hist: DataFrame, keys: Sequence[str], splits: int = SPLITS) -> DataFrame:
    """Cumulative (tp, fp) at every distinct score used as threshold, highest first, and the totals P, N."""
    run = value_totals(hist, keys, "score", {"tp": "pos", "fp": "neg"}, descending=True, splits=splits)
    return run.withColumnRenamed("tp_all", "n_pos").withColumnRenamed("fp_all", "n_neg")


def roc_curve(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Curve rows (threshold, fpr, tpr), the origin included at a threshold just above the top score."""
    keys = list(keys)
    at = points.select(*keys, F.col("score").alias("threshold"),
                       ratio("fp", "n_neg").alias("fpr"), ratio("tp", "n_pos").alias("tpr"))
    origin = at.groupBy(*keys).agg((F.max("threshold") + F.lit(1e-6)).alias("threshold")) \
               .withColumn("fpr", F.lit(0.0)).withColumn("tpr", F.lit(0.0))
    return at.unionByName(origin)


def _interp_tpr(x: float) -> Column:
    """TPR at a given FPR: the last point at or below x, then linear to the next point."""
    fpr, tpr = ratio("fp", "n_neg"), ratio("tp", "n_pos")
    left = fpr <= F.lit(x)
    f0 = F.coalesce(F.max(F.when(left, fpr)), F.lit(0.0))
    t0 = F.coalesce(F.max(F.when(left, tpr)), F.lit(0.0))
    f1 = F.min(F.when(~left, fpr))
    t1 = F.min(F.when(~left, tpr))
    return F.coalesce(t0 + (t1 - t0) * (F.lit(x) - f0) / (f1 - f0), t0)


def curve_metrics(points: DataFrame, keys: Sequence[str], fpr_levels: Sequence[float] = (0.01, 0.05, 0.10)) -> DataFrame:
    """AUROC (trapezoid), average precision, EER and TPR at fixed FPR, one row per group.

    The previous curve point is (tp - pos, fp - neg), so no lag over the curve is needed. With one class
    absent AUROC is 0.5, as the diagonal curve gives.
    """
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    trapezoid = ratio("neg", n) * (F.col("tp") + F.col("tp") - F.col("pos")) / F.lit(2.0)
    one_class = (F.min("n_pos") == 0) | (F.min("n_neg") == 0)
    gap = F.abs(ratio("fp", n) - (F.lit(1.0) - ratio("tp", p)))
    centre = (ratio("fp", n) + F.lit(1.0) - ratio("tp", p)) / F.lit(2.0)
    return points.groupBy(*keys).agg(
        F.when(one_class, F.lit(0.5)).otherwise(ratio(F.sum(trapezoid), F.max(p))).alias("auroc"),
        ratio(F.sum(F.col("pos") * ratio("tp", F.col("tp") + F.col("fp"))), F.max(p)).alias("average_precision"),
        F.min_by(centre, F.struct(gap, -F.col("score"))).alias("eer"),
        *[_interp_tpr(x).alias(f"tpr_at_fpr_{round(x * 100)}") for x in fpr_levels])


def ranking_metrics(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    return curve_metrics(curve_points(score_histogram(df, keys, y, score), keys), keys)


def auroc_rank_sum(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AUROC by the rank-sum formula with average ranks for ties; an independent check of the trapezoid.

    ``points`` runs from the highest score, so a tie group's ascending ranks end at
    total - (rows ranked above it).
    """
    total = F.col("n_pos") + F.col("n_neg")
    above = F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    size = F.col("pos") + F.col("neg")
    mean_rank = (total - above).cast("double") - (size - 1) / F.lit(2.0)
    p, n = F.max("n_pos").cast("double"), F.max("n_neg").cast("double")
    u = F.sum(F.col("pos") * mean_rank) - p * (p + 1.0) / 2.0
    return points.groupBy(*keys).agg(ratio(u, p * n, 0.5).alias("auroc"))
