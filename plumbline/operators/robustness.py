"""Condition studies: every perturbed condition against the clean run of the same model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import is_positive, ratio, snapped
from plumbline.operators.metrics import cell_counts, with_rates
from plumbline.operators.prefix import describe_counted
from plumbline.operators.stats import signed_rank_counted
from plumbline.session import cut_lineage


def against_clean(table: DataFrame, metrics: Sequence[str], clean: Column, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Attach clean_<metric> of the same keys to every row. The table is a rollup (models x conditions), so a
    window over it is small. Keys with several clean rows, or none, give NULL."""
    w = Window.partitionBy(*keys)
    one = F.sum(clean.cast("int")).over(w) == 1
    return table.select("*", *[F.when(one, F.max(F.when(clean, F.col(m))).over(w)).alias(f"clean_{m}") for m in metrics])


def retention(metric: str) -> dict[str, Column]:
    """Absolute and relative drop from clean and the share retained."""
    now, clean = F.col(metric), F.col(f"clean_{metric}")
    return {
        f"{metric}_drop": clean - now, f"{metric}_drop_pct": ratio(clean - now, clean) * 100.0,
        f"{metric}_retention": ratio(now, clean),
    }


def best_and_worst(table: DataFrame, keys: Sequence[str], metric: str, name: str, order: str) -> DataFrame:
    """Mean over rows with the best and worst row; on equal values the first by ``order`` wins."""
    return table.groupBy(*keys).agg(
        F.avg(metric).alias(f"mean_{metric}"),
        F.max_by(name, F.struct(F.col(metric), -F.col(order))).alias(f"best_{name}"), F.max(metric).alias(f"best_{metric}"),
        F.min_by(name, F.struct(F.col(metric), F.col(order))).alias(f"worst_{name}"), F.min(metric).alias(f"worst_{metric}"))


def head_to_head(table: DataFrame, first: str, second: str, metric: str, condition: Sequence[str]) -> DataFrame:
    """Per condition the metric of two models and their difference (second minus first)."""
    value = lambda m: F.max(F.when(F.col("model") == m, F.col(metric)))
    return table.where(F.col("model").isin(first, second)).groupBy(*condition).agg(value(first).alias("first"), value(second).alias("second")) \
        .withColumn("difference", F.col("second") - F.col("first"))


#: Shift buckets: name -> (lowest, highest) share of all rows whose score moved so far; None is open. Fixed values.
SHIFT_BUCKETS = ("down_over_10", "down_5_to_10", "within_5", "up_5_to_10", "up_over_10")


def shift_bucket_tests(delta: Column) -> dict[str, Column]:
    tests = (delta < -0.10, (delta >= -0.10) & (delta < -0.05), F.abs(delta) <= 0.05, (delta > 0.05) & (delta <= 0.10), delta > 0.10)
    return dict(zip(SHIFT_BUCKETS, tests, strict=True))


def condition_study(df: DataFrame, condition: str, baseline: str, y: str, base: str, score: str, threshold: float = 0.5, inclusive: bool = True,
                    metrics: Sequence[str] = ("accuracy", "precision", "recall", "f1"), alpha: float = 0.05) -> DataFrame:
    """One row per condition: confusion counts and rates; mean, median and spread of the score's shift against ``base`` and the percentages of rows in five
    shift buckets, for all rows, those with y = 1 and those with y = 0; the signed-rank test of the y = 1 shifts, and whether it holds after Bonferroni over
    all conditions but ``baseline``.

    Rows are read once and counted to cells (condition, y, decision, shift to nine digits), which everything else is made of: their number is bounded by the
    resolution of the scores. A condition whose y = 1 rows did not move at all has statistic 0 and p 1.
    """
    shift = snapped(F.col(score) - F.col(base), 9)
    cells = cut_lineage(df.groupBy(condition, F.col(y).alias("y"), is_positive(score, threshold, inclusive).cast("int").alias("pred"), shift.alias("delta")).agg(F.count("*").alias("n")))
    rates = with_rates(cells.groupBy(condition).agg(*cell_counts("y", "pred", F.col("n"))), metrics).drop("n")
    whose = F.explode(F.array(F.lit("all"), F.when(F.col("y") == 1, "positive").otherwise("negative")))
    scoped = cells.select(condition, whose.alias("who"), "delta", "n").groupBy(condition, "who", "delta").agg(F.sum("n").alias("n"))
    moments = describe_counted(scoped, [condition, "who"], "delta", "n", {"median": 0.5}).select(condition, "who", "n", "mean", "median", "std")
    within = scoped.groupBy(condition, "who").agg(*[(F.sum(F.when(t, F.col("n")).otherwise(0)) / F.sum("n") * 100.0).alias(name) for name, t in shift_bucket_tests(F.col("delta")).items()])
    each = moments.join(within, [condition, "who"])
    names = ("n", "mean", "median", "std", *SHIFT_BUCKETS)
    wide = each.groupBy(condition).agg(*[F.max(F.when(F.col("who") == who, F.col(c))).alias(f"{who}_{c}") for who in ("all", "positive", "negative") for c in names])
    tests = signed_rank_counted(cells.where("y = 1"), [condition], "delta", "n").select(condition, "statistic", "p_value")
    count = cells.select(condition).where(F.col(condition) != baseline).distinct().agg(F.count("*").alias("_tests"))
    out = rates.join(wide, condition).join(tests, condition, "left").withColumns({"statistic": F.coalesce("statistic", F.lit(0.0)), "p_value": F.coalesce("p_value", F.lit(1.0))})
    return out.withColumn("bonferroni_significant", F.col("p_value") < F.lit(alpha) / count.scalar())
