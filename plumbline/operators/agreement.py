"""Agreement between models on the same samples.

Predictions are first reduced to pattern cells: how many samples of a class (and generator) have which
combination of right and wrong models. With four models there are sixteen patterns, so every table below
is computed from a few rows; no sample is joined with itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import ratio


def wide_predictions(df: DataFrame, keys: Sequence[str], models: Sequence[str], values: Sequence[str] = ("score", "pred")) -> DataFrame:
    """One row per sample with <value>_<model> columns, aligned by key and never by position."""
    aggs = [F.max(F.when(F.col("model") == m, F.col(v))).alias(f"{v}_{m}") for v in values for m in models]
    return df.groupBy(*keys).agg(*aggs)


def pattern_cells(wide: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    return wide.groupBy(*keys, *[f"pred_{m}" for m in models]).agg(F.count("*").alias("n"))


def _add(cs: Sequence[Column]) -> Column:
    return sum(cs[1:], cs[0])


def votes(models: Sequence[str]) -> Column:
    return _add([F.col(f"pred_{m}") for m in models])


def wrong_mask(models: Sequence[str], y: str = "y") -> Column:
    """Letters of the models that are wrong, in order; empty when all are right."""
    return F.concat(*[F.when(F.col(f"pred_{m}") != F.col(y), m).otherwise("") for m in models])


def right_models(models: Sequence[str], y: str = "y") -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(f"pred_{m}") == F.col(y), m) for m in models])), ", ")


def agreement_distribution(cells: DataFrame, models: Sequence[str], y: str = "y") -> DataFrame:
    """Overall and per class: samples by size of the larger camp, and the unanimous right and wrong ones."""
    k = len(models)
    v = votes(models)
    camp = F.greatest(v, F.lit(k) - v)
    scopes = F.array(F.lit("all"), F.when(F.col(y) == 1, "positive").otherwise("negative"))
    c = cells.withColumn("scope", F.explode(scopes)).withColumn("camp", camp).withColumn("v", v)
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    unanimous = F.col("camp") == k
    right = F.col("v") == F.col(y) * k
    return c.groupBy("scope").agg(
        F.sum("n").cast("bigint").alias("n_samples"), count(unanimous).alias("unanimous"),
        count(F.col("camp") == k - 1).alias("one_dissenter"), count(F.col("camp") == k - 2).alias("two_dissenters"),
        count(unanimous & right).alias("unanimous_right"), count(unanimous & ~right).alias("unanimous_wrong"))


def pairwise_agreement(cells: DataFrame, models: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("model_1"), F.lit(b).alias("model_2"),
                               F.when(F.col(f"pred_{a}") == F.col(f"pred_{b}"), F.col("n")).otherwise(0).alias("same"), F.col("n").alias("of"))
                      for a, b in combinations(models, 2)])
    return cells.select(F.explode(pairs).alias("p")).groupBy("p.model_1", "p.model_2").agg(
        F.sum("p.same").cast("bigint").alias("agreement"), ratio(F.sum("p.same"), F.sum("p.of")).alias("agreement_share"))


def error_groups(cells: DataFrame, models: Sequence[str], y: str = "y") -> DataFrame:
    """Samples per class and set of wrong models, with the number wrong and the share of the class."""
    from pyspark.sql import Window
    g = cells.groupBy(y, wrong_mask(models, y).alias("wrong_models")).agg(F.sum("n").cast("bigint").alias("n"))
    return g.select(y, "wrong_models", F.length("wrong_models").cast("int").alias("n_wrong"), "n",
                    ratio("n", F.sum("n").over(Window.partitionBy(y))).alias("share"))


def right_and_wrong(wide: DataFrame, right: Sequence[str], wrong: Sequence[str], y: str = "y") -> DataFrame:
    """Samples on which all of ``right`` are right and all of ``wrong`` are wrong."""
    cond = F.lit(True)
    for m in right:
        cond = cond & (F.col(f"pred_{m}") == F.col(y))
    for m in wrong:
        cond = cond & (F.col(f"pred_{m}") != F.col(y))
    return wide.where(cond)
