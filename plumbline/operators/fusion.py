"""Multi-view fusion: several scores of one sample (views, crops, model variants) combined per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The views and the named view sets of the fusion study.
VIEWS = ("native", "pad_1_1", "pad_16_9", "pad_9_16", "pad_narrow", "jpeg_95", "jpeg_75")
VIEW_SETS: dict[str, tuple[str, ...]] = {
    "A": ("native",),
    "B": ("native", "pad_1_1"),
    "C": ("native", "pad_9_16"),
    "D": ("native", "pad_narrow"),
    "E": ("native", "pad_16_9"),
    "F": ("native", "pad_1_1", "pad_9_16"),
    "G": ("native", "pad_1_1", "pad_9_16", "pad_16_9"),
    "H": ("native", "pad_1_1", "pad_9_16", "pad_narrow", "pad_16_9"),
    "I": ("native", "jpeg_95"),
    "J": ("native", "jpeg_75"),
    "K": ("native", "pad_1_1", "pad_9_16", "pad_16_9", "jpeg_95"),
    "L": ("native", "pad_1_1", "pad_9_16", "pad_narrow", "pad_16_9", "jpeg_75"),
}


def collect_views(df: DataFrame, keys: Sequence[str], view: str, value: str, views: Sequence[str], prefix: str = "p_") -> DataFrame:
    """Long (sample, view, score) to one row per sample with a column per view. One conditional maximum per
    view, so a sample with repeated rows is reduced on the map side."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(view) == v, F.col(value))).alias(f"{prefix}{v}") for v in views])


def require_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail the job on the first row that lacks one of the columns."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    guard = F.when(complete, F.lit(True)).otherwise(F.raise_error(F.lit("a sample lacks a score")).cast("boolean"))
    return df.where(guard)


def fused(columns: Sequence[Column], rule: str) -> Column:
    """mean, median, max or trimmed_mean (drops the lowest and highest; needs three or more)."""
    n = len(columns)
    total = lambda cs: sum(cs[1:], cs[0])
    if n == 1:
        return columns[0]
    if rule == "mean":
        return total(list(columns)) / F.lit(float(n))
    if rule == "max":
        return F.greatest(*columns)
    if rule == "min":
        return F.least(*columns)
    ordered = F.array_sort(F.array(*columns))
    at = lambda i: F.element_at(ordered, i + 1)
    if rule == "median":
        return at(n // 2) if n % 2 else (at(n // 2 - 1) + at(n // 2)) / F.lit(2.0)
    if rule == "trimmed_mean":
        if n < 3:
            raise ValueError("a trimmed mean needs three scores")
        return total([at(i) for i in range(1, n - 1)]) / F.lit(float(n - 2))
    raise ValueError(f"unknown fusion rule {rule!r}")


def fusion_table(sets: Mapping[str, Sequence[str]] = VIEW_SETS, rules: Sequence[str] = ("mean", "median", "max", "trimmed_mean"),
                 prefix: str = "p_") -> Column:
    """Array of (view_set, rule, fused) structs for one row; trimmed means only where they are defined."""
    out = []
    for name, views in sets.items():
        cols = [F.col(prefix + v) for v in views]
        out += [F.struct(F.lit(name).alias("view_set"), F.lit(r).alias("rule"), fused(cols, r).alias("fused"))
                for r in rules if r != "trimmed_mean" or len(cols) >= 3]
    return F.array(*out)


def leave_one_out(views: Sequence[str], removable: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The full set and the set without each removable view."""
    return {"full": tuple(views), **{f"without_{r}": tuple(v for v in views if v != r) for r in removable}}


def explode_fusion(df: DataFrame, keep: Sequence[str], table: Column) -> DataFrame:
    return df.select(*keep, F.explode(table).alias("_f")).select(*keep, "_f.view_set", "_f.rule", "_f.fused")


def recovery(base: str, other: str, y: str = "y", threshold: float = 0.5) -> list[Column]:
    """Aggregates comparing a view with the base: recovered misses, new and cleared false alarms."""
    b, o, yy = F.col(base) >= threshold, F.col(other) >= threshold, F.col(y)
    return [
        F.count_if((yy == 1) & ~b).alias("base_fn"), F.count_if((yy == 1) & ~b & o).alias("recovered_fn"),
        F.count_if((yy == 1) & b & ~o).alias("lost_tp"),
        F.count_if((yy == 0) & o).alias("fp"), F.count_if((yy == 0) & o & ~b).alias("new_fp"),
        F.count_if((yy == 0) & b & ~o).alias("cleared_fp"),
    ]


def delta_summary(delta: Column) -> list[Column]:
    """Mean change and how many rows went down or up: the summary of a branch masked out."""
    return [F.avg(delta).alias("mean_delta"), F.count_if(delta < 0).alias("n_decreased"), F.count_if(delta > 0).alias("n_increased")]
