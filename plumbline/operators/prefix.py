"""Ranks, running totals and exact quantiles over groups too big for one task.

A plain window puts a whole group on one task. Here every group is cut into ordered buckets: the running
total inside a bucket is a window over that bucket only, and the totals of the buckets before it (at most
``BUCKETS`` + 1 rows per group) are added by an equi-join. Buckets of hashed orders are digits of the hash; buckets of values lie
between split points taken from the values themselves, so crowded, huge and sparse values fill them evenly alike.
The bucket depends on the row alone, so a lost executor can recompute any part and get the same answer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import ColumnLike, col
from plumbline.session import cut_lineage

BUCKETS = 4096
#: Split points of value buckets; the driver holds this many numbers.
SPLITS = 1024


def hash_bucket(hex_digest: ColumnLike) -> Column:
    """Bucket from the first three hex digits: order-preserving and evenly filled whatever the ids are."""
    return F.conv(F.substring(col(hex_digest), 1, 3), 16, 10).cast("bigint")


def with_even_bucket(df: DataFrame, value: str, splits: int = SPLITS, name: str = "_bucket") -> DataFrame:
    """Add a bucket number that is monotone in the numeric column ``value`` and holds at most about 1/``splits`` of all rows,
    but for rows with one same value. NULL comes first, NaN last.

    The split points are approximate quantiles of the rows; since they only cut, results stay exact. ``df`` is read for them, so
    it should be a staged table.
    """
    from pyspark.ml.feature import Bucketizer

    x = F.col(value).cast("double")
    finite = F.when(~F.isnan(x), x)
    points = df.agg(F.percentile_approx(finite, [i / splits for i in range(1, splits)], 16 * splits).alias("q")).first().q or []
    inner = sorted({float(v) for v in points if v is not None and abs(v) != float("inf")})
    cuts = [float("-inf"), *inner, float("inf")]
    if len(cuts) < 3:
        return df.withColumn(name, F.when(x.isNull(), -1).when(F.isnan(x), 1).otherwise(0).cast("bigint"))
    placed = Bucketizer(splits=cuts, inputCol="_x", outputCol="_b", handleInvalid="keep").transform(df.withColumn("_x", x))
    return placed.withColumn(name, F.coalesce(F.when(x.isNull(), -1).otherwise(F.col("_b")), F.lit(-1)).cast("bigint")).drop("_x", "_b")


def _not_null(df: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    """Columns without NULL that tell the same groups apart: joins on them keep a hash partitioning, null-safe ones do not."""
    out = {}
    for i, k in enumerate(keys):
        kind = df.schema[k].dataType
        c = F.col(k)
        base = c if isinstance(kind, (T.NumericType, T.StringType, T.BooleanType)) else c.cast("string")
        blank = F.lit("0") if not isinstance(kind, T.BooleanType) else F.lit(False)
        out[f"_g{i}"] = F.coalesce(base, blank.cast(kind if base is c else T.StringType()))
        out[f"_n{i}"] = c.isNull()
    return out


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | str,
                   sums: Mapping[str, str], descending: bool = False) -> DataFrame:
    """Add, for each ``name: column`` of ``sums``, the inclusive running total ``name`` within ``keys`` in
    the given order, and the group total ``name_all``.

    ``bucket`` must be monotone in the order, and the order columns unique within ``keys``. Rows are shuffled once, by
    group and bucket; bucket totals, the window inside buckets and the join of the offsets all work on that one partitioning.
    """
    side = F.desc if descending else F.asc
    coded = _not_null(df, keys)
    groups = list(coded)
    dealt = df.withColumns({**coded, "_k": F.coalesce(col(bucket), F.lit(-1).cast("bigint"))}).repartition(*groups, "_k")
    # A number that needs every column: else the totals would get an exchange of their own, of fewer columns, and the input a second scan.
    hashable = [F.col(c) for c in dealt.columns if not isinstance(dealt.schema[c].dataType, T.MapType)]
    totals = dealt.groupBy(*groups, "_k").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()], F.max(F.xxhash64(*hashable)).alias("_whole"))
    across = Window.partitionBy(*groups).orderBy(side("_k"))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = totals.select(
        *[F.col(g).alias(f"{g}_") for g in groups], F.col("_k").alias("_k_"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_all") for n in sums], "_whole",
    ).where(F.col("_whole").isNotNull())
    inside = Window.partitionBy(*groups, "_k").orderBy(*[side(o) for o in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = dealt.select("*", *[F.sum(c).over(inside).alias(f"_l_{n}") for n, c in sums.items()])
    on = [local[g] == offsets[f"{g}_"] for g in groups] + [local["_k"] == offsets["_k_"]]
    joined = local.join(offsets, on, "inner")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
        *[F.col(f"{n}_all") for n in sums],
    )


def value_totals(df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, str], descending: bool = False, splits: int = SPLITS) -> DataFrame:
    """``running_totals`` in the order of a numeric column, with even buckets. ``df`` (one row per value) is staged first.

    ``splits`` bounds a bucket's share of all rows; where there are many groups of much the same size, few are enough.
    """
    staged = with_even_bucket(cut_lineage(df), value, splits)
    return running_totals(staged, keys, [value], "_bucket", sums, descending).drop("_bucket")


def seeded_rank(df: DataFrame, keys: Sequence[str], id_col: str, seed: str, rank: str = "rank",
                size: str = "n_group") -> DataFrame:
    """Position (from 1) of every row in a seeded pseudo-random order of its group, and the group size.

    The order is md5(seed:id), then id; it does not depend on how the data is partitioned.
    """
    hashed = df.withColumn("_digest", F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))) \
               .withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(hashed, keys, ["_digest", id_col], hash_bucket("_digest"), {rank: "_one"})
    return ranked.withColumnRenamed(f"{rank}_all", size).drop("_digest", "_one")


def describe(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], at_least: Mapping[str, float] | None = None) -> DataFrame:
    """Per group: n, mean, std (population), lowest, highest, exact linear-interpolation quantiles (one column per
    ``name: probability``) and percentages of values >= a level (``at_least``, ``name: level``).

    Equal values are counted first, in one pass over the rows; everything else works on the distinct values.
    NULLs are left out.
    """
    keys = list(keys)
    return describe_counted(df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(value).alias("_c")), keys, "_v", "_c", quantiles, at_least)


def describe_counted(cells: DataFrame, keys: Sequence[str], value: str, count: str, quantiles: Mapping[str, float], at_least: Mapping[str, float] | None = None) -> DataFrame:
    """``describe`` from rows that stand for ``count`` equal values each, one row a value."""
    keys = list(keys)
    counted = cells.select(*keys, F.col(value).alias("_v"), F.col(count).alias("_c")).where("_c > 0 and _v is not null").withColumn("_w", F.col("_v").cast("double") * F.col("_c"))
    ranked = value_totals(counted, keys, "_v", {"_upto": "_c", "_sum": "_w"})
    v, c = F.col("_v"), F.col("_c")
    # Squares of differences from the mean, which every row has by now: no cancellation for large values.
    off = v - F.col("_sum_all") / F.col("_upto_all")
    aggs = [F.max("_upto_all").alias("n"), F.max(F.col("_sum_all") / F.col("_upto_all")).alias("mean"), F.sum(off * off * c).alias("_s2"), F.min(v).alias("lowest"), F.max(v).alias("highest")]
    n = F.col("n")
    finals = [n, "mean", F.sqrt(F.col("_s2") / n).alias("std"), "lowest", "highest"]
    first = F.col("_upto") - c
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("_upto_all") - 1)
        low, high = F.floor(at), F.ceil(at)
        aggs += [F.max(F.when((first <= i) & (i < F.col("_upto")), v)).alias(f"_{name}_{side}") for side, i in (("lo", low), ("hi", high))]
        aggs.append(F.max(at - low).alias(f"_{name}_f"))
        lo, hi, f = (F.col(f"_{name}_{x}") for x in ("lo", "hi", "f"))
        finals.append((lo + (hi - lo) * f).alias(name))
    for name, level in (at_least or {}).items():
        aggs.append(F.sum(F.when(v >= F.lit(float(level)), c).otherwise(0)).alias(f"_{name}_n"))
        finals.append((F.col(f"_{name}_n") / n * 100.0).alias(name))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *finals)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """The quantile columns of ``describe`` alone."""
    return describe(df, keys, value, probabilities).select(*keys, *probabilities)
