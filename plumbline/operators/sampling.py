"""Seeded samples, quotas, splits and manifests.

All randomness is an md5 order on (seed, id): repeatable, independent of partitioning, and cut into evenly
filled hash buckets, so ranking a stratum that holds most of the data is spread over the cluster.

Samples and quotas keep few rows of a large pool. They are found by a threshold: rows are counted by stratum and leading digits of the digest, the
digits in which a stratum's quota ends are refined once, and a filter by these limits leaves the quota and a 16 millionth of the pool. Only
these rows are moved and ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import col
from plumbline.operators.prefix import hash_bucket, running_totals, seeded_rank, value_totals
from plumbline.session import cut_lineage


def _digest(seed: str | Column, id_col: str) -> Column:
    s = F.lit(seed) if isinstance(seed, str) else seed
    return F.md5(F.concat_ws(":", s, F.col(id_col).cast("string")))


def digest_limits(df: DataFrame, keys: Sequence[str], id_col: str, seed: str, need: Column, counted: Column | None = None) -> DataFrame:
    """(keys..., _limit) per stratum: among the rows whose digest's first six digits are at most ``_limit`` lie the first ``need`` rows of the stratum in
    seeded order for which ``counted`` is true (all rows of a stratum that has fewer).

    Two passes that read the keys and the id, each one aggregation combined before the shuffle, of at most 4,096 rows a stratum.
    """
    names = [f"_s{i}" for i in range(len(keys))]
    one = F.lit(1) if counted is None else counted.cast("int")
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], _digest(seed, id_col).alias("_d"), one.alias("_c"), need.cast("bigint").alias("_need"))

    def ends(counts: DataFrame) -> DataFrame:
        """The digits in which each stratum's quota ends, what is left of it there, or '~', beyond all digits, where it is not reached."""
        run = F.sum("_n").over(Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
        reached = F.col("_run") >= F.col("_need")
        first = F.min(F.when(reached, F.struct("_p", (F.col("_need") - F.col("_run") + F.col("_n")).alias("_rest"))))
        return counts.withColumn("_run", run).groupBy(*names).agg(first.alias("_f")).select(*names, F.coalesce(F.col("_f._p"), F.lit("~")).alias("_end"), F.col("_f._rest").alias("_rest"))

    coarse = cut_lineage(ends(rows.groupBy(*names, F.substring("_d", 1, 3).alias("_p")).agg(F.sum("_c").alias("_n"), F.max("_need").alias("_need"))))
    same = [rows[n].eqNullSafe(coarse[n]) for n in names] + [F.substring(rows["_d"], 1, 3) == coarse["_end"]]
    inside = rows.join(coarse, same).groupBy(*[rows[n] for n in names], F.substring("_d", 1, 6).alias("_p")).agg(F.sum("_c").alias("_n"), F.max("_rest").alias("_need"))
    fine = ends(inside).select(*[F.col(n).alias(f"{n}f") for n in names], F.col("_end").alias("_fine"))
    both = coarse.join(fine, [coarse[n].eqNullSafe(fine[f"{n}f"]) for n in names] or F.lit(True), "left")
    return cut_lineage(both.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.coalesce("_fine", "_end").alias("_limit")))


def _with_limit(df: DataFrame, limits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row with its stratum's limit: a join with a table of strata whose size Spark knows."""
    named = limits.select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)], "_limit")
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"_l{i}")) for i, k in enumerate(keys)] or F.lit(True)).drop(*[f"_l{i}" for i in range(len(keys))])


def first_rows(df: DataFrame, keys: Sequence[str], id_col: str, seed: str, need: Column, counted: Column | None = None) -> DataFrame:
    """The rows of ``df`` up to the limits of ``digest_limits``: the head of each stratum's seeded order, a little longer than needed."""
    limited = _with_limit(df, digest_limits(df, keys, id_col, seed, need, counted), keys)
    return limited.where(F.substring(_digest(seed, id_col), 1, 6) <= F.col("_limit")).drop("_limit")


def sample_per_stratum(df: DataFrame, stratum: str, id_col: str, k: int, seed: str) -> DataFrame:
    """The first k rows of each stratum in seeded order, for any k: rows beyond the strata's limits are not moved, the others are ranked in buckets."""
    return seeded_rank(first_rows(df, [stratum], id_col, seed, F.lit(k)), [stratum], id_col, seed).where(F.col("rank") <= k).drop("n_group")


def first_per_category(df: DataFrame, category: str, order: str, quotas: Mapping[str, int]) -> DataFrame:
    """The first rows of each category in arrival order (a number), up to its own quota; unlisted categories get none."""
    listed = df.where(F.col(category).isin(*quotas)).withColumn("_one", F.lit(1).cast("bigint"))
    entries = [x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))]
    ranked = value_totals(listed, [category], order, {"rank": "_one"})
    return ranked.where(F.col("rank") <= F.try_element_at(F.create_map(*entries), F.col(category))).drop("_one", "rank_all")


def audited_draw(pool: DataFrame, category: str, id_col: str, accepted: str, k: int, seed: str) -> DataFrame:
    """Walk each category in seeded order until k rows are accepted; return every row looked at.

    Whether a row is accepted does not depend on the others, so "until" is a running count: a row is looked
    at when fewer than k were accepted before it. Rows past position k are replacement draws.
    """
    pool = first_rows(pool, [category], id_col, seed, F.lit(k), F.col(accepted))
    marked = (pool.withColumn("_digest", _digest(seed, id_col)).withColumn("_one", F.lit(1).cast("bigint"))
                  .withColumn("_ok", F.col(accepted).cast("bigint")))
    run = running_totals(marked, [category], ["_digest", id_col], hash_bucket("_digest"), {"rank": "_one", "n_accepted": "_ok"})
    return (run.where(F.col("n_accepted") - F.col("_ok") < k)
               .withColumn("is_replacement", F.col("rank") > k)
               .drop("_digest", "_one", "_ok", "rank_all", "n_accepted_all"))


def fill_to_target(high: DataFrame, low: DataFrame, label: str, id_col: str, target: int, seed: str) -> DataFrame:
    """All of the high-priority rows, then seeded low-priority rows up to ``target`` rows per label."""
    have = high.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_have"))
    need = F.greatest(F.lit(target) - F.coalesce("_have", F.lit(0)), F.lit(0))
    wanted = low.join(cut_lineage(have), F.col(label) == F.col("_label"), "left").withColumn("_need", need).drop("_label", "_have")
    drawn = seeded_rank(first_rows(wanted, [label], id_col, seed, F.col("_need")), [label], id_col, seed).where(F.col("rank") <= F.col("_need"))
    return high.withColumn("filled", F.lit(False)).unionByName(drawn.select(*low.columns, F.lit(True).alias("filled")))


def split_by_shares(df: DataFrame, keys: Sequence[str], id_col: str, seed: str, train: float = 0.70,
                    validation: float = 0.15) -> DataFrame:
    """train/validation/test per stratum: whole-number floors for the first two, the rest to test."""
    r = seeded_rank(df, keys, id_col, seed)
    n = F.col("n_group")
    n_train, n_val = F.floor(n * F.lit(train)), F.floor(n * F.lit(validation))
    name = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "validation").otherwise("test")
    return r.withColumn("split", name).drop("rank", "n_group")


def split_groups(df: DataFrame, group: str, seed: str, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """As split_by_shares, but whole groups (all variants of an original) land in one split."""
    groups = split_by_shares(df.select(group).distinct(), [], group, seed, train, validation)
    return df.join(groups, group)


def split_fixed(df: DataFrame, keys: Sequence[str], id_col: str, seed: str, counts: Sequence[tuple[str, int]],
                rest: str = "unused", held_out: Column | None = None, held_out_name: str = "test_unseen") -> DataFrame:
    """Splits of fixed size per stratum in seeded order; rows with ``held_out`` true go to their own split."""
    out = F.lit(False) if held_out is None else held_out
    seen = df.where(~out)
    limited = _with_limit(seen, digest_limits(seen, keys, id_col, seed, F.lit(sum(n for _, n in counts))), keys)
    head = F.substring(_digest(seed, id_col), 1, 6) <= F.col("_limit")
    upto, chain = 0, None
    for name, n in counts:
        upto += n
        hit = F.col("rank") <= upto
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    placed = seeded_rank(limited.where(head).drop("_limit"), keys, id_col, seed).withColumn("split", chain.otherwise(F.lit(rest))).drop("rank", "n_group")
    placed = placed.unionByName(limited.where(~head).drop("_limit").withColumn("split", F.lit(rest)))  # beyond all splits: not moved
    return placed.unionByName(df.where(out).withColumn("split", F.lit(held_out_name)))


def folds(df: DataFrame, keys: Sequence[str], id_col: str, seed: str, k: int = 5) -> DataFrame:
    """Stratified folds 0..k-1, sizes within one of each other in every stratum."""
    r = seeded_rank(df, keys, id_col, seed)
    return r.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "n_group")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k * n_c) for each of the k labels. The windows run over the k aggregated rows."""
    w = Window.partitionBy()
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))


def sequential_names(df: DataFrame, keys: Sequence[str], id_col: str, existing_max: Column, prefix: str, width: int = 6) -> DataFrame:
    """Number the rows of each group on from ``existing_max`` in id order and build padded names.

    Ids are numbers, dense or sparse; a big group is numbered in parallel.
    """
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    run = value_totals(one, keys, id_col, {"_pos": "_one"})
    number = F.coalesce(existing_max, F.lit(0)) + F.col("_pos")
    return (run.withColumn("number", number.cast("bigint"))
               .withColumn("name", F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0")))
               .drop("_one", "_pos", "_pos_all"))


def manifest(df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    """Rows in the fixed manifest layout; columns not given are NULL strings (sizes NULL longs)."""
    layout = ("sample_id", "ground_truth", "domain", "source", "resolution_type", "split", "sha256", "storage_type", "storage_ref")
    out = [(col(columns[c]) if c in columns else F.lit(None)).cast("string").alias(c) for c in layout]
    size = col(columns["file_size_bytes"]) if "file_size_bytes" in columns else F.lit(None)
    return df.select(*out, size.cast("bigint").alias("file_size_bytes"))


def split_summary(df: DataFrame, split: str, label: str) -> DataFrame:
    """Counts per split and label with subtotals ("all")."""
    g = df.rollup(split, label).agg(F.count("*").alias("n"))
    return g.select(F.coalesce(F.col(split).cast("string"), F.lit("all")).alias("split"),
                    F.coalesce(F.col(label).cast("string"), F.lit("all")).alias("label"), "n")
