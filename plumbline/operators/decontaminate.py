"""Exact duplicate removal, blacklists, leak filters, cross-split overlap.

Keys that repeat (one text may be a third of a corpus) are always collapsed by a partial aggregation
before they are shuffled for a window or a join. No join is hinted: which side is broadcast is left to the
size Spark measures.

NULL keys are dropped by counting them after the aggregation, and joins to key sets are null-safe: a plain
``key IS NOT NULL`` would be pushed down to the scan and hash every text a second time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str, order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order`` (source priority, then id), with the number of copies.

    Only the order columns and ``carry`` travel; large payload columns should be joined back by id.
    """
    first = F.min_by(F.struct(*carry), F.struct(*order))
    return (df.groupBy(key).agg(first.alias("_first"), F.count("*").alias("copies"))
              .select(key, *[F.col(f"_first.{c}").alias(c) for c in carry], "copies"))


def blacklist(members: DataFrame, key: str, name: str, origin: str = "origin") -> DataFrame:
    """Per key how many members of evaluation sets carry it, the set names, and the first member, from one table of all sets' members
    with the set's name in ``origin``. The sets are few, so the collected names are."""
    m = members.select(F.col(key), F.col(name).cast("string").alias("member"), F.col(origin).alias("origin"))
    return m.groupBy(key).agg(
        F.count(key).alias("n_members"),
        F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"),
        F.min(F.struct("origin", "member")).alias("_first"),
    ).where(F.col("n_members") > 0).select(key, "n_members", "origins", F.col("_first.origin").alias("first_origin"), F.col("_first.member").alias("first_member"))


def _key_join(df: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Null-safe join to a key set that holds no NULL."""
    right = keys.withColumnRenamed(key, "_key")
    return df.join(right, df[key].eqNullSafe(right["_key"]), how)


def without(df: DataFrame, banned: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not banned (a NULL key is kept: a failed fingerprint proves nothing)."""
    return _key_join(df, banned.select(key), key, "left_anti")


def collisions(df: DataFrame, banned: DataFrame, key: str) -> DataFrame:
    """Rows whose key is banned, with the blacklist columns."""
    return _key_join(df, banned, key, "inner").drop("_key")


def first_failing_key(df: DataFrame, checks: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """Attribute each row to the first check it fails.

    ``checks`` are (reason, key column of df, known keys with that column), in order; the known keys are
    made distinct here. Adds ``exclude_reason``, NULL for rows that pass.
    """
    out, reason = df, None
    for i, (label, key, known) in enumerate(checks):
        flag = f"_hit{i}"
        keys = known.groupBy(key).agg((F.count(key) > 0).alias(flag)).where(flag)
        out = _key_join(out, keys, key, "left").drop("_key")
        hit = F.col(flag).isNotNull()
        reason = F.when(hit, label) if reason is None else reason.when(hit, label)
    return out.withColumn("exclude_reason", reason).drop(*[f"_hit{i}" for i in range(len(checks))])


def cross_split_overlap(df: DataFrame, key: str, split: str) -> DataFrame:
    """Number of keys shared by each pair of the splits that occur, in order of their names as text, pairs without a shared key too.

    Per key the set of its splits is gathered, which is as small as the number of splits; its pairs are counted. The list of all
    pairs comes from one row per split.
    """
    name = F.col(split).cast("string")
    seen = df.where(name.isNotNull())

    def pairs(names: Column) -> Column:
        return F.flatten(F.transform(names, lambda a: F.transform(F.filter(names, lambda b: a < b), lambda b: F.struct(a.alias("left_split"), b.alias("right_split")))))

    per_key = seen.groupBy(key).agg(F.collect_set(name).alias("_s"), F.count(key).alias("_n")).where((F.col("_n") > 0) & (F.size("_s") > 1))
    shared = per_key.select(F.explode(pairs(F.col("_s"))).alias("p")).groupBy("p.left_split", "p.right_split").agg(F.count("*").alias("shared_keys"))
    every = seen.select(name.alias("s")).distinct().agg(F.collect_set("s").alias("_s")).select(F.explode(pairs(F.col("_s"))).alias("p")).select("p.*")
    return every.join(shared, ["left_split", "right_split"], "left").select("left_split", "right_split", F.coalesce("shared_keys", F.lit(0)).alias("shared_keys"))


def duplicate_groups(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Keys with more than one row: copies, first-seen id, last-seen id."""
    return (df.groupBy(key).agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))
              .where(F.col("copies") > 1))


def audit_decision(df: DataFrame, exact: Column, distance: Column, origin: Column, member: Column,
                   shared_origins: Sequence[str], max_distance: int = 3) -> DataFrame:
    """ACCEPT/REJECT with a reason. An exact match is reported before a near one; a near match in an origin
    known to share source material is named as overlap, any other as suspicious; both are rejected."""
    near = F.coalesce(distance <= max_distance, F.lit(False))
    where = F.concat(F.lit("(d="), distance.cast("string"), F.lit(") with "), origin, F.lit(":"), member)
    reason = (
        F.when(exact, F.lit("EXACT_SHA256_COLLISION"))
        .when(near & origin.isin(*shared_origins), F.concat(F.lit("NEAR_DUPLICATE_SOURCE_OVERLAP "), where))
        .when(near, F.concat(F.lit("SUSPICIOUS_NEAR_DUPLICATE "), where))
        .otherwise(F.lit("Clean"))
    )
    return df.withColumn("audit_action", F.when(exact | near, "REJECT").otherwise("ACCEPT")).withColumn("reason", reason)


def compare_reported(reported: DataFrame, recomputed: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Full outer comparison of two (keys, value) tables. PASS needs exactly one match on each side within
    the tolerance; anything else is FAIL and says why."""
    def packed(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(f"n_{side}"), F.max("value").alias(side))
    both = packed(reported, "reported").join(packed(recomputed, "recomputed"), list(keys), "full_outer")
    n_rep, n_rec = (F.coalesce(F.col(f"n_{s}"), F.lit(0)) for s in ("reported", "recomputed"))
    diff = F.abs(F.col("reported") - F.col("recomputed"))
    note = (F.when(n_rep == 0, "not reported").when(n_rec == 0, "not recomputed")
             .when((n_rep > 1) | (n_rec > 1), "ambiguous").when(diff <= F.lit(tolerance), "within tolerance")
             .otherwise("differs"))
    return both.select(*keys, "reported", "recomputed", diff.alias("difference"), note.alias("note"),
                       F.when(note == "within tolerance", "PASS").otherwise("FAIL").alias("status"))


def values_long(df: DataFrame, keys: Sequence[str], names: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """Wide metric columns to (keys, metric, value) rows."""
    cols = names if isinstance(names, Mapping) else {n: F.col(n) for n in names}
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in cols.items()])
    return df.select(*keys, F.explode(entries).alias("_m")).select(*keys, "_m.metric", "_m.value")
