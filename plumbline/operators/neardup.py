"""Near-duplicate search on bit fingerprints within a Hamming distance.

The 64 bits are cut into ``blocks`` parts. Two patterns at distance <= d differ in at most d parts, so they
agree on all the others: for every choice of (blocks - d) parts, the pattern masked to those parts is a
join key. No pair within d is missed, and with blocks > d + 1 a key is long, so few unrelated patterns
meet. Keys that still gather many patterns are refined: their members agree on the kept parts, so the
same argument is applied once more to the remaining bits, and where even that gathers many, a last time with single
bits as parts, after which no more than 2**d patterns share a key.

Rows are reduced to distinct fingerprints first. A fingerprint carried by a third of all rows is one row
here, and what leaves is at fingerprint level (with member counts): all pairs of different fingerprints on request,
or one link for each fingerprint.

The nearest reference without a bound (``nearest_of_all``) is found by a radius that grows: see there.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fingerprint import hamming
from plumbline.session import cut_lineage

BITS = 64
#: Bits of a reference's place in the order of references; the distance, 64 at most, stands above them.
PLACE_BITS = 56


def _parts(positions: list[int], n: int) -> list[list[int]]:
    size, extra = divmod(len(positions), n)
    out, at = [], 0
    for i in range(n):
        width = size + (1 if i < extra else 0)
        out.append(positions[at:at + width])
        at += width
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= (1 << 63) else mask


def masks(positions: list[int], distance: int, blocks: int) -> list[int]:
    """Bit masks, one per choice of (blocks - distance) parts."""
    parts = _parts(positions, blocks)
    return [_signed(sum(1 << p for part in keep for p in part)) for keep in combinations(parts, blocks - distance)]


def distinct_fingerprints(df: DataFrame, fp: str, id_col: str, extra: list[Column] | None = None) -> DataFrame:
    """One row per fingerprint: members, first id. Failed (NULL) fingerprints never match anything."""
    return df.groupBy(F.col(fp).alias("fp")).agg(
        F.count(fp).alias("members"), F.min(id_col).alias("first_id"), *(extra or [])).where(F.col("members") > 0)


def _keyed(df: DataFrame, distance: int, blocks: int) -> DataFrame:
    entries = [F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
               for i, m in enumerate(masks(list(range(BITS)), distance, blocks))]
    return df.select("*", F.explode(F.array(*entries)).alias("_k")).select(*df.columns, "_k.choice", "_k.key")


def _refine(keyed: DataFrame, hot: DataFrame, distance: int, blocks: int, sub_blocks: int) -> DataFrame:
    """Add (sub, sub_key): 0 for cold keys; for hot keys one row per choice on the bits outside the key."""
    marked = keyed.join(hot, ["choice", "key"], "left")
    parts = _parts(list(range(BITS)), blocks)
    by_choice = []
    for keep in combinations(range(blocks), blocks - distance):
        rest = [p for i, part in enumerate(parts) if i not in keep for p in part]
        by_choice.append(F.array(*[F.lit(m).cast("bigint") for m in masks(rest, distance, sub_blocks)]))
    pick = F.element_at(F.array(*by_choice), F.col("choice") + 1)
    refined = F.transform(pick, lambda m, j: F.struct((j + 1).alias("sub"), F.col("fp").bitwiseAND(m).alias("sub_key")))
    none = F.array(F.struct(F.lit(0).alias("sub"), F.lit(0).cast("bigint").alias("sub_key")))
    entries = F.when(F.coalesce("is_hot", F.lit(False)), refined).otherwise(none)
    return marked.select(*keyed.columns, F.explode(entries).alias("_s")).select(*keyed.columns, "_s.sub", "_s.sub_key")


def _to_the_last_bit(refined: DataFrame, hot: DataFrame, distance: int, blocks: int, sub_blocks: int) -> DataFrame:
    """Add (out, deep_key): 0 for cold keys; for hot ones a row for each way to leave out ``distance`` of the bits outside of both keys, and the other bits."""
    rest = []
    for keep in combinations(range(blocks), blocks - distance):
        outside = [p for i, part in enumerate(_parts(list(range(BITS)), blocks)) if i not in keep for p in part]
        rest += [[p for i, part in enumerate(_parts(outside, sub_blocks)) if i not in sub for p in part] for sub in combinations(range(sub_blocks), sub_blocks - distance)]
    subs = len(rest) // comb(blocks, distance)
    # Positions of one key as text of fixed width: a plain literal for each pair of choices, whatever the number of bit masks.
    texts = F.array(*[F.lit(",".join(map(str, r))) for r in rest])
    marked = refined.join(hot, ["choice", "key", "sub", "sub_key"], "left").withColumn("_hot", F.coalesce("is_hot", F.lit(False)))
    at = F.get(texts, F.col("choice") * subs + F.col("sub") - 1)
    rows = marked.select(*refined.columns, "_hot", F.when(F.col("_hot"), F.transform(F.split(at, ","), lambda p: p.cast("int"))).otherwise(F.array(F.lit(0))).alias("_bits"), F.lit(0).cast("bigint").alias("out"), F.lit(-1).alias("_last"))
    for _ in range(distance):  # one more bit left out, beyond those before it
        following = F.when(F.col("_hot"), F.sequence(F.col("_last") + 1, F.greatest(F.size("_bits") - 1, F.col("_last") + 1))).otherwise(F.array(F.lit(0)))
        rows = rows.select(*refined.columns, "_hot", "_bits", "out", F.explode(following).alias("_last")).where(~F.col("_hot") | (F.col("_last") < F.size("_bits")))
        rows = rows.withColumn("out", F.when(F.col("_hot"), F.col("out").bitwiseOR(F.expr("shiftleft(1L, get(_bits, _last))"))).otherwise(F.col("out")))
    return rows.select(*refined.columns, "out", F.when(F.col("_hot"), F.col("fp").bitwiseAND(F.bitwise_not("out"))).otherwise(F.lit(0).cast("bigint")).alias("deep_key"))


def candidate_keys(left: DataFrame, right: DataFrame, distance: int, blocks: int, hot_key: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Keyed fingerprints of both sides and the columns to join them on.

    Keys that gather more than ``hot_key`` patterns on either side are staged first, as a table whose size Spark
    knows: the join that marks them is a broadcast unless there are very many. The plan is the same for any data.
    """
    kl, kr = _keyed(left, distance, blocks), _keyed(right, distance, blocks)

    def hot(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        full = lambda k: k.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_key)
        return cut_lineage(full(a).unionByName(full(b)).select(*on, F.lit(True).alias("is_hot")).distinct())

    on = ["choice", "key"]
    first = hot(kl, kr, on)
    kl, kr = (_refine(k, first, distance, blocks, distance + 2) for k in (kl, kr))
    on += ["sub", "sub_key"]
    second = hot(kl.where("sub > 0"), kr.where("sub > 0"), on)
    return (*(_to_the_last_bit(k, second, distance, blocks, distance + 2) for k in (kl, kr)), [*on, "out", "deep_key"])


def within_distance(left: DataFrame, right: DataFrame, distance: int, blocks: int | None = None,
                    hot_key: int = 10_000) -> DataFrame:
    """All (fp_left, fp_right, distance) with Hamming distance <= ``distance``.

    Both inputs need a column ``fp`` of distinct fingerprints. ``blocks`` trades replicas, C(blocks, d) per
    fingerprint, for key length, 64 * (blocks - d) / blocks bits: the default d + 2 gives 25 bits at d = 3 and 18 at d = 5, so
    about 3 and 380 candidates a key among 10^8 fingerprints; d + 3 gives 32 and 24. Above distance 7 the keys are too short to select anything.
    """
    if distance > 7:
        raise ValueError("a distance above 7 of 64 bits cannot be searched by keys")
    # A pair may agree on several choices; the distinct runs after the distance filter.
    return _met(left, right, distance, blocks, hot_key).distinct()


def _met(left: DataFrame, right: DataFrame, distance: int, blocks: int | None = None, hot_key: int = 10_000) -> DataFrame:
    """(fp_left, fp_right, distance) of all pairs within the distance, each once or more."""
    kl, kr, on = candidate_keys(left.select("fp"), right.select("fp"), distance, blocks or distance + 2, hot_key)
    met = kl.withColumnRenamed("fp", "fp_left").join(kr.withColumnRenamed("fp", "fp_right"), on, "inner")
    d = hamming("fp_left", "fp_right")
    return met.where(d <= distance).select("fp_left", "fp_right", d.cast("int").alias("distance"))


def nearest_links(candidates: DataFrame, references: DataFrame, distance: int, **how) -> DataFrame:
    """(fp, ref_fp, distance): for every candidate fingerprint with a reference within the distance one link, to the nearest one (ties: the
    smallest pattern). Pairs are reduced to it where they are found, so rows moved and returned follow the candidates, however dense the references lie."""
    best = F.min(F.struct("distance", "fp_right"))
    return _met(candidates, references, distance, **how).groupBy(F.col("fp_left").alias("fp")).agg(best.alias("_b")).select("fp", F.col("_b.fp_right").alias("ref_fp"), F.col("_b.distance").alias("distance"))


def representative_links(df: DataFrame, distance: int, order: str = "first_id", **how) -> DataFrame:
    """(fp, rep_fp, distance) for every fingerprint that has another one within the distance before it in the order of (``order``, fp): the link
    to the first of those. A cluster of m fingerprints gives fewer than m rows, whatever the number of its pairs; a fingerprint without a row is the first
    of its neighbourhood."""
    # The place in the order travels as part of the pattern's own row and is met again by an equi-join on the pattern.
    met = _met(df, df, distance, **how).where("fp_left <> fp_right")
    place = lambda c, n: df.select(F.col("fp").alias(c), F.struct(F.col(order).alias("o"), F.col("fp").alias("f")).alias(n))
    ordered = met.join(place("fp_right", "_r"), "fp_right").groupBy("fp_left").agg(F.min(F.struct("_r", "distance")).alias("_b"))
    linked = ordered.join(place("fp_left", "_l"), "fp_left").where(F.col("_b._r") < F.col("_l"))
    return linked.select(F.col("fp_left").alias("fp"), F.col("_b._r.f").alias("rep_fp"), F.col("_b.distance").alias("distance"))


def near_pairs(df: DataFrame, distance: int, **how) -> DataFrame:
    """Unordered pairs of different fingerprints within the distance, in one set."""
    return within_distance(df, df, distance, **how).where(F.col("fp_left") < F.col("fp_right"))


def nearest_reference(candidates: DataFrame, references: DataFrame, distance: int, **how) -> DataFrame:
    """For each candidate fingerprint the nearest reference within the distance (ties: lowest ``ref_order``).

    ``references`` has fp, ref_order and ref_id. Candidates with nothing within the distance are not returned.
    """
    pairs = within_distance(candidates, references, distance, **how)
    named = pairs.join(references.select(F.col("fp").alias("fp_right"), "ref_order", "ref_id"), "fp_right")
    best = F.min(F.struct("distance", "ref_order", "ref_id"))
    return named.groupBy(F.col("fp_left").alias("fp")).agg(best.alias("_b")).select(
        "fp", F.col("_b.distance").alias("distance"), F.col("_b.ref_id").alias("ref_id"))


def nearest_of_all(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """(fp, distance, ref_id): for each candidate fingerprint the nearest reference at any distance (ties: lowest ``ref_order``, then
    ``ref_id``). ``references`` has fp, ref_order and ref_id, ``candidates`` distinct fp; without any reference there are no rows.

    The 64 bits are cut into m parts of about log2(number of references) bits. If two patterns differ in less than m (s + 1) bits, some part
    differs in at most s. So round s looks up, for every part, all values that differ from the candidate's in exactly s bits; after it every
    reference nearer than m (s + 1) has been met, and candidates whose best lies below that leave the search, ties being complete. Near ones leave
    in the first round, of m look-ups, and only those without any near reference go on. Each round is an equi-join on (part, value) whose finds are
    reduced to one row a candidate before the shuffle: a find is one number, its distance above the place of its reference, whose minimum is kept by
    hashing, without a sort of all finds. In all rounds together a candidate looks up every value of every part at most once, about
    m times the references.
    """
    first = references.groupBy("fp").agg(F.min(F.struct("ref_order", "ref_id")).alias("ref"))
    # Numbers that rise with the order of the references, though not by one.
    refs = cut_lineage(first.orderBy("ref").select("fp", "ref", F.monotonically_increasing_id().alias("place")))
    n = refs.count()
    cands = cut_lineage(candidates.select("fp").distinct())
    parts = _parts(list(range(BITS)), ceil(BITS / max(8, min(24, ceil(log2(max(n, 2)))))))
    m = len(parts)

    def split(df: DataFrame) -> DataFrame:
        values = [F.struct(F.lit(i).alias("part"), F.shiftrightunsigned("fp", p[0]).bitwiseAND(F.lit((1 << len(p)) - 1)).alias("value"), F.lit(len(p)).alias("width")) for i, p in enumerate(parts)]
        return df.select("*", F.explode(F.array(*values)).alias("_p")).select(*df.columns, "_p.*")

    index = cut_lineage(split(refs).select("part", "value", F.col("fp").alias("ref_fp"), "place"))
    best = cands.select("fp", F.lit(None).cast("bigint").alias("find"))
    distance = F.shiftright("find", PLACE_BITS).cast("int")
    done = None
    for s in range(max(len(p) for p in parts) + 1):
        probes = split(best.select("fp")).withColumn("_last", F.lit(-1))
        for _ in range(s):  # one more bit turned over, above those before it
            probes = probes.where(F.col("_last") + 1 < F.col("width")).withColumn("_last", F.explode(F.sequence(F.col("_last") + 1, F.col("width") - 1)))
            probes = probes.withColumn("value", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, _last)")))
        met = probes.join(index, ["part", "value"]).select("fp", F.shiftleft(hamming("fp", "ref_fp").cast("bigint"), PLACE_BITS).bitwiseOR(F.col("place")).alias("find"))
        found = best.where("find is not null").unionByName(met).groupBy("fp").agg(F.min("find").alias("find"))
        best = cut_lineage(best.select("fp").join(found, "fp", "left"))
        settled = best.where(distance < m * (s + 1))
        done = settled if done is None else done.unionByName(settled)
        best = best.where(F.col("find").isNull() | (distance >= m * (s + 1)))
        if best.isEmpty():
            break
    found = done.unionByName(best.where("find is not null")).select("fp", distance.alias("distance"), F.col("find").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place"))
    return found.join(refs.select("place", F.col("ref.ref_id").alias("ref_id")), "place").select("fp", "distance", "ref_id")
