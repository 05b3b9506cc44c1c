"""Mixing sources to target weights by hash-threshold histograms (native: DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import n_words, stage

#: The hash has 60 bits; every histogram level splits a bucket into 2**12.
LEVEL_BITS, SHIFTS = 12, (48, 36, 24, 12, 0)
#: Targets are solved over a table with one row per source; more sources than this raise an error.
MAX_SOURCES = 1_000_000


def _hash(doc_id: Column, text: Column) -> Column:
    """60 bits of md5 over id and text: even, and the same in any engine."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One narrow row per document: id, source, size in words, hash."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text).alias("size"), _hash(F.col(id_col), text).alias("h"))


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, get ``weights`` in turn and share ``ratio`` times all words; no target
    exceeds ``cap`` times its source, and what is cut off is shared again by weight among the others.
    Solved in closed form: in the order of cap / weight, all sources before some point are capped and the rest get
    weight x one level.
    """
    if not 0 <= ratio <= cap or min(weights) <= 0:
        raise ValueError("the share must lie between 0 and the cap, and weights be positive")
    # One row per source on one task here: a dimension, not data; its bound is checked.
    ranked = sizes.withColumn("rn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    bound = F.assert_true(F.col("rn") <= MAX_SOURCES, F.lit(f"more than {MAX_SOURCES} sources"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    caps = ranked.where(bound.isNull()).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rn")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(ratio)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    leveled = caps.withColumn("level", level)
    level = F.min_by(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")), F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("rn")))).over(every)
    solved = leveled.withColumn("at", level)
    return solved.select("source", "source_size", F.least(F.coalesce(F.col("at") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def _boundary(hist: DataFrame) -> DataFrame:
    """Of (source, bucket, words, rest): the first bucket whose running total passes ``rest``, and what of rest is left before it.
    At most 2**12 buckets a source stand in one window."""
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    passed = hist.withColumn("upto", upto).where("upto > rest")
    first = passed.groupBy("source").agg(F.min_by(F.struct("bucket", "words", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("left")), "bucket").alias("x"))
    return first.select("source", F.col("x.bucket").alias("prefix"), F.col("x.words").alias("words"), F.col("x.left").alias("rest"))


def thresholds(measured: DataFrame, weights: Sequence[float] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, base, cut): a document of the source is taken ``base`` times, and once more if its hash is at most ``cut``.

    ``measured`` is read twice, so it should be a staged table. Words are summed by source and hash bucket; only the
    bucket in which a source's budget ends is refined, twelve bits at a time. Nothing is sorted by document.
    """
    hist = stage(measured.groupBy("source", F.shiftright("h", SHIFTS[0]).alias("bucket")).agg(F.sum("size").alias("words")), "histogram")
    aims = targets(hist.groupBy("source").agg(F.sum("words").alias("source_size")), weights, ratio, cap)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    aims = stage(aims.withColumn("base", base).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")), "targets")
    # Where whole copies meet the target nothing is left to cut: no document, one without words included, is taken once more.
    at = _boundary(hist.alias("h").join(aims.where("rest > 0").alias("t"), F.col("h.source").eqNullSafe(F.col("t.source"))).select("h.source", "bucket", "words", "rest"))
    for last, shift in zip(SHIFTS, SHIFTS[1:], strict=False):
        inside = measured.alias("m").join(at.alias("a"), F.col("m.source").eqNullSafe(F.col("a.source")) & (F.shiftright("m.h", last) == F.col("a.prefix")))
        if last == SHIFTS[0]:  # a 4096th of the rows; finer levels read only these
            measured = stage(inside.select("m.source", "m.h", "m.size"), "boundary")
            inside = measured.alias("m").join(at.alias("a"), F.col("m.source").eqNullSafe(F.col("a.source")))
        at = _boundary(inside.groupBy("m.source", F.shiftright("m.h", shift).alias("bucket"), F.col("a.rest").alias("rest")).agg(F.sum("m.size").alias("words")))
    cut = at.select("source", F.when(F.col("rest") * 2 >= F.col("words"), F.col("prefix")).otherwise(F.col("prefix") - 1).alias("cut"))
    found = aims.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    return stage(found.select("t.source", "source_size", "target", "base", F.coalesce("cut", F.lit(-1)).alias("cut")), "thresholds")


def _copies(h: Column, t: str = "t") -> Column:
    return F.col(f"{t}.base") + F.when(h <= F.col(f"{t}.cut"), 1).otherwise(0)


def mixture(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target (its source's), copies, taken = copies x size.

    Whole documents are taken, none more than ``ceil(cap)`` times. A source misses its target by at most half of the
    document at its threshold (rows equal in id and text share a hash and are taken together). Null text and text without words
    have size 0 and are taken like the others of their source, by their hash; null is a source of its own, the last; a source without any words has target 0 and
    none of its documents is taken; an empty table gives no rows. Null or repeated ids are separate rows. Other columns are ignored.
    """
    measured = stage(measure(docs), "sizes")
    cuts = thresholds(measured, weights, ratio, cap)
    joined = measured.alias("m").join(cuts.alias("t"), F.col("m.source").eqNullSafe(F.col("t.source")))
    copies = _copies(F.col("m.h"))
    return joined.select(F.col("m.id").alias("doc_id"), "m.size", "m.source", "t.source_size", "t.target", copies.alias("copies"), (copies * F.col("m.size")).alias("taken"))


def take_mixture(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mixed corpus itself: the columns of ``docs``, each row as often as ``mixture`` takes it."""
    cuts = thresholds(stage(measure(docs), "sizes"), weights, ratio, cap)
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("d")) if names else docs
    joined = d.join(cuts.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    counted = joined.withColumn("copies", _copies(_hash(F.col("d.doc_id"), F.col("d.text")))).where("copies > 0")
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("d.*")
