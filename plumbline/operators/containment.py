"""Which documents contain a benchmark passage word for word.

A passage of three words or more has runs of whole words in its inside (its first and last word may be cut from a longer word in a
document), of ``width`` words or of all inner ones if they are fewer. A shorter one has its first characters, up to ``gram``, since it may lie anywhere in a
word. A document that contains the passage contains all its runs or those characters.

All runs of all passages are put into one bitmap. A document's runs are held against it where the document is read, and only what meets it goes
on: what is moved follows the hits, not the corpus. The hits are staged, ids and hashes without texts, and give the true document frequency of every run; each passage is
then looked up by its rarest run alone, so a passage full of words that every document has is still paired with few documents. The
substring test confirms, on the texts of these candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

WORD_BREAK = r"\s+"
#: Bits of the bitmap for each run, and the most words of 64 bits it has. With more runs than that it lets more through; what is found stays the same.
BITS_PER_RUN, MAX_BITMAP_WORDS = 32, 1 << 20


def _words(text: str | Column) -> Column:
    return F.split(F.col(text) if isinstance(text, str) else text, WORD_BREAK)


def _runs(items: Column, width: int, kind: str) -> Column:
    """Hashes of all runs of ``width`` items; none where there are fewer.

    Items are hashed once, and a run from the hashes of its items. Arrays are bound as variables of outer one-element
    transforms: named inside a lambda directly, they would be made from the text again for every run.
    """
    def of(hashes: Column) -> Column:
        starts = F.when(F.size(hashes) >= width, F.sequence(F.lit(0), F.size(hashes) - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(kind), *[F.get(hashes, i + j) for j in range(width)]))
    hashed = F.transform(items, lambda w: F.xxhash64(w))
    return F.element_at(F.transform(F.array(hashed), of), 1)


def _passage_runs(distinct: DataFrame, width: int, gram: int) -> DataFrame:
    """(key, kind, width, pos, run): the inner runs of every passage; of passages of one or two words the first characters."""
    n = F.size(_words("passage"))
    inner = F.slice(_words("passage"), 2, n - 2)
    long = distinct.where(n >= 3)
    parts = [long.where(n - 2 >= width).select("key", F.lit("words").alias("kind"), F.lit(width).alias("width"), F.posexplode(_runs(inner, width, "words")).alias("pos", "run"))]
    parts += [long.where(n - 2 == w).select("key", F.lit("words").alias("kind"), F.lit(w).alias("width"), F.posexplode(_runs(inner, w, "words")).alias("pos", "run")) for w in range(1, width)]
    size = F.length("passage")
    for g in range(1, gram + 1):
        some = distinct.where((n < 3) & (size >= g if g == gram else size == g))
        parts.append(some.select("key", F.lit("letters").alias("kind"), F.lit(g).alias("width"), F.posexplode(_runs(F.slice(F.split("passage", ""), 1, g), g, "letters")).alias("pos", "run")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _slot(run: Column, words: int) -> Column:
    return F.shiftrightunsigned(run, 6).bitwiseAND(F.lit(words - 1)).cast("int")


def _bitmap(runs: DataFrame, words: int) -> DataFrame:
    """One row with an array of ``words`` numbers in which the bits of all runs are set. Its size is fixed by the number of runs and bounded."""
    bit = F.expr("shiftleft(1L, cast(run & 63 as int))")
    cells = runs.groupBy(_slot(F.col("run"), words).cast("bigint").alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = runs.sparkSession.range(words).join(cells, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bitmap"))


def contained_passages(docs: DataFrame, doc_id: str, text: str, passages: DataFrame, item: str, passage: str,
                       width: int = 6, gram: int = 6) -> DataFrame:
    """(doc_id, item_id) for every passage, of any length, found verbatim in a document.

    Equal passages are searched for once. NULL passages are found nowhere; an empty passage, which every text contains, is an error.
    """
    items = passages.select(F.col(item).alias("item_id"), F.col(passage).alias("passage"))
    empty = F.assert_true(F.col("passage") != "", F.lit("an empty passage"))
    distinct = items.where(F.col("passage").isNotNull() & empty.isNull()).groupBy("passage").agg(F.min("item_id").alias("key"))
    runs = cut_lineage(_passage_runs(distinct, width, gram))
    used = [(r.kind, r.width, r.n) for r in runs.groupBy("kind", "width").agg(F.count_distinct("run").alias("n")).orderBy("kind", "width").collect()]  # width + gram rows at most
    words = min(MAX_BITMAP_WORDS, 1 << max(4, (sum(n for _, _, n in used) * BITS_PER_RUN // 64).bit_length()))
    bitmap = _bitmap(runs, words).scalar()
    asked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    found = [_runs(_words("_text") if kind == "words" else F.split("_text", ""), w, kind) for kind, w, _ in used] or [F.array().cast("array<bigint>")]
    met = F.filter(F.concat(*found), lambda r: F.call_function("shiftrightunsigned", F.get(F.col("_map"), _slot(r, words)), r.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    hits = asked.withColumn("_map", bitmap).select("doc_id", F.array_distinct(met).alias("runs")).where(F.size("runs") > 0)
    hits = cut_lineage(hits.select("doc_id", F.explode("runs").alias("run")))
    # The rarest run of each passage, the earliest of several. A run that no document has leaves its passage out.
    frequency = hits.groupBy("run").agg(F.count("*").alias("in_docs"))
    rarest = runs.join(frequency, "run", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("in_docs", F.lit(0)).alias("in_docs"), "pos", "run")).alias("r"))
    candidates = hits.join(rarest.where("r.in_docs > 0").select("key", F.col("r.run").alias("run")), "run").select("doc_id", "key").distinct()
    confirmed = (candidates.join(distinct, "key")
                 .join(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "doc_id")
                 .where(F.contains("_text", "passage")).select("doc_id", "passage"))
    return confirmed.join(items, "passage").select("doc_id", "item_id")
