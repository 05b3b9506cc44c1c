"""Removal of lines that many documents share (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BLANKS, lower_ascii, stage


def _key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _pair(value: Column) -> Column:
    """Two independent 64-bit hashes: 128 bits, so that different lines of a very large corpus do not meet."""
    return F.struct(F.xxhash64(value).alias("h1"), F.xxhash64(F.lit("line"), value).alias("h2"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with shared lines taken out of ``text_col``, and ``n_lines``, ``n_dropped``.

    A text is split at line feeds. A line's key is the line without ASCII white space at both ends and with A-Z
    lower-cased. Keys of at least ``min_chars`` code points that occur in at least ``min_docs`` documents lose all
    their lines everywhere; the others stay in order, joined by line feeds.

    Rows that repeat an id are one document, counted once for a line; a row without id is a document of its own. Null and empty texts are one empty line (the text
    becomes empty). Empty keys are never dropped when ``min_chars`` is 1 or more. A text that loses every line becomes
    empty. Existing columns named ``n_lines`` or ``n_dropped`` are replaced. An empty table gives no rows.

    Lines are first reduced to one row for each document, then counted by a sum that is combined before its shuffle, so a line found in a
    third of all texts is spread by document and then one row per task. Texts travel once, to meet the positions of their dropped lines; hashes do the rest.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.drop("n_lines", "n_dropped")
    row = docs.select(F.struct(F.xxhash64(F.col(id_col), text).alias("r1"), F.xxhash64(F.lit("row"), F.col(id_col), text).alias("r2")).alias("row"), F.transform(F.split(text, "\n", -1), _key).alias("keys"))
    long_enough = F.length("key") >= min_chars
    keys = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.transform(F.split(text, "\n", -1), _key))).alias("key")).where(long_enough)
    by_document = keys.select("id", _pair(F.col("key")).alias("k")).groupBy("k.h1", "k.h2", "id").agg(F.count("*").alias("rows"))
    counted = by_document.groupBy("h1", "h2").agg(F.sum(F.when(F.col("id").isNull(), F.col("rows")).otherwise(1)).alias("count"))
    shared = stage(counted.where(F.col("count") >= min_docs).select("h1", "h2"), "shared_lines")
    places = row.select("row", F.posexplode("keys").alias("pos", "key")).where(long_enough).select("row", "pos", _pair(F.col("key")).alias("k")).select("row", "pos", "k.h1", "k.h2")
    drops = places.join(shared, ["h1", "h2"]).groupBy("row.r1", "row.r2").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    d = named.select(F.struct(*[F.col(f"`{c}`") for c in named.columns]).alias("d"), F.xxhash64(F.col(id_col), text).alias("r1"), F.xxhash64(F.lit("row"), F.col(id_col), text).alias("r2"))
    found = d.join(drops, ["r1", "r2"], "left").withColumn("lines", F.split(F.coalesce(F.col(f"d.`{text_col}`"), F.lit("")), "\n", -1))
    n, m = F.size("lines"), F.size("drop")

    def run(i: Column) -> Column:
        """The lines between one dropped position and the next."""
        start = F.when(i == 0, 0).otherwise(F.get("drop", i - 1) + 1)
        end = F.when(i == m, n).otherwise(F.get("drop", i))
        return F.slice("lines", start + 1, end - start)

    kept = F.when(F.col("drop").isNull(), F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))).otherwise(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), m), run)), "\n"))
    columns = [(kept.alias(c) if c == text_col else F.col(f"d.`{c}`").alias(c)) for c in named.columns]
    return found.select(*columns, n.cast("bigint").alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(m).cast("bigint").alias("n_dropped"))
