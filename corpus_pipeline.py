"""From raw documents to packed training sequences: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, linededup, minhash, mixing, packing
from plumbline.llm.common import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: without text or without a letter they go. The score drops none, since texts in several languages have a low one."""
    net = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    named = langid.identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("text")), net)
    return named.where(F.col("lang_pred") != langid.UNKNOWN).select("d.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents share; n_chars follows the text."""
    kept = linededup.dedup_lines(docs, min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose five-word shingles are at least 80 % alike: the one with the smallest id. Texts without words stay."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources takes them: not at all, once or twice."""
    return mixing.take_mixture(docs, weights=(3, 1, 2), ratio=1.5, cap=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in bins of 2,048 words."""
    return packing.pack(docs, capacity=2048, per_source=4)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Language ID is learned, which SQL cannot express; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
