"""Toxicity by a factorization machine over hashed terms, trained in numpy.

A text's terms are its words and the four-byte pieces of its words, each counted once. Besides a weight, every term has a short vector; the
score adds the products of the vectors of all pairs of terms, so an insult that means little alone and much beside the mention of a group
is learned as such, which a sum of weights cannot do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, stage
from plumbline.llm.shingles import word_hashes

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = np.zeros(256, dtype=bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Settings:
    """``max_docs`` bounds the labelled documents that the fit reads, about half of each label; ``max_terms`` the terms that get a weight: those
    whose share among toxic and other documents of the sample differs most, by at least ``min_z`` standard errors. ``steps`` batches are read, however few
    documents there are."""

    max_docs: int = 6000
    max_terms: int = 4096
    min_z: float = 4.5
    bits: int = 20
    factors: int = 8
    steps: int = 2000
    batch: int = 64
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 11


def term_numbers(text: str, bits: int) -> np.ndarray:
    """Hashes below 2**bits of a text's words and of the four-byte pieces of its words, where a word begins and ends with a blank. Repeats stay."""
    low = text.lower()
    raw = np.frombuffer(f" {low} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)
    blank = _BLANKS[raw]
    byte = np.where(blank, np.uint8(32), raw).astype(np.uint64)
    shift = np.uint64(64 - bits)
    pieces = np.empty(0, dtype=np.uint64)
    if raw.size >= 4:
        code = (byte[:-3] << np.uint64(24)) | (byte[1:-2] << np.uint64(16)) | (byte[2:-1] << np.uint64(8)) | byte[3:]
        pieces = code[~(blank[1:-2] | blank[2:-1])] * _SPREAD >> shift
    return np.concatenate([pieces, (word_hashes(low) * _SPREAD) >> shift]).astype(np.int64)


class FactorizationMachine:
    """score = sigmoid(bias + sum of w over the terms present + sum of v_i . v_j over their pairs). Terms outside of ``terms`` have neither."""

    def __init__(self, terms: np.ndarray, s: Settings) -> None:
        self.s, self.terms = s, np.asarray(terms, dtype=np.int64)
        rng = np.random.default_rng(s.seed)
        self.bias = 0.0
        self.w = np.zeros(self.terms.size)
        self.v = rng.normal(0, 0.02, (self.terms.size, s.factors))
        self._place: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_place": None}

    def present(self, text: str | None) -> np.ndarray:
        """Places of the known terms of a text, each once."""
        if self._place is None:
            self._place = np.full(1 << self.s.bits, -1, dtype=np.int32)
            self._place[self.terms] = np.arange(self.terms.size)
        at = self._place[term_numbers(text, self.s.bits)] if text else np.empty(0, dtype=np.int32)
        return np.unique(at[at >= 0])

    def _sums(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat places, their owners, the sum of vectors per row and the raw score per row."""
        owner = np.repeat(np.arange(len(rows)), [r.size for r in rows])
        flat = np.concatenate([np.empty(0, dtype=np.int64), *rows]).astype(np.int64)
        total = np.zeros((len(rows), self.s.factors))
        np.add.at(total, owner, self.v[flat])
        raw = self.bias + np.bincount(owner, self.w[flat], minlength=len(rows))
        squares = np.bincount(owner, (self.v[flat] ** 2).sum(axis=1), minlength=len(rows))
        return flat, owner, total, raw + 0.5 * ((total**2).sum(axis=1) - squares)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._sums(rows)[3], -500, 500)))

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        """AdaGrad on the log loss, labels weighted alike, with weight decay."""
        s, rng = self.s, np.random.default_rng(self.s.seed)
        share = np.array([(y == k).sum() for k in (0, 1)])
        weight = (y.size / (share.clip(1) * (share > 0).sum()))[y]
        past_w, past_v, past_b = np.full(self.w.shape, 1e-8), np.full(self.v.shape, 1e-8), 1e-8
        for _ in range(-(-s.steps * s.batch // y.size)):
            order = rng.permutation(y.size)
            for i in range(0, y.size, s.batch):
                part = order[i : i + s.batch]
                flat, owner, total, raw = self._sums([rows[j] for j in part])
                g = (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - y[part]) * weight[part] / part.size
                used, where = np.unique(flat, return_inverse=True)
                own = g[owner]
                gw = np.bincount(where, own, minlength=used.size) + s.decay * self.w[used]
                gv = np.zeros((used.size, s.factors))
                np.add.at(gv, where, own[:, None] * (total[owner] - self.v[flat]))
                gv += s.decay * self.v[used]
                past_w[used] += gw**2
                past_v[used] += gv**2
                past_b += g.sum() ** 2
                self.w[used] -= s.rate * 5 * gw / np.sqrt(past_w[used])
                self.v[used] -= s.rate * gv / np.sqrt(past_v[used])
                self.bias -= s.rate * 5 * g.sum() / np.sqrt(past_b)


def _share(hash64: Column, wanted: Column) -> Column:
    """True for about the wanted share of all hashes, the smallest ones."""
    return (wanted >= 1.0) | (hash64 < F.lit(-float(2**63)) + wanted * float(2**64))


def sample(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, y) of about ``max_docs`` different labelled texts, half of each label as far as they reach, chosen by hashes.

    A doc_id with several label rows is toxic if one of them says so; labels and ids that are null are not used; equal texts count once for a label. First
    ids are drawn by their hash from the narrow label table, then, should their rows hold more texts, texts by theirs: the bound holds in
    expectation (a binomial count) for any table, repeated ids and hot texts included.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("y")).where("y in (0, 1)")

    def drawn(rows: DataFrame, hash64: Column) -> DataFrame:
        """About half of ``max_docs`` rows of each label, those with the smallest hashes."""
        share = {r.y: s.max_docs / 2 / r["count"] for r in rows.groupBy("y").count().collect()}
        return rows.where(_share(hash64, F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))))

    ids = stage(drawn(known, F.xxhash64(F.lit(s.seed), "doc_id")), "sample_ids")
    texts = docs.select("doc_id", F.col(f"`{text_col}`").alias("text")).where("doc_id is not null and text is not null").join(ids, "doc_id")
    texts = stage(texts.groupBy("y", F.xxhash64(F.lit(s.seed), "text").alias("h")).agg(F.first("text").alias("text")), "sample_texts")
    return drawn(texts, F.col("h")).select("h", "text", "y")


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine | None:
    """Fit on ``sample``; None if it holds no toxic or no other text. The driver gets the chosen terms and, per sampled text, the places of those present."""
    small_batches(docs.sparkSession)
    chosen = sample(docs, labels, s, text_col, label_col)

    @F.pandas_udf("array<int>")
    def terms(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([np.unique(term_numbers(t, s.bits)).astype(np.int32) for t in batch])

    sizes = {r.y: r["count"] for r in chosen.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    toxic, other = float(sizes[1]), float(sizes[0])
    counts = chosen.select("y", F.explode(terms("text")).alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.sum(F.lit(1) - F.col("y")).alias("b"))
    both = (F.col("a") + F.col("b")) / (toxic + other)
    z = F.abs(F.col("a") / toxic - F.col("b") / other) / F.sqrt(both * (F.lit(1.0) - both) * (1 / toxic + 1 / other) + 1e-12)
    best = [r.term for r in counts.select("term", z.alias("z")).where(F.col("z") >= s.min_z).orderBy(F.desc("z"), "term").limit(s.max_terms).collect()]
    machine = FactorizationMachine(np.sort(np.array(best, dtype=np.int64)), s)

    @F.pandas_udf("array<int>")
    def present(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([machine.present(t) for t in batch])

    rows = sorted(chosen.select("y", "h", present("text").alias("p")).collect(), key=lambda r: (r.h, r.y))
    machine.fit([np.array(r.p, dtype=np.int64) for r in rows], np.array([r.y for r in rows]))
    return machine


def score(docs: DataFrame, machine: FactorizationMachine | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 from 0.5 on) from the whole text alone; columns of these names are replaced.

    Null and empty texts, and texts without any term that was learned, have the score of no terms, which is the bias. If nothing was learned every
    score is 0. Rows do not depend on each other; an empty table gives none; other columns never reach Python.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(machine.scores([machine.present(t) for t in batch]) if machine is not None else np.zeros(len(batch)), dtype="float64")

    out = docs.drop("score", "predicted").withColumn("score", rate(F.col(f"`{text_col}`")))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def held_out(doc_id: Column) -> Column:
    """The fold that no fit may read: crc32 of the id as text divides by five. Without id: not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
