"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Bins stand by what they have left. For each source and for each duplicate cluster a bitmap over the bins marks where one more
document of it may not go. For a piece the search begins at the smallest residual that holds it and goes on to the next larger one
until a level has a compatible bin, which is then the tightest; only if none has does a new bin open.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BLANKS, lower_ascii, n_words, small_batches, stage

#: Pieces that one task packs together.
PIECES_PER_TASK = 20_000


class Bins:
    """The bins of one task. Bitmaps are whole numbers: bit b stands for bin b."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source, self.n = capacity, per_source, 0
        self.level: defaultdict[int, int] = defaultdict(int)  # residual -> bins
        self.filled = 0  # bit r: some bin has residual r
        self.cluster: defaultdict[object, int] = defaultdict(int)
        self.planes: defaultdict[object, list[int]] = defaultdict(lambda: [0] * per_source)  # plane k: bins with more than k of the source

    def place(self, size: int, source: object, cluster: object | None) -> int:
        """The bin that a piece goes to. ``cluster`` None: its cluster has no other piece here."""
        planes = self.planes[source]
        free = ~(planes[-1] | (self.cluster[cluster] if cluster is not None else 0))
        ahead, residual, at = self.filled >> size, size, 0
        while ahead:
            step = (ahead & -ahead).bit_length() - 1
            residual += step
            if fit := self.level[residual] & free:
                at = fit & -fit
                break
            ahead >>= step + 1
            residual += 1
        if at:
            self.level[residual] ^= at
            if not self.level[residual]:
                self.filled ^= 1 << residual
        else:
            at, residual, self.n = 1 << self.n, self.capacity, self.n + 1
        left = residual - size
        self.level[left] |= at
        self.filled |= 1 << left
        for k in range(self.per_source):
            if not planes[k] & at:
                planes[k] |= at
                break
        if cluster is not None:
            self.cluster[cluster] |= at
        return at.bit_length() - 1


def best_fit(sizes: Sequence[int], sources: Sequence[object], clusters: Sequence[object], capacity: int, per_source: int) -> list[int]:
    """Bin of each piece, in the order given."""
    counts = Counter(clusters)
    bins = Bins(capacity, per_source)
    return [bins.place(n, s, c if counts[c] > 1 else None) for n, s, c in zip(sizes, sources, clusters, strict=True)]


def text_cluster(text: Column) -> Column:
    """Cluster of texts equal but for the case of A-Z and blanks at the ends."""
    return F.xxhash64(lower_ascii(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))))


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 4, cluster: Column | None = None, size: Column | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, source, piece (from 0), first_word, n_words, bin_id.

    Sizes are the text's words, counted here unless ``size`` has their number; ``text`` is read only for what is not given. A document longer than ``capacity`` is cut into pieces of ``capacity`` words and a rest; nothing is dropped.
    No bin exceeds the capacity, holds two pieces of one ``cluster`` (default: equal texts; a document's own
    pieces are of one cluster; rows of ``minhash.clusters`` have sizes and the clusters of near copies), or more than ``per_source`` pieces of one source.

    Null texts and texts without words are one piece of no words, placed by the same rules; null is a source of its own; rows that repeat an id are separate
    documents; an empty table gives no rows; other columns are ignored.

    Pieces are dealt evenly, whatever their keys, to tasks of about ``PIECES_PER_TASK``, each of which packs its own in descending size, so
    a hot source or cluster is spread and each task costs at most a few bins that are not full. Texts do not travel. Which bins result depends on how pieces are dealt, not on the order in which they arrive.
    """
    if capacity < 1 or per_source < 1:
        raise ValueError("capacity and per_source are at least 1")
    small_batches(docs.sparkSession, 10_000)
    words = size if size is not None else n_words(F.col("text"))
    own = cluster if cluster is not None else text_cluster(F.col("text"))
    measured = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("bigint").alias("size"), own.cast("bigint").alias("cluster"))
    measured = stage(measured, "sizes")
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / capacity) - 1).cast("int")
    pieces = measured.select("doc_id", "source", "cluster", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select("doc_id", "source", "cluster", "piece", (F.col("piece").cast("bigint") * capacity).alias("first_word"), F.least(F.lit(capacity), F.col("size") - F.col("piece").cast("bigint") * capacity).alias("n_words"))
    tasks = -(-pieces.count() // PIECES_PER_TASK)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("n_words", "descending"), ("cluster", "ascending"), ("source", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins = best_fit(*(t.column(c).to_pylist() for c in ("n_words", "source", "cluster")), capacity, per_source)
        ids = (np.int64(TaskContext.get().partitionId()) << np.int64(32)) + np.array(bins, dtype=np.int64)
        t = t.drop_columns(["cluster"]).append_column("bin_id", pa.array(ids))
        yield from t.to_batches(max_chunksize=10_000)

    return pieces.repartition(max(1, tasks)).mapInArrow(place, "doc_id long, source string, piece int, first_word long, n_words long, bin_id long")
