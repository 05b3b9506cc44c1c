"""Periodic runs of words, found by recursive frequency splitting and a scan of lags.

A run of period q and at least 4 q words holds each of its words four times. So a word that occurs less often than that in a
segment is in no run there and splits it; what is left is counted again, until nothing changes. Only the surviving segments, few
and short in ordinary text, are scanned for every lag.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, small_batches

#: Rounds of splitting. Splitting only saves work: what is not stable by then is scanned as it is, with the same result.
ROUNDS = 64


@dataclass(frozen=True)
class Rule:
    """A run has at least ``min_words`` words and at least ``min_repeats`` times its period; two repeats are the least that a period needs."""

    min_words: int = 6
    min_repeats: int = 4

    def __post_init__(self) -> None:
        if self.min_repeats < 4 or self.min_words < 1:
            raise ValueError("a run has at least four repeats and one word")


def segments(ids: np.ndarray, rule: Rule) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches that no rarely used word splits any further; they hold all runs whole."""
    stack = [(0, ids.size, 0)]
    while stack:
        start, end, depth = stack.pop()
        if end - start < max(rule.min_words, rule.min_repeats):
            continue
        part = ids[start:end]
        if depth:  # numbers from 0 again, so that counting costs the segment's length
            part = np.unique(part, return_inverse=True)[1]
        rare = np.flatnonzero(np.bincount(part)[part] < rule.min_repeats)
        if not rare.size or depth == ROUNDS:
            yield start, end
            continue
        cuts = np.concatenate(([-1], rare, [end - start]))
        long = np.flatnonzero(np.diff(cuts) > rule.min_repeats)
        stack += [(start + int(cuts[i]) + 1, start + int(cuts[i + 1]), depth + 1) for i in long]


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements of two equally long arrays agree, read in doubling chunks."""
    at, step = 0, 64
    while at < a.size:
        differ = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if differ.size:
            return at + int(differ[0])
        at, step = at + step, step * 2
    return a.size


def scan(ids: np.ndarray, rule: Rule) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one segment.

    A run of period q agrees with itself q words on at 3 q positions in a row at least, among them three multiples of q: only those are
    compared at first, n / q for a lag. Where the place found lies in a run whose period divides q, that run is
    the whole of it (its period is the smaller one); elsewhere it is extended both ways.
    """
    n, found = ids.size, []
    met: dict[tuple[int, int], int] = {}
    owner, longest = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)  # of the runs over a word, the longest
    for q in range(1, n // rule.min_repeats + 1):
        every = ids[::q]
        same = every[1:] == every[:-1]
        same = same[:-2] & same[1:-1] & same[2:]
        if not same.any():
            continue
        done = 0
        for x in (np.flatnonzero(same) * q).tolist():
            if x < done:
                continue
            if (k := owner[x]) >= 0 and x + q < found[k][0] + found[k][1] and q % found[k][2] == 0:
                done = found[k][0] + found[k][1] - q
                continue
            start, end = x - _same(ids[:x][::-1], ids[q : x + q][::-1]), x + q + _same(ids[x : n - q], ids[x + q :])
            done = end - q
            # The same words as a run met before: its period, which is smaller, is the one that counts.
            if end - start >= max(rule.min_words, rule.min_repeats * q) and met.setdefault((start, end), q) == q:
                found.append((start, end - start, q))
                shorter = longest[start:end] < end - start
                owner[start:end][shorter], longest[start:end][shorter] = len(found) - 1, end - start
    return found


def find_runs(words: list[bytes], rule: Rule = Rule()) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
    return sorted((start + s, size, q) for start, end in segments(ids, rule) for s, size, q in scan(ids[start:end], rule))


def _digest(runs: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()


FOUND = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, text string"


def with_runs(docs: DataFrame, rule: Rule = Rule(), text_col: str = "text") -> DataFrame:
    """``docs`` with ``found``: n_words, n_runs; start, length, period and exponent_milli (1000 x length / period, floored) of the longest run (ties:
    smallest start, then period; all null without a run); runs_sha256 over ``start,length,period`` and a line feed for every run, by
    start, then period; text: the words outside of runs and the first period of each run, joined by one space.

    Words are what stands between ASCII blanks. Null and empty texts have no words, no run and the text ''. Every word of a text counts, however long;
    rows are independent of each other, so repeated rows have equal results and an empty table gives none. A column named ``found`` is replaced;
    other columns never reach Python.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(FOUND)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                words = (t or "").encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII blanks
                runs = find_runs(words, rule)
                kept = words
                if runs:
                    keep = np.ones(len(words), dtype=bool)
                    for s, n, q in runs:
                        keep[s + q : s + n] = False
                    kept = [words[i] for i in np.flatnonzero(keep)]
                top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                rows.append((len(words), len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, _digest(runs), b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame({name.split()[0]: pd.array([r[i] for r in rows], dtype="Int64") if name.endswith("long") else [r[i] for r in rows] for i, name in enumerate(FOUND.split(", "))})

    return docs.withColumn("found", find(F.col(f"`{text_col}`")))


def plant(text: Column, doc_id: Column) -> Column:
    """The text, or, where crc32 of the decimal id divides by ten, its words with a repeated stretch: with g a tenth of that number and n the number of words,
    each word i from a = g mod n on becomes word a + (i - a) mod p, p = 1 + floor((n - a) / (3 + g mod 8)). Null text, text
    without words and null ids change nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    n = F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (F.floor((n - a) / (F.lit(3) + g % 8)) + 1).cast("int")
    # Whole pieces are repeated: an expression inside a lambda would be computed again, the words cut again, for every word.
    repeated = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), repeated), F.lit(1), n), " ")).otherwise(text)
