"""Language of whole texts by a small convolutional network over bytes, trained in numpy.

Filters of several widths slide over the bytes of a fixed-length window; each filter's highest response in the window,
if positive, is one feature, and a softmax layer turns the features into languages. A text is cut into windows that
cover all of it, and their log-probabilities are averaged by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, stage

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    """``max_docs`` bounds the labelled rows that the fit reads, those with the smallest hashes of each language;
    ``windows_per_doc`` bounds the windows of each, spread over its whole text."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    max_docs: int = 3000
    windows_per_doc: int = 4
    epochs: int = 6
    batch: int = 128
    rate: float = 0.01
    seed: int = 5


def windows(text: str, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows x size) bytes covering all of the lower-cased text, padded with blanks, and the bytes in each."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    step = size - overlap
    n = max(1, -(-(raw.size - overlap) // step))
    padded = np.full((n - 1) * step + size, 32, dtype=np.uint8)
    padded[: raw.size] = raw
    cut = np.lib.stride_tricks.sliding_window_view(padded, size)[::step]
    return cut, np.minimum(size, raw.size - np.arange(n) * step)


class Network:
    """Weights and passes. A filter of width w is w tables of one row per byte value: the sum of the rows of the bytes under it."""

    def __init__(self, languages: list[str], s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        self.languages, self.s = languages, s
        self.tables = [rng.normal(0, 0.3, (w, 256, s.filters)).astype(np.float32) for w in s.widths]
        self.out = rng.normal(0, 0.1, (s.filters * len(s.widths), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), dtype=np.float32)
        self._pairs: list[list[np.ndarray]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pairs": None}

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on the cross-entropy, classes weighted alike."""
        s, rng = self.s, np.random.default_rng(self.s.seed)
        counts = np.bincount(y, minlength=len(self.languages))
        weight = (y.size / (counts.clip(1) * (counts > 0).sum())).astype(np.float32)
        params = [*self.tables, self.out, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(s.epochs):
            order = rng.permutation(y.size)
            for i in range(0, y.size, s.batch):
                part = order[i : i + s.batch]
                xb, yb = x[part], y[part]
                rows = np.arange(yb.size)
                tops, values = [], []
                for table, w in zip(self.tables, s.widths, strict=True):
                    response = sum(table[j][xb[:, j : s.window - w + 1 + j]] for j in range(w))
                    top = response.argmax(axis=1)
                    tops.append(top)
                    values.append(np.take_along_axis(response, top[:, None], axis=1)[:, 0])
                high = np.concatenate(values, axis=1)
                features = np.maximum(high, 0)
                logits = features @ self.out + self.bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[rows, yb] -= 1
                p *= (weight[yb] / yb.size)[:, None]
                back = (p @ self.out.T) * (high > 0)
                grads = []
                for k, (table, w) in enumerate(zip(self.tables, s.widths, strict=True)):
                    g, own = np.zeros_like(table), back[:, k * s.filters : (k + 1) * s.filters]
                    for j in range(w):
                        np.add.at(g[j], (xb[rows[:, None], tops[k] + j], np.arange(s.filters)[None, :]), own)
                    grads.append(g)
                grads += [features.T @ p, p.sum(axis=0)]
                t += 1
                for q, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= s.rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Per window and language. Neighbouring bytes are read as one 16-bit number, so two rows of a filter cost one look-up."""
        if self._pairs is None:
            self._pairs = [[(t[j][:, None] + t[j + 1][None, :]).reshape(65536, -1) for j in range(0, w - 1, 2)] + ([t[w - 1]] if w % 2 else []) for t, w in zip(self.tables, self.s.widths, strict=True)]
        wide = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        high = np.empty((x.shape[0], self.out.shape[0]), dtype=np.float32)
        for k, (pairs, w) in enumerate(zip(self._pairs, self.s.widths, strict=True)):
            n = self.s.window - w + 1
            total = None
            for j, pair in enumerate(pairs):
                rows = pair.take((wide if pair.shape[0] > 256 else x)[:, 2 * j : 2 * j + n], axis=0)
                total = rows if total is None else np.add(total, rows, out=total)
            high[:, k * self.s.filters : (k + 1) * self.s.filters] = total.max(axis=1)
        logits = np.maximum(high, 0) @ self.out + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str], chunk: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its probability per text; windows of all texts are computed in chunks."""
        cuts = [windows(t, self.s.window, max(self.s.widths) - 1) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(c[1]) for c in cuts])
        x, size = np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts])
        logs = np.concatenate([self.log_probabilities(x[i : i + chunk]) for i in range(0, len(x), chunk)]) * size[:, None]
        total = np.zeros((len(texts), len(self.languages)))
        np.add.at(total, owner, logs)
        mean = total / np.bincount(owner, size, minlength=len(texts))[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def quota(counts: list[int], total: int) -> int:
    """The most rows of one language so that all together are at most ``total``: even shares, those not used shared again; 0 without languages, else 1 at least."""
    share = 0
    for i, n in enumerate(sorted(counts)):
        share = max(1, total // (len(counts) - i))
        if n > share:
            break
        total -= n
    else:
        share = max(counts, default=0)
    return share


def train(labelled: DataFrame, s: Settings = Settings(), text_col: str = "text", lang_col: str = "lang", key: Column | None = None) -> Network | None:
    """Fit on a bounded sample of the rows of ``labelled`` with a language and a letter in the text; None if there is none.

    The sample is one row for each of a language's smallest hashes of ``key`` (default: of the text), so it does not depend on partitioning. The languages share
    ``max_docs`` evenly, and what those with few rows leave goes to the others; each has one row at least, so all labels are learned. Windows
    are cut on the executors; the driver gets at most max_docs x windows_per_doc windows (more only if the languages outnumber max_docs).
    """
    small_batches(labelled.sparkSession)
    overlap = max(s.widths) - 1

    @F.pandas_udf("array<binary>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = []
            for t in batch:
                x, size = windows(t, s.window, overlap)
                good = np.flatnonzero(size >= min(s.window // 4, size[0]))
                at = good[np.unique(np.linspace(0, good.size - 1, min(s.windows_per_doc, good.size)).astype(int))]
                found.append([x[i].tobytes() for i in at])
            yield pd.Series(found)

    text, lang = F.col(text_col), F.col(lang_col)
    usable = labelled.where(lang.isNotNull() & text.isNotNull() & text.rlike(r"\p{L}"))
    hashed = usable.select(F.xxhash64(F.lit(s.seed), key if key is not None else text).alias("o"), text.alias("t"), lang.alias("l"))
    pairs = stage(hashed.select("l", "o").distinct(), "hashes")
    most = quota([r["count"] for r in pairs.groupBy("l").count().collect()], s.max_docs)
    if not most:
        return None
    # First in 256 parts of each language, so that a language of most rows is not on one task.
    ranked = pairs.withColumn("part", F.pmod("o", F.lit(256)))
    for by in (["l", "part"], ["l"]):
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("o"))).where(F.col("r") <= most)
    # Only texts up to the last hash of their language leave the scan; copies share a hash and are one row. Staged, so that the join is broadcast by size.
    last = stage(ranked.groupBy("l").agg(F.max("o").alias("last")), "last_hashes")
    chosen = hashed.join(last, "l").where("o <= last").groupBy("o", "l").agg(F.first("t").alias("t"))
    rows = chosen.select("o", cut("t").alias("w"), "l").collect()
    rows.sort(key=lambda r: (r.o, r.l))
    languages = sorted({r.l for r in rows})
    x = np.stack([np.frombuffer(w, dtype=np.uint8) for r in rows for w in r.w])
    y = np.array([languages.index(r.l) for r in rows for _ in r.w])
    net = Network(languages, s)
    net.fit(x, y)
    return net


def identify(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from the text alone; columns of these names are replaced.

    Every window of the whole text counts. Null texts and texts without a letter are ``und`` with score 0, as is
    everything if nothing was learned. Other columns never reach Python.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            lang, score = np.full(len(batch), UNKNOWN, dtype=object), np.zeros(len(batch))
            at = [i for i, t in enumerate(batch) if t is not None and net is not None and _LETTER.search(t)]
            for part in (at[i : i + 32] for i in range(0, len(at), 32)):
                best, p = net.predict([batch.iloc[i] for i in part])
                lang[part], score[part] = np.array(net.languages, dtype=object)[best], p
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    found = docs.drop("lang_pred", "score").withColumn("_language", predict(F.col(f"`{text_col}`")))
    return found.select(*[F.col(f"`{c}`") for c in found.columns if c != "_language"], "_language.lang_pred", "_language.score")


def held_out(doc_id: Column) -> Column:
    """The fold that no fit may read: crc32 of the id as text is 1 modulo 3. Without id: not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
