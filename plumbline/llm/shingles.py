"""Word shingles of a text as 64-bit hashes, computed with numpy over the text's bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: A random odd number for each byte, A-Z read as a-z.
_BYTE = (_RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[_FOLD]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes whose words are hashed at once, so that what is computed on the way stays in the processor's cache.
_CHUNK = 1 << 15
_TABLES: tuple[np.ndarray, ...] = (np.empty(0, dtype=np.uint64),) * 2


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of each 64-bit number over all bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``_STEP`` from the first on, and of its inverse from none on, at least ``n`` of each; the last tables are kept."""
    global _TABLES
    if _TABLES[0].size < n:
        n = max(n, _CHUNK)
        _TABLES = tuple(np.multiply.accumulate(np.concatenate([[x], np.full(n - 1, y)])) for x, y in ((_STEP, _STEP), (np.uint64(1), np.uint64(pow(int(_STEP), -1, 2**64)))))
    return _TABLES


def words_of_texts(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of consecutive texts, whose bytes are ``raw`` between one of ``bounds`` and the next, and how many words each text has.

    A word's polynomial is the difference of two running sums over all bytes, divided by the power of its place.
    """
    edge = np.zeros(raw.size + 2, dtype=bool)
    solid = edge[1:-1]
    np.logical_not((raw == 32) | ((raw >= 9) & (raw <= 13)), out=solid)
    begin, end = solid & ~edge[:-2], solid & ~edge[2:]
    cut = bounds[(bounds > 0) & (bounds < raw.size)]
    begin[cut], end[cut - 1] = solid[cut], solid[cut - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    out = np.empty(first.size, dtype=np.uint64)
    k = 0
    while k < first.size:
        stop = max(k + 1, int(np.searchsorted(last, first[k] + _CHUNK, "right")))
        at, n = first[k:stop] - first[k], int(last[stop - 1] - first[k])
        powers, inverse = _powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw[first[k] : last[stop - 1]]] * powers[:n], out=sums[1:])
        lengths = last[k:stop] - first[k:stop]
        out[k:stop] = mix((sums[at + lengths] - sums[at]) * inverse[at] + lengths.astype(np.uint64))
        k = stop
    return out, np.diff(np.searchsorted(first, bounds))


def word_hashes(text: str) -> np.ndarray:
    """A hash of every word, in order; words are what stands between ASCII blanks, A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return words_of_texts(raw, np.array([0, raw.size]))[0]


def _runs(words: list[np.ndarray]) -> np.ndarray:
    """A hash of every run; ``words`` has the first words of all, then the second words and so on."""
    total = np.full(words[0].size, np.uint64(len(words)))
    for i, w in enumerate(words):
        total *= _PLACE[i % 64]
        total += w
        total = mix(total)
    return total


def sets_of_texts(raw: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingle sets of consecutive texts end to end, the size of each, and the number of words of each text (see ``words_of_texts``)."""
    words, counts = words_of_texts(raw, bounds)
    first = np.cumsum(counts) - counts
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    stops = np.cumsum(runs)
    starts = stops - runs
    found = np.empty(int(runs.sum()), dtype=np.uint64)
    if words.size >= width:
        every = _runs([words[i : words.size - width + 1 + i] for i in range(width)])
        long = np.where(counts >= width, runs, 0)
        found[np.repeat(counts >= width, runs)] = every[np.repeat(first - np.cumsum(long) + long, long) + np.arange(long.sum())]
    for k in np.unique(counts[(counts > 0) & (counts < width)]):  # fewer words than a run
        at = np.flatnonzero(counts == k)
        found[starts[at]] = _runs([words[first[at] + i] for i in range(k)])
    for i, j in zip(starts.tolist(), stops.tolist(), strict=True):
        found[i:j].sort()
    new = np.ones(found.size, dtype=bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    new[starts[runs > 0]] = True
    seen = np.concatenate([[0], np.cumsum(new)])
    return found[new], seen[stops] - seen[starts], counts


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; with fewer words the whole sequence is one run; without words none."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return sets_of_texts(raw, np.array([0, raw.size]), width)[0]


def set_hashes(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One signed 64-bit number for each set, whatever the order; the sets stand end to end, and none is empty."""
    if not sizes.size:
        return np.empty(0, dtype=np.int64)
    sums = np.add.reduceat(mix(members ^ _STEP), np.cumsum(sizes) - sizes)
    return mix(sums + sizes.astype(np.uint64)).astype(np.int64)


def histograms(members: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set, counts of the hashes by their leading bits, about eight a bucket: with another set's, an upper bound of the intersection."""
    bits = np.maximum(3, np.ceil(np.log2(np.maximum(sizes, 1) / 8 + 1)).astype(np.int64))
    stops = np.cumsum(1 << bits)
    starts = stops - (1 << bits)
    bucket = (members >> np.repeat((64 - bits).astype(np.uint64), sizes)).astype(np.int64) + np.repeat(starts, sizes)
    counts = np.bincount(bucket, minlength=int(stops[-1]) if stops.size else 0)
    raw = np.minimum(counts, 255).astype(np.uint8).tobytes()
    crowded = np.searchsorted(stops, np.flatnonzero(counts > 255), "right")
    found = [raw[i:j] for i, j in zip(starts.tolist(), stops.tolist(), strict=True)]
    for k in crowded:
        found[k] = b""
    return found


def histogram(shingles: np.ndarray) -> bytes:
    """``histograms`` of one set."""
    return histograms(shingles, np.array([shingles.size]))[0]


def most_shared(a: bytes, b: bytes) -> float:
    """Upper bound of the intersection of two sets from their histograms; no bound if one could not be made."""
    if not a or not b:
        return float("inf")
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if x.size > y.size:
        x, y = y, x
    return float(np.minimum(x, y.reshape(x.size, -1).sum(axis=1)).sum())


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if a.size > b.size:
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == b.size] = 0
    return int((b[at] == a).sum()) if b.size else 0
