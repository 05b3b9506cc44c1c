"""Whitening of embeddings by the exact spectrum of their integer scatter.

Components are rounded to 64ths, so sums and products of the different vectors are whole numbers and are kept exactly, however many
rows there are. The characteristic polynomial of the scatter, its isolated roots and their null spaces (``spectrum``) give the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import spectrum
from plumbline.llm.common import small_batches, stage

UNITS, OFFSET = 64, 1_000_000
#: Components beyond this, as whole 64ths, are taken as this: no sum of it with OFFSET leaves 64 bits.
LARGEST = 2**60
#: Products of parts of this many bits, summed over BLOCK rows, are exact in doubles.
PART_BITS, BLOCK = 20, 4096
#: Primes that one task reduces the matrix by.
PRIMES_PER_TASK = 16


def whole(vector: Column) -> Column:
    """x = floor(64 c) + 1,000,000 for each component c as double; null for a vector that is null or holds null or non-finite entries."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(F.least(F.greatest(c * float(UNITS), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("bigint") + OFFSET)
    return F.when(v.isNotNull() & ~bad, x)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    """The list column of a batch as a matrix."""
    lists = batch.column(0)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _parts(d: np.ndarray) -> list[np.ndarray]:
    """Doubles p0, p1, ... with d = p0 + p1 2**20 + ...; one of them where no entry has more bits."""
    out, half = [], 1 << (PART_BITS - 1)
    while True:
        low = ((d + half) & ((1 << PART_BITS) - 1)) - half
        out.append(low.astype(np.float64))
        d = (d - low) >> PART_BITS
        if not d.any():
            return out


def scatter(d: np.ndarray) -> np.ndarray:
    """The exact sum of the products of all pairs of columns, as Python's whole numbers."""
    total = np.zeros((d.shape[1],) * 2, dtype=object)
    for at in range(0, len(d), BLOCK):
        parts = _parts(d[at : at + BLOCK])
        for i, p in enumerate(parts):
            for j, q in enumerate(parts):
                total += (p.T @ q).astype(np.int64).astype(object) << (PART_BITS * (i + j))
    return total


_LIMB, _LIMBS = 32, 7
_SUMS = "cell int, " + ", ".join(f"l{i} long" for i in range(_LIMBS))


def _limbs(values: Iterator[int]) -> pa.RecordBatch:
    """A row per whole number: its place and its digits to the base 2**32, the last with the sign, so that sums over tasks stay exact."""
    values = list(values)
    columns = [[(v >> (_LIMB * i)) & (2**_LIMB - 1) if i < _LIMBS - 1 else v >> (_LIMB * i) for v in values] for i in range(_LIMBS)]
    return pa.RecordBatch.from_pydict({"cell": pa.array(range(len(values)), pa.int32())} | {f"l{i}": pa.array(c, pa.int64()) for i, c in enumerate(columns)})


def _exact_sums(vectors: DataFrame, values) -> list[int]:
    """The sums over all rows of the whole numbers that ``values`` makes of a matrix of rows; every task adds up its own first, then Spark theirs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = values(_rows(batch))
                total = own if total is None else total + own
        if total is not None:
            yield _limbs(total.tolist())

    per_cell = vectors.mapInArrow(add, _SUMS).groupBy("cell").agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(_LIMBS)])
    rows = per_cell.collect()  # a row for each pair of dimensions
    return [sum(r[f"l{i}"] << (_LIMB * i) for i in range(_LIMBS)) for r in sorted(rows, key=lambda r: r.cell)]


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors with sums ``sums`` a dimension; a row of ``components`` for each eigenvalue of the covariance, in falling order."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: list[float]
    identity_error: float = 0.0

    def center(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as a whole number and the rest of S, so that x - S / n = (x - whole) - rest / n without rounding the large part."""
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(near, dtype=np.int64), np.array([s - self.n * c for s, c in zip(self.sums, near, strict=True)], dtype=object)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        near, rest = self.center()
        return ((x - near) - (rest / self.n).astype(np.float64)) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n x - S)**2 for every row."""
        near, rest = self.center()
        d = x - near
        parts = _parts(d)
        squares = sum((p * q).sum(axis=1).astype(np.int64).astype(object) << (PART_BITS * (i + j)) for i, p in enumerate(parts) for j, q in enumerate(parts))
        along = d.astype(object) @ rest if abs(d).max(initial=0) * float(abs(rest).max()) * d.shape[1] >= 2**62 else (d @ rest.astype(np.int64)).astype(object)
        n = self.n
        return (n * (n * squares - 2 * along) + int((rest * rest).sum())).tolist()


def _spectrum(spark, m: list[list[int]], count: int) -> list[tuple[spectrum.Root, list[list[float]]]]:
    """The largest roots of the characteristic polynomial of ``m`` with their vectors: primes and roots are dealt to tasks."""
    moduli = spectrum.primes(spectrum.coefficient_bits(m))
    blocks = [moduli[i : i + PRIMES_PER_TASK] for i in range(0, len(moduli), PRIMES_PER_TASK)]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"block": [i], "r": [spectrum.residues(m, blocks[i]).ravel().tolist()]})

    rows = spark.range(0, len(blocks), 1, len(blocks)).mapInArrow(reduce, "block long, r array<long>").collect()
    table = np.concatenate([np.array(r.r, dtype=np.int64).reshape(-1, len(m) + 1) for r in sorted(rows, key=lambda r: r.block)])
    roots = spectrum.largest_roots(spectrum.combine(table, moduli), sum(m[i][i] for i in range(len(m))), count)
    if not roots:
        return []

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"root": [i], "v": [spectrum.null_vectors(m, roots[i])]})

    found = spark.range(0, len(roots), 1, len(roots)).mapInArrow(vectors, "root long, v array<array<double>>").collect()
    return [(roots[r.root], [list(v) for v in r.v]) for r in sorted(found, key=lambda r: r.root)]


def fit(vectors: DataFrame, count: int = 16) -> Whitening | None:
    """Fit on the different vectors of ``vectors``, whose only column ``x`` holds arrays of one length; None for no rows or no dimension.

    ``count`` components at most; those without variance are left out. Three passes over the different vectors, which are staged, each
    with one combined aggregation of a number of cells that the dimensions bound. identity_error is the largest absolute entry of the covariance
    of the whitened vectors minus the identity, measured over the whole fit list.
    """
    spark = vectors.sparkSession
    x = stage(vectors.distinct(), "fit")
    n = x.count()
    first = x.first()
    if first is None or not first.x:
        return None
    mask = 2**31 - 1
    sums = _exact_sums(x, lambda a: ((a >> 31).sum(axis=0).astype(object) << 31) + (a & mask).sum(axis=0).astype(object))
    model = Whitening(n, sums, np.empty((0, len(sums))), np.empty(0), [])
    near, rest = model.center()
    half = np.triu_indices(len(sums))
    products = np.zeros((len(sums),) * 2, dtype=object)
    products[half] = _exact_sums(x, lambda a: scatter(a - near)[half])
    products = np.triu(products) + np.triu(products, 1).T
    m = (n * products - np.outer(rest, rest)).tolist()  # n**2 times the covariance, exactly
    trace = sum(m[i][i] for i in range(len(m)))
    pairs = [(r, v) for r, vs in _spectrum(spark, m, count) for v in vs][:count]
    if not pairs:
        return model
    values = [Fraction(r.low + r.high, 2 << r.scale) for r, _ in pairs]
    model = Whitening(n, sums, np.array([v for _, v in pairs]), np.array([float(v / n**2) for v in values]), [float(v / trace) for v in values])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(pairs)
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = model.whiten(_rows(batch))
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(total.size), pa.int32()), "v": total.ravel()})

    cells = x.mapInArrow(measure, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.array([r.v for r in sorted(cells, key=lambda r: r.cell)]).reshape(-1, len(pairs)) / n
    error = np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(len(pairs))).max()
    return Whitening(n, sums, model.components, model.eigenvalues, model.explained, float(error))


OUT = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = 16) -> DataFrame:
    """One row for each usable row of ``table`` and each component: the id, component (from 1, by falling eigenvalue), n (vectors fitted),
    deviation (sum over dimensions of (n x - S)**2, exact; null beyond 38 digits), whitened (x - S / n along the component over the root of its
    eigenvalue), explained (the eigenvalue's share of the trace), identity_error (see ``fit``).

    A row whose vector is null or holds null or non-finite entries is dropped. Vectors of another length than the most frequent one (ties: the
    longest) have no place in the same space and are dropped too. Repeated rows are fitted once and all returned; null ids are ids. At most
    ``count`` components, and none without variance: a single different vector, vectors without entries and an empty table give no rows. Components above 2**54 are taken as
    2**54. Equal eigenvalues have any orthonormal vectors of their space, the same ones in every run. Other columns are ignored.
    """
    spark = table.sparkSession
    small_batches(spark, BLOCK)
    rows = table.select(F.col(f"`{id_col}`").alias(id_col), whole(F.col(f"`{vector_col}`")).alias("x")).where("x is not null")
    size = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).select("size").first()
    rows = rows.where(F.size("x") == (size[0] if size else 0))
    model = fit(rows.select("x"), count) if size else None
    if model is None or not model.explained:
        return rows.limit(0).select(id_col, *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in OUT.split(", ")])

    @F.pandas_udf("deviation decimal(38,0), w array<double>")
    def project(xs: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        most = 10**38
        for batch in xs:
            if not len(batch):
                yield pd.DataFrame({"deviation": [], "w": []})
                continue
            x = np.stack(batch.to_list())
            yield pd.DataFrame({"deviation": [Decimal(v) if v < most else None for v in model.deviations(x)], "w": list(model.whiten(x))})

    explained = F.array(*[F.lit(v) for v in model.explained])
    done = rows.select(id_col, project("x").alias("p")).select(id_col, "p.deviation", F.posexplode("p.w").alias("i", "whitened"))
    return done.select(id_col, (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("i")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
