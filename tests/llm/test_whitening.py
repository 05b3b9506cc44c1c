"""Whitening against numpy and exact fractions, and its exact steps against plain ones."""

from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import spectrum, whitening
from plumbline.llm.queries import op12_embedding_whitening


def brute(rows):
    """{id: (deviation, {component: whitened})} and eigenvalues, from plain sums and numpy's solver; one eigenvalue each."""
    xs = [(i, tuple(floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows if v is not None and all(c is not None and isfinite(c) for c in v)]
    fit = sorted({x for _, x in xs})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(c) - Fraction(t, n)) for c, t in zip(x, s)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    out = {}
    for i, x in xs:
        y = np.array([float(Fraction(c) - Fraction(t, n)) for c, t in zip(x, s)])
        out.setdefault(i, []).append((sum((n * c - t) ** 2 for c, t in zip(x, s)), y @ vectors / np.sqrt(values)))
    return out, n, values / np.trace(centred.T @ centred / n)


def test_query_against_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, n, explained = brute(rows)
    out = op12_embedding_whitening(spark, sf)
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    assert len(got) == 16 * len(rows) and len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-9
    signs = {}
    for r in sorted(got, key=lambda r: r.component):
        dev, w = want[r.vec_id][0]
        assert r.n == n and r.deviation == dev == r.deviation_exact and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        if abs(w[r.component - 1]) > .1:
            signs.setdefault(r.component, set()).add(np.sign(w[r.component - 1]) == np.sign(r.whitened))
        assert abs(abs(r.whitened) - abs(w[r.component - 1])) < 1e-6
    assert len(signs) == 16 and all(len(s) == 1 for s in signs.values())


def test_awkward_rows_and_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (2, [1.001, 2.0], 1), (2, [1.0, 2.0], 1), (None, [0.0, 5.0], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [None, 1.0], 1), (7, [inf, 1.0], 1), (8, [], 1), (9, [1.0], 1), (10, [-3.0, 0.5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    want, n, explained = brute([(i, v) for i, v, _ in rows if v is None or len(v) == 2])
    assert n == 3 and len(got) == 2 * 5 and {r.n for r in got} == {3}  # 1.0 and 1.001 are one 64th
    assert sorted((r.vec_id or 0, r.component, int(r.deviation), round(abs(r.whitened), 6)) for r in got) == sorted((i or 0, c + 1, d, round(abs(w[c]), 6)) for i, many in want.items() for d, w in many for c in range(2))
    assert {r.identity_error < 1e-9 for r in got} == {True}
    for few in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 8"), df.where("vec_id in (4, 5)")):
        assert whitening.whiten(few).columns == out.columns and whitening.whiten(few).count() == 0


def test_more_dimensions_than_vectors_and_equal_eigenvalues(spark):
    rows = [(i, [3.0 if j == i else 0.0 for j in range(6)]) for i in range(6)] + [(6 + i, [-3.0 if j == i else 0.0 for j in range(6)]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    w = np.zeros((12, 6))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    assert len(got) == 72 and np.allclose(w.T @ w / 12, np.eye(6)) and all(abs(r.explained - 1 / 6) < 1e-12 for r in got)
    few = [(i, [float(i * j % 7) for j in range(20)]) for i in range(1, 5)]
    got = whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-9


def test_huge_components_stay_exact(spark):
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 1.0]), (3, [12345678901.5, -1e12]), (4, [0.0, 3e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    xs = {r.vec_id: r.x for r in df.select("vec_id", whitening.whole(F.col("embedding")).alias("x")).collect()}
    s = [sum(c) for c in zip(*xs.values())]
    assert xs[1][0] == 2**60 + 1_000_000
    assert {r.vec_id: r.deviation for r in whitening.whiten(df).collect()} == {i: (v if v < 10**38 else None) for i, x in xs.items() for v in [sum((4 * c - t) ** 2 for c, t in zip(x, s))]}


def test_scatter_is_exact():
    rng = np.random.default_rng(1)
    for size in (30, 2**18, 2**25, 2**50):
        d = rng.integers(-size, size, (5000, 3))
        o = d.astype(object)
        assert (whitening.scatter(d) == o.T @ o).all()


def faddeev(m):
    """The characteristic polynomial by exact traces, the constant first."""
    d = len(m)
    a, c = np.array(m, dtype=object), [1]
    b = np.zeros((d, d), dtype=object)
    for k in range(1, d + 1):
        b = a @ b + c[-1] * np.eye(d, dtype=int).astype(object)
        c.append(-sum((a @ b)[i][i] for i in range(d)) // k)
    return c[::-1]


@pytest.mark.parametrize("rank", [1, 4, 9, 30])
def test_polynomial_and_roots(rank):
    rng = np.random.default_rng(rank)
    f = rng.integers(-9, 10, (rank, 9)).astype(object)
    f[:, 4] = 0  # no entry below the diagonal there
    m = (f.T @ f).tolist()
    moduli = spectrum.primes(spectrum.coefficient_bits(m))
    poly = spectrum.combine(spectrum.residues(m, moduli), moduli)
    assert poly == faddeev(m)
    trace = sum(m[i][i] for i in range(9))
    roots = spectrum.largest_roots(poly, trace, 9)
    values = np.linalg.eigvalsh(np.array(m, dtype=float))[::-1]
    got = [float(r.value()) for r in roots for _ in range(r.multiplicity)]
    assert len(got) == np.linalg.matrix_rank(np.array(m, dtype=float)) and np.allclose(got, values[:len(got)], rtol=1e-9)
    v = np.array([x for r in roots for x in spectrum.null_vectors(m, r)])
    assert np.allclose(v @ v.T, np.eye(len(v)), atol=1e-12) and np.allclose(np.array(m, dtype=float) @ v.T, v.T * np.array(got), atol=1e-7)


def test_multiple_roots_are_counted():
    poly = [1]
    for root in (0, 0, 3, 7, 7, 7, 50):
        poly = [(poly[k - 1] if k else 0) - root * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    assert [spectrum.roots_above(poly, a) for a in (-1, 0, 2, 3, 6, 7, 50)] == [7, 5, 5, 4, 4, 1, 0]
    assert [(round(float(r.value()), 9), r.multiplicity) for r in spectrum.largest_roots(poly, 74, 7)] == [(50.0, 1), (7.0, 3), (3.0, 1)]
