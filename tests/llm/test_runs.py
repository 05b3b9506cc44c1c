"""Periodic runs against a plain scan of every lag."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import runs
from plumbline.llm.queries import op13_periodic_runs


def brute(w, least=6, repeats=4):
    """Every lag over the whole text; the smallest period of a stretch counts."""
    out = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, repeats * q):
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in out.items())


def expected(doc_id, text, planted=True):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    return (len(found), *(top or (None,) * 3), top[1] * 1000 // top[2] if top else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest())


def test_against_every_lag():
    rng = random.Random(3)
    for _ in range(3000):
        words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(60))]
        if rng.random() < .6 and len(words) > 8:
            unit = words[:rng.randrange(1, 9)]
            words = words[:rng.randrange(8)] + (unit * 9)[:rng.randrange(4, 50)] + words[8:] + (unit * 9)[:rng.randrange(4, 50)]
        assert runs.find_runs(words) == brute(words)
        assert runs.find_runs(words, runs.Rule(2, 5)) == brute(words, 2, 5)


def test_runs_within_runs():
    inner = [b"a"] * 6 + [b"b"]
    words = [b"x"] + inner * 5 + [b"y"]
    assert runs.find_runs(words) == brute(words)
    assert {q for _, _, q in runs.find_runs(words)} == {1, 7}
    # a period whose window repeats with a smaller one
    words = ([b"a", b"a", b"b"] * 4 + [b"a"]) * 6
    assert runs.find_runs(words) == brute(words)


def test_splitting_leaves_all_runs_whole():
    rng = random.Random(5)
    words = [rng.randrange(400) for _ in range(3000)]
    words[1000:1040] = [7, 8, 9, 7] * 10
    import numpy as np
    left = list(runs.segments(np.array(words), runs.Rule()))
    assert any(s <= 1000 and e >= 1040 for s, e in left) and sum(e - s for s, e in left) < 300


def test_long_texts_take_no_square_of_time():
    assert runs.find_runs([b"a"] * 200_000) == [(0, 200_000, 1)]
    unit = [b"%d" % (i * i % 97) for i in range(30_000)]
    assert (0, 120_000, 30_000) in runs.find_runs(unit * 4)


def test_too_few_repeats_are_refused():
    with pytest.raises(ValueError):
        runs.Rule(min_repeats=3)


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op13_periodic_runs(spark, sf)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = out.collect()
    assert len(rows) == len(docs) and {r.doc_id: tuple(r)[1:] for r in rows} == {k: expected(k, t) for k, t in docs.items()}
    assert sum(r.n_runs > 0 for r in rows) >= 3


def test_awkward_rows_and_columns(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    texts = [None, "", " \t\n", "one", "A a  A a\x0bA\fa\nA a", "a " * 40 + "b b"]
    rows = [(i, t, "f", "x") for i in [*ids, None, 1, 1] for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string, `a b` string")
    out = runs.with_runs(df.withColumn("text", runs.plant(F.col("text"), F.col("doc_id"))))
    assert out.columns == df.columns
    got = sorted(((r.doc_id or -1), r.found.n_runs, r.found.start, r.found.runs_sha256, hashlib.sha256(r.found.text.encode()).hexdigest(), r["a b"]) for r in out.collect())
    want = sorted(((i or -1), e[0], e[1], e[5], e[6], "x") for i, t, _, _ in rows for e in [expected(i, t)])
    assert got == want
    assert runs.with_runs(df.limit(0)).count() == 0
