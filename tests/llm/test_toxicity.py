"""Toxicity on held-out rows, against plain sums over pairs, and on pairs that weights alone cannot tell apart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import toxicity
from plumbline.llm.queries import op11_toxicity

QUICK = toxicity.Settings(max_docs=400, steps=200)


@pytest.fixture(scope="module")
def machine(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.train(docs.where(~toxicity.held_out(F.col("doc_id"))), labels)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    out = op11_toxicity(spark, folder)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, other = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert len(toxic) >= 50 and len(other) >= 400
    assert sum(r.predicted == 1 for r in toxic) / len(toxic) >= .85 and sum(r.predicted == 0 for r in other) / len(other) >= .98
    assert np.mean([a.score > b.score for a in toxic for b in other]) >= .95
    assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_scores_are_sums_over_pairs(machine):
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(machine.terms.size, k, replace=False)) for k in (0, 1, 2, 7, 30) if k <= machine.terms.size]
    for r, got in zip(rows, machine.scores(rows), strict=True):
        raw = machine.bias + machine.w[r].sum() + sum(machine.v[a] @ machine.v[b] for i, a in enumerate(r) for b in r[i + 1:])
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-9


def test_pairs_that_weights_cannot_tell_apart(spark):
    """Two insults and two groups: toxic as 1 with x and 2 with y, harmless as 1 with y and 2 with x. The sums of weights of the two kinds are equal."""
    rng = random.Random(4)
    filler = ["walk", "river", "stone", "green", "table", "lamp", "cloud", "paper"]
    rows = []
    for i in range(1200):
        kind = i % 6
        extra = {0: ["uglyone", "groupex"], 1: ["badtwo", "wycrowd"], 2: ["uglyone", "wycrowd"], 3: ["badtwo", "groupex"]}.get(kind, [])
        words = rng.choices(filler, k=8) + extra
        rng.shuffle(words)
        rows.append((i, " ".join(words) + f" n{i}", int(kind < 2)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, y int").drop("y"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    s = toxicity.Settings(max_docs=2000, min_z=2.0)
    m = toxicity.train(docs, labels, s)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, m).collect()}
    assert sum(got[i] == y for i, _, y in rows) / len(rows) >= .97
    m.v[:] = 0
    assert sum((p >= .5) == y for p, (_, _, y) in zip(m.scores([m.present(t) for _, t, _ in rows]), rows, strict=True)) / len(rows) < .95


def test_awkward_texts_and_columns(spark, machine):
    text = "you are an idiot and a loser, stupid moron " * 3
    rows = [(1, None, 9.0, "x"), (2, "", 9.0, "x"), (3, " \n", 9.0, "x"), (None, text, 9.0, "x"), (4, text, 9.0, "x"), (4, text, 9.0, "x"), (5, text * 3000, 9.0, "x"), (6, "a", 9.0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, `_x y` string")
    out = toxicity.score(df, machine)
    assert out.columns == ["doc_id", "text", "_x y", "score", "predicted"]
    got = out.collect()
    empty = 1 / (1 + np.exp(-machine.bias))
    assert all(abs(r.score - empty) < 1e-12 and r.predicted == 0 for r in got if r.doc_id in (1, 2, 3))
    assert len({r.score for r in got if r.doc_id in (None, 4, 5)}) == 1 and all(r.predicted == 1 for r in got if r.doc_id in (None, 4, 5))
    assert toxicity.score(df.limit(0), machine).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "word"), (2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 0), (3, None), (1, 0)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0)):
        assert toxicity.train(docs, lab, QUICK) is None
    assert {(r.score, r.predicted) for r in toxicity.score(docs, None).collect()} == {(0.0, 0)}


def test_sample_is_bounded_and_independent_of_partitions(spark):
    docs = spark.range(6000).select((F.col("id") % 4000).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    hot = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("more "), F.col("id")).alias("text"))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 7).cast("int").alias("toxic"), F.lit("z").alias("text"))
    s = toxicity.Settings(max_docs=300)
    got = [sorted(tuple(r) for r in toxicity.sample(d.repartition(n), labels, s).collect()) for d, n in ((docs.union(hot), 3), (docs.union(hot), 5))]
    assert got[0] == got[1] and all(100 <= sum(r[2] == y for r in got[0]) <= 200 for y in (0, 1))
