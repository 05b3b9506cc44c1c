"""Language ID on held-out rows, and the pipeline's stages against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import langid, queries
from plumbline.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
QUICK = langid.Settings(max_docs=400, epochs=4)


@pytest.fixture(scope="module")
def net(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return langid.train(docs.where(~langid.held_out(F.col("doc_id"))), QUICK)


def test_held_out_accuracy(spark, sf, net):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(langid.held_out(F.col("doc_id")))
    rows = langid.identify(docs, net).select("lang", "lang_pred", "score").collect()
    assert len(rows) > 40 and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= .9
    assert all(0 < r.score <= 1 for r in rows) and set(net.languages) == {"de", "en", "es", "fr"}


def test_awkward_texts_and_columns(spark, net):
    text = "the and of that with this there in the house and the garden " * 5
    rows = [(1, None, 0.5, "x"), (2, "", 0.5, "x"), (3, "123 ... \n", 0.5, "x"), (None, text, 0.5, "x"), (4, text, 0.5, "x"), (4, text, 0.5, "x"), (5, "é", 0.5, "x"), (6, text * 3000, 0.5, "x"), (7, "½ ²", 0.5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, `_x y` string")
    out = langid.identify(df, net)
    assert out.columns == ["doc_id", "text", "_x y", "lang_pred", "score"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in out.collect()]
    for i, lang, score in got:
        assert (lang == "und" and score == 0) if i in (1, 2, 3, 7) else (lang in net.languages and 0 < score <= 1)
    assert len({x[1:] for x in got if x[0] in (None, 4)}) == 1
    assert langid.identify(df.limit(0), net).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "word", None), (2, None, "en"), (3, "123", "en")], "doc_id long, text string, lang string")
    assert langid.train(df, QUICK) is None
    assert {(r.lang_pred, r.score) for r in langid.identify(df, None).collect()} == {("und", 0.0)}


def test_training_sample_does_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s = langid.Settings(max_docs=60, epochs=1)
    a, b = langid.train(docs, s), langid.train(docs.repartition(7), s)
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))


def test_rare_languages_are_learned(spark):
    rows = [(f"the text number {i} of many", "en") for i in range(400)] + [(f"el texto {i}", "es") for i in range(3)] + [("ein Satz", "de")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    net = langid.train(docs, langid.Settings(max_docs=20, epochs=1))
    assert net.languages == ["de", "en", "es"]
    for counts, total, want in (([400, 3, 1], 20, 16), ([5, 5], 20, 5), ([50, 50, 50], 20, 6), ([9] * 30, 20, 1), ([], 20, 0)):
        assert langid.quota(counts, total) == want


def test_windows_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 509, 510, 5000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        cut, size = langid.windows(text, 256, 3)
        back = b"".join([cut[0].tobytes()] + [c.tobytes()[3:] for c in cut[1:]])
        assert back[:n] == text.encode() and set(back[n:]) <= {32} and size.sum() == n + 3 * (len(size) - 1)


def test_pair_tables_give_the_same_responses(net):
    x = np.random.default_rng(1).integers(97, 122, (20, 256)).astype(np.uint8)
    high = np.concatenate([sum(t[j][x[:, j:256 - w + 1 + j]] for j in range(w)).max(axis=1) for t, w in zip(net.tables, net.s.widths, strict=True)], axis=1)
    logits = np.maximum(high, 0) @ net.out + net.bias
    logits -= logits.max(axis=1, keepdims=True)
    assert np.allclose(net.log_probabilities(x), logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)), atol=1e-4)


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})


def shingle(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.limit(1).select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.lit("12 34 !!").alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "best_fit_packing"]
    frames = [docs]
    for _, step in corpus_pipeline.STAGES:
        frames.append(step(spark, frames[-1], sf).cache())
    tables = [f.collect() for f in frames]
    assert all(f.columns == docs.columns for f in frames[1:5])
    first, named, lines, unique, mixed, packed = tables
    assert {r.doc_id for r in first} - {r.doc_id for r in named} == {r.doc_id for r in first if r.doc_id >= 1_000_000}

    count = Counter(k for r in named for k in {key(x) for x in (r.text or "").split("\n")} if k)
    want = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if count[key(x)] < 10) for r in named}
    assert {r.doc_id: r.text for r in lines} == want and all(r.n_chars == len(r.text) for r in lines)

    sets, root = {r.doc_id: shingle(r.text) for r in lines}, {r.doc_id: r.doc_id for r in lines}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * (n := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - n):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {r.doc_id for r in unique} == {k for k, v in root.items() if k == v}

    size = {r.doc_id: len(WORD.findall(r.text)) for r in unique}
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= set(size) and max(copies.values()) <= 2
    total, by = Counter(), defaultdict(int)
    for r in unique:
        total[r.source] += size[r.doc_id]
    for r in mixed:
        by[r.source] += size[r.doc_id]
    plan = {r.source: r.target for r in corpus_pipeline.mixing.mixture(frames[3]).select("source", "target").distinct().collect()}
    for s in total:
        assert abs(by[s] - plan[s]) <= max(size[r.doc_id] for r in unique if r.source == s)

    words, bins = Counter(), defaultdict(list)
    for r in packed:
        words[r.doc_id] += r.n_words
        bins[r.bin_id].append(r)
    assert words == Counter({i: n * size[i] for i, n in copies.items()})
    assert sum(max(1, math.ceil(size[i] / 2048)) * n for i, n in copies.items()) == len(packed)
    for b in bins.values():
        assert sum(r.n_words for r in b) <= 2048 and len({r.doc_id for r in b}) == len(b) and max(Counter(r.source for r in b).values()) <= 4


def test_texts_in_three_languages_and_of_one_word_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = {r.lang: r.text for r in docs.where("length(text) between 2000 and 6000").orderBy("doc_id").collect()}
    mixed = ["\n".join(long[k][:1900] for k in three) for three in (("de", "en", "es"), ("fr", "de", "en"), ("es", "fr", "de"))]
    texts = [*mixed, "ok", "Haus", "é", "x", "12 34", "", None]
    extra = spark.createDataFrame([(2_000_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    extra = extra.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    named = corpus_pipeline.identify_language(spark, docs.unionByName(extra), sf)
    assert {r.doc_id - 2_000_000 for r in named.where("doc_id >= 2000000").select("doc_id").collect()} == set(range(7))


def test_near_dedup_keeps_one_row_per_group_with_null_and_repeated_ids(spark, sf):
    words = lambda name: [f"{name}{i}" for i in range(60)]
    near = lambda name, at: " ".join(w if i != at else "changed" for i, w in enumerate(words(name)))
    rows = [(1, near("a", 0)), (None, near("a", 1)), (None, near("a", 58)),  # a group with an id
            (None, near("b", 0)), (None, near("b", 1)), (None, near("b", 1)),  # one without
            (5, near("c", 0)), (5, near("d", 0)), (2, near("d", 1)),  # id 5 is first in one group and not in the other
            (7, near("e", 0)), (7, near("e", 0)), (7, near("e", 1)), (7, near("e", 59)),  # one id, equal and near rows
            (None, None), (None, ""), (None, ""), (8, " ")]  # without words: linked with nothing
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    group = lambda t: t.split()[5][0] if t and t.strip() else None
    assert Counter(group(t) for _, t in got) == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 1, None: 4}
    assert {group(t): i for i, t in got if group(t)} == {"a": 1, "b": None, "c": 5, "d": 2, "e": 7}
    again = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(5), sf).collect()]
    assert Counter(got) == Counter(again)


def test_every_operator_has_a_query():
    assert queries.QUERIES is QUERIES
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(i) for i in range(1, 14)}
