"""Mixing, line dedup, near-dedup, packing against brute force, with awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import linededup, minhash, mixing, packing
from plumbline.llm import shingles as sh
from plumbline.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, d string, key string, node string, `a b` string, lines string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Rows of (doc_id, text, source) with more columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


def awkward():
    r = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(1, 60))), r.choice(["b", "é", "A", None, "a"])) for i in range(300)]
    rows += [(300, None, "a"), (301, "", "a"), (302, " \n\t ", "zero"), (None, "no id\nhere", "b"), (None, None, None), (5, "twice here", "b"), (5, "twice here", "b")]
    rows += [(400, " ".join(r.choices(words, k=9000)), "long"), (401, "one", "tiny")]
    return rows


def test_mixture_matches_brute_force(spark):
    rows = awkward()
    got = mixing.mixture(frame(spark, rows)).collect()
    sizes, by = Counter(), defaultdict(list)
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:  # capped sources leave, the rest share again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
        by[r.source].append(r)
    for s, rs in by.items():
        assert abs(sum(r.taken for r in rs) - target[s]) <= max(r["size"] for r in rs), s
    again = mixing.mixture(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_corpus_repeats_rows(spark):
    docs = frame(spark, awkward())
    plan = {(r.doc_id, r["size"]): r.copies for r in mixing.mixture(docs).collect()}
    out = mixing.take_mixture(docs)
    assert out.columns == docs.columns
    found = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in out.collect())
    once = {k: v for k, v in plan.items() if k[0] not in (None, 5)}
    assert {k: found.get(k, 0) for k in once} == once


def test_documents_without_words_are_taken_no_oftener_than_others(spark):
    """A source that is taken twice whole, the most there is: its empty texts too come twice, not a third time."""
    rows = [(i, "three words here", "a") for i in range(20)] + [(100 + i, " " * i or None, "a") for i in range(20)] + [(200 + i, "many words " * 40, "b") for i in range(100)]
    rows += [(900 + i, "", "c") for i in range(5)]
    docs = frame(spark, rows)
    got = mixing.mixture(docs).collect()
    assert {r.copies for r in got if r.source == "a"} == {2} and {r.copies for r in got if r.source == "c"} == {0}
    assert all(r.copies <= 2 for r in got)
    assert Counter(r.source for r in mixing.take_mixture(docs).collect())["a"] == 80


def test_mixture_of_nothing(spark):
    assert mixing.mixture(frame(spark, [])).count() == 0
    only_empty = mixing.mixture(frame(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [(r.taken, r.target) for r in only_empty] == [(0, 0.0)] * 2
    with pytest.raises(ValueError):
        mixing.targets(spark.createDataFrame([], "source string, source_size long"), ratio=3.0)


def strip(line):
    return line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("min_docs,min_chars", [(3, 1), (2, 4)])
def test_lines_match_brute_force(spark, min_docs, min_chars):
    r = random.Random(4)
    shared = ["Subscribe NOW", " subscribe now\t", "É", "e", "", "\x0bpage\r", "PAGE"]
    rows = [(i, "\n".join(r.choice([*shared, f"own {i} {r.random()}"]) for _ in range(r.randrange(1, 9))), "s") for i in range(60)]
    rows += [(None, None, "s"), (70, "", "s"), (70, "\n", "s"), (71, "page\npage", "s"), (71, "page\npage", "s"), (72, "\n".join(["page", "x"] * 3000), "s"), (None, "page", None)]
    docs = frame(spark, rows)
    out = linededup.dedup_lines(docs, min_docs, min_chars)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    count = Counter(k for _, t, _ in rows for k in {strip(x) for x in (t or "").split("\n")})
    bad = {k for k, n in count.items() if n >= min_docs and len(k) >= min_chars}
    want = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if strip(x) not in bad]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted(map(str, [(x.doc_id, x.text, x.n_lines, x.n_dropped) for x in out.collect()])) == sorted(map(str, want))
    assert linededup.dedup_lines(frame(spark, []), 2).count() == 0


def test_a_line_of_a_third_of_all_documents_goes(spark):
    docs = frame(spark, [(i, f"own {i}" + ("\nbanner" if i % 3 == 0 else ""), "s") for i in range(600)])
    assert linededup.dedup_lines(docs, 10).where("text like '%banner%'").count() == 0


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "one document\nseen", "s")] * 10 + [(None, "without id", "s")] * 10 + [(i, "seen", "s") for i in range(2, 11)]
    out = linededup.dedup_lines(frame(spark, rows), 10).collect()
    assert Counter((r.doc_id, r.text, r.n_dropped) for r in out) == Counter({(1, "one document", 1): 10, (None, "", 1): 10} | {(i, "", 1): 1 for i in range(2, 11)})


def brute_components(rows, width, percent):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return [(i, len(sets[k]), low.get(find(k)), i == low.get(find(k))) for k, (i, _, _) in enumerate(rows)]


def near_rows(seed):
    """Base texts with copies of many degrees of change, so that some links hold and some just do not."""
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(8):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(30, 200))]
        for _ in range(r.randrange(1, 14)):
            edit = r.choice([0, .01, .03, .05])
            text = [f"c{r.randrange(9999)}" if r.random() < edit else w for w in base]
            rows.append((i, " ".join(text).upper() if r.random() < .3 else "\n".join(text), "s"))
            i += 1
    base = [f"h{k}" for k in range(120)]
    for _ in range(60):  # one dense group
        text = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 8, 9, 10])):
            text[r.randrange(120)] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(text), "s"))
        i += 1
    r.shuffle(rows)
    return rows + [(i, None, "s"), (i + 1, "", "s"), (i + 2, " \t", "s"), (i + 3, "one", "s"), (i + 4, "ONE", "s"), (None, "one", "s"), (i + 5, "one two", "s"), (7, "again", "s"), (7, "again", "s"), (i + 6, "four five six seven eight", "s"), (i + 7, "four five six seven eight nine", "s")]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_brute_force(spark, width):
    rows = near_rows(width)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows), width, 80).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_components(rows, width, 80)))


def test_near_duplicates_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "_TILE", 4)
    rows = near_rows(11)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows), 2, 80).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_components(rows, 2, 80)))


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, []), 5).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(frame(spark, [(3, None, "s")]), 5).collect()] == [(3, 0, 3, True)]
    with pytest.raises(ValueError):
        minhash.near_duplicates(frame(spark, []), 5, percent=50)


def test_tables_find_pairs_at_the_threshold():
    """Of sets with similarity just over 0.8, the tensored tables miss about one in two thousand."""
    rng, missed = np.random.default_rng(1), 0
    for _ in range(400):
        both = rng.integers(0, 2**63, 180, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, 22, dtype=np.uint64)])) for _ in range(2))
        (la, ra), (lb, rb) = minhash._band_keys(a), minhash._band_keys(b)
        missed += not ((la == lb).any() and (ra == rb).any())
    assert missed <= 3


def test_histogram_is_an_upper_bound():
    rng = np.random.default_rng(2)
    for n, m, k in ((5, 9, 3), (200, 900, 150), (4000, 4100, 3900), (40, 40, 0)):
        both = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, x - k, dtype=np.uint64) * np.uint64(2)])) for x in (n, m))
        assert sh.most_shared(sh.histogram(a), sh.histogram(b)) >= sh.shared(a, b) == np.intersect1d(a, b).size


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(300)] + [(7, 7), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100} | {200 + i: 100 for i in range(300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def naive_best_fit(items, capacity, per_source):
    bins = []
    out = []
    for size, source, cluster in items:
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and cluster not in b["clusters"] and b["sources"][source] < per_source]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"left": capacity, "clusters": set(), "sources": Counter()})
        bins[k]["left"] -= size
        bins[k]["clusters"].add(cluster)
        bins[k]["sources"][source] += 1
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_equals_the_naive_search(seed):
    r = random.Random(seed)
    items = [(r.randrange(0, 40), r.choice("aaab"), r.randrange(60)) for _ in range(400)]
    assert packing.best_fit(*zip(*items, strict=True), 64, 3) == naive_best_fit(items, 64, 3)


def check_bins(rows, got, capacity, per_source, cluster_of):
    want = defaultdict(list)
    for i, t, s in rows:
        want[(i, s)].append(len(WORD.findall(t or "")))
    have, bins = defaultdict(list), defaultdict(list)
    for r in got:
        have[(r.doc_id, r.source)].append(r)
        bins[r.bin_id].append(r)
    assert {k: sum(v) for k, v in want.items()} == {k: sum(r.n_words for r in v) for k, v in have.items()}
    for k, v in want.items():
        if len(v) == 1:
            assert sorted((r.piece, r.first_word) for r in have[k]) == [(p, p * capacity) for p in range(max(1, math.ceil(v[0] / capacity)))]
    for b in bins.values():
        assert sum(r.n_words for r in b) <= capacity
        assert max(Counter(r.source for r in b).values()) <= per_source
        clusters = [cluster_of(r) for r in b]
        assert len(set(clusters)) == len(clusters)


def test_packing_keeps_every_word_and_no_conflict(spark):
    rows = awkward() + [(500 + i, "the same text", "hot") for i in range(40)]
    texts = {(i, s): (t or "").strip().lower() for i, t, s in rows}
    got = packing.pack(frame(spark, rows), capacity=100, per_source=3).collect()
    check_bins(rows, got, 100, 3, lambda r: texts[(r.doc_id, r.source)])
    assert sum(r.n_words for r in got) / (100 * len({r.bin_id for r in got})) > .7
    assert packing.pack(frame(spark, [])).count() == 0
    by_id = packing.pack(frame(spark, rows), 100, 3, cluster=F.lit(1)).collect()
    assert len({r.bin_id for r in by_id}) == len(by_id)
    with pytest.raises(ValueError):
        packing.pack(frame(spark, []), capacity=0)


def test_packing_in_many_tasks_is_repeatable(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_TASK", 60)
    rows = awkward()
    first, second = (sorted(map(str, packing.pack(frame(spark, rows), 64, 2).collect())) for _ in range(2))
    assert first == second and len({r.split("bin_id=")[1] for r in first}) > 5


def test_near_copies_share_no_bin(spark, sf):
    """The query's own bins: no two documents of a group of near copies stand in one, and every word is packed once."""
    from plumbline.llm.queries import op9_best_fit_packing
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    group = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    bins, words = defaultdict(list), Counter()
    for r in op9_best_fit_packing(spark, sf).collect():
        bins[r.bin_id].append(r)
        words[r.doc_id] += r.n_words
    assert words == {k: len(WORD.findall(t or "")) for k, t in texts.items()}
    for rows in bins.values():
        assert sum(r.n_words for r in rows) <= 2048
        named = [group[r.doc_id] for r in rows]
        assert len(set(named)) == len(named)
    assert len(set(group.values())) < len(group)


def test_near_dedup_with_columns_that_have_no_order(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, {"b": 2}), (1, text, {"a": 1}), (2, text, {"c": 3}), (3, "other words " * 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra map<string, int>")
    kept = sorted((r.doc_id, r.extra) for r in minhash.drop_near_duplicates(df).collect())
    assert kept == [(1, {"a": 1}), (3, None)]


def test_one_very_large_bucket(spark):
    """Hundreds of near copies of one text, all in the same buckets, beside strays that share some of them."""
    r = random.Random(12)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    rows = [(i, " ".join([*base[:-1], f"end{i}"]), "s") for i in range(400)]
    rows += [(1000 + i, " ".join([*base[:60], *[f"x{i}y{j}" for j in range(60)]]), "s") for i in range(40)]
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(frame(spark, rows), 2, 80).collect()}
    assert {got[i] for i in range(400)} == {0} and all(got[1000 + i] == 1000 + i for i in range(40))
    plan = minhash._grouped(frame(spark, rows), 2, 80)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("width", [2, 5])
def test_sets_of_texts_side_by_side(width, monkeypatch):
    """Texts that lie end to end have the sets and word counts that each has alone, wherever blocks and chunks end."""
    monkeypatch.setattr(minhash, "_BYTES", 300)
    monkeypatch.setattr(sh, "_CHUNK", 50)
    r = random.Random(5)
    texts = ["".join(r.choice("aAbé \n\t") for _ in range(r.randrange(120))) for _ in range(200)] + [None, "", " \n", "w" * 400 + " X", "one", "ONE", "a\x00b \x1c c\xa0d"]
    r.shuffle(texts)
    rows = [x for raw, bounds in minhash._blocks(pa.array(texts, pa.string())) for x in minhash._summaries(raw, bounds, width).to_pylist()]
    words = [WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    sets = [{tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()) for w in words]
    assert [(x["words"], x["n"]) for x in rows] == [(len(w), len(s)) for w, s in zip(words, sets, strict=True)]
    nodes = defaultdict(set)
    for x, s in zip(rows, sets, strict=True):
        nodes[x["node"]].add(frozenset(s))
    assert all(len(v) == 1 for v in nodes.values()) and len(nodes) == len({frozenset(s) for s in sets})
    for x, t in zip(rows, texts, strict=True):
        alone = sh.shingle_set(t, width)
        if alone.size < 4:
            assert x["left"] is None and x["right"] is None and x["histogram"] is None
        else:
            left, right = minhash._band_keys(alone)
            assert (x["left"], x["right"], x["histogram"]) == (left.tolist(), right.tolist(), sh.histogram(alone))


def test_packing_near_copies_reads_texts_once(spark, sf, monkeypatch):
    """op9 takes sizes and clusters from the near-duplicate step; packing itself reads no text."""
    from plumbline.llm.queries import op9_best_fit_packing
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    monkeypatch.setattr(packing, "n_words", None)
    words = Counter()
    for r in op9_best_fit_packing(spark, sf).collect():
        words[r.doc_id] += r.n_words
    assert words == {k: len(WORD.findall(t or "")) for k, t in texts.items()}


def test_clusters_of_every_row(spark):
    rows = near_rows(4)
    got = minhash.clusters(frame(spark, rows), 5, 80, carry=["source", "a b"]).collect()
    assert Counter((r.doc_id, r.words, r["source"], r["a b"]) for r in got) == Counter((i, len(WORD.findall(t or "")), s, "x") for i, t, s in rows)
    group = defaultdict(set)
    for i, _, low, _ in brute_components(rows, 5, 80):
        group[i].add(low)
    found = defaultdict(set)
    for r in got:
        if r.doc_id is not None and r.cluster is not None:
            found[r.cluster] |= group[r.doc_id]
    assert all(len(v) == 1 for v in found.values())
    assert {r.doc_id for r in got if r.cluster is None} == {i for i, t, _ in rows if not WORD.search(t or "")}
