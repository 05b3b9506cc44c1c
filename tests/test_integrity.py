"""Deduplication, near-duplicate search, containment, sampling and checks against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.fingerprint import neighbour_fingerprint, payload_kind
from plumbline.operators import containment, decontaminate as dc, expectations as ex, neardup, sampling as sp
from plumbline.plans import integrity, views as V
from plumbline.session import cut_lineage


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def popcount(a, b):
    return bin((a ^ b) & (2 ** 64 - 1)).count("1")


def near_set(seed, n, flips):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n)]
    out = set(base)
    for b in base:
        for k in range(flips + 1):
            x = b
            for p in rng.sample(range(64), k):
                x ^= 1 << p
            out.add(x)
    return sorted(signed(x) for x in out)


@pytest.mark.parametrize("distance,blocks,hot", [(1, None, 10_000), (2, None, 10_000), (3, 4, 10_000), (3, 6, 10_000), (5, 7, 10_000), (3, 5, 3), (2, 4, 0)])
def test_near_pairs_match_brute_force(spark, distance, blocks, hot):
    fps = near_set(distance * 10 + (blocks or 0), 25, distance + 1)
    want = {(a, b): popcount(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if popcount(a, b) <= distance}
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    got = {(r.fp_left, r.fp_right): r.distance for r in neardup.near_pairs(df, distance, blocks=blocks, hot_key=hot).collect()}
    assert got == want


def test_one_dominant_cluster(spark):
    """Patterns that share most bits all meet under the same keys; refinement must lose none of the pairs."""
    rng = random.Random(4)
    fps = sorted({signed((rng.getrandbits(20) << 44) | 0xABCDE) for _ in range(300)})
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if popcount(a, b) <= 3}
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    assert {(r.fp_left, r.fp_right) for r in neardup.near_pairs(df, 3, hot_key=20).collect()} == want


@pytest.mark.parametrize("hot", [3, 10_000])
def test_links_of_dense_clusters_on_each_side(spark, hot):
    """A whole cube of patterns: thousands of pairs, a row for each fingerprint."""
    cube = [signed((0xF00D << 40) | sum(1 << (7 * j) for j in range(8) if i >> j & 1)) for i in range(256)]
    other = [signed(c ^ (1 << 63) ^ (1 << 3)) for c in cube[::3]] + [signed(1 << 62)]
    ids = {f: (i * 37) % 101 for i, f in enumerate(cube)}  # first ids that repeat
    df = spark.createDataFrame(list(ids.items()), "fp bigint, first_id int")
    got = {r.fp: (r.rep_fp, r.distance) for r in neardup.representative_links(df, 2, hot_key=hot).collect()}
    want = {}
    for f in cube:
        before = [(ids[g], g) for g in cube if g != f and popcount(f, g) <= 2 and (ids[g], g) < (ids[f], f)]
        if before:
            want[f] = (min(before)[1], popcount(f, min(before)[1]))
    assert got == want and len(got) < len(cube)
    links = neardup.nearest_links(spark.createDataFrame([(f,) for f in other], "fp bigint"), df, 3, hot_key=hot).collect()
    best = {f: min((popcount(f, c), c) for c in cube) for f in other}
    assert {r.fp: (r.distance, r.ref_fp) for r in links} == {f: b for f, b in best.items() if b[0] <= 3} and len(links) == len(other) - 1


@pytest.fixture()
def crowded(spark, tmp_path):
    """A folder with embeddings of thirty patterns that lie within three bits of another, one of them twice."""
    patterns = [0x5A5A << 30] + [(0x5A5A << 30) ^ (1 << i) ^ (1 << j) for i in range(5, 10) for j in range(20, 26)]
    rows = []
    for i, f in enumerate([*patterns, patterns[0]]):
        e = [0.0]
        for b in range(63):
            e.append(e[-1] + (-1.0 if f >> (62 - b) & 1 else 1.0))
        rows.append((i, i % 10, e))
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    folder = str(tmp_path)
    near, ref = ([(r.fp, r.vec_id) for r in f(spark, folder).collect()] for f in (V.fp_near, V.fp))

    def counted(pairs):
        of = defaultdict(list)
        for f, i in pairs:
            of[f].append(i)
        return {f: (min(i), len(i)) for f, i in of.items()}
    return folder, counted(near), counted(ref), counted(near + ref)


def test_near_duplicates_of_reference_are_all_pairs(spark, crowded):
    folder, near, ref, _ = crowded
    want = {(*c, *r, popcount(f, g)) for f, c in near.items() for g, r in ref.items() if popcount(f, g) <= 3}
    got = [tuple(r) for r in integrity.near_duplicates_of_reference(spark, folder).collect()]
    assert set(got) == want and len(got) == len(want) > len(near)


def test_near_duplicates_internal_are_all_pairs(spark, crowded):
    folder, _, _, pool = crowded
    pairs = [(*sorted((a, b)), popcount(f, g)) for f, a in pool.items() for g, b in pool.items() if f < g and popcount(f, g) <= 2]
    got = [tuple(r) for r in integrity.near_duplicates_internal(spark, folder).collect()]
    assert sorted(got) == sorted((a[0], b[0], d, a[1], b[1], a[1] * b[1]) for a, b, d in pairs) and len(got) > len(pool)


def test_keys_to_the_last_bit_hold_few_patterns(spark):
    """All 4,096 patterns of twelve bits share most keys; at the end no key has more than 2**d of them."""
    df = spark.range(4096).select(F.expr("shiftleft(id, 20)").alias("fp"))
    left, right, on = neardup.candidate_keys(df, df, 2, 4, 50)
    assert left.groupBy(*on).count().agg(F.max("count")).first()[0] <= 50
    assert left.where("out <> 0").groupBy(*on).count().agg(F.max("count")).first()[0] <= 4
    pairs = neardup.near_pairs(df, 2, blocks=4, hot_key=50).count()
    assert pairs == 4096 * (12 + 66) // 2


def test_nearest_reference_at_any_distance(spark):
    rng = random.Random(8)
    refs = [(signed(rng.getrandbits(64)), rng.randrange(40), i) for i in range(300)]
    refs += [(refs[0][0], 0, 900), (signed(0), 7, 901), (signed(3), 7, 902)]
    cands = {r[0] ^ 1 for r in refs[:20]} | {signed(rng.getrandbits(64)) for _ in range(60)} | {refs[5][0], signed(1), signed(2**64 - 1), refs[0][0]}
    df = spark.createDataFrame(refs, "fp bigint, ref_order int, ref_id int")
    got = neardup.nearest_of_all(spark.createDataFrame([(c,) for c in cands], "fp bigint"), df)
    want = {c: min((popcount(c, f), o, i) for f, o, i in refs) for c in cands}
    assert {r.fp: (r.distance, r.ref_id) for r in got.collect()} == {c: (d, i) for c, (d, _, i) in want.items()}
    assert max(d for d, _, _ in want.values()) > 15
    few = neardup.nearest_of_all(spark.createDataFrame([(0,), (-1,)], "fp bigint"), df.limit(1))
    assert few.count() == 2
    assert neardup.nearest_of_all(spark.createDataFrame([(0,)], "fp bigint"), df.limit(0)).count() == 0


def test_nearest_of_all_keeps_finds_without_sorting_them(spark, monkeypatch):
    """All finds of a candidate are reduced to one number by hashing: memory follows the candidates, not the finds."""
    staged = []
    monkeypatch.setattr(neardup, "cut_lineage", lambda df: staged.append(df) or cut_lineage(df))
    refs = spark.range(64).select((F.col("id") * 3).alias("fp"), (-F.col("id")).alias("ref_order"), F.col("id").cast("string").alias("ref_id"))
    got = neardup.nearest_of_all(spark.range(5).select((F.col("id") * 3 + 1).alias("fp")), refs)
    fps = {3 * i: (-i, str(i)) for i in range(64)}
    assert {r.fp: (r.distance, r.ref_id) for r in got.collect()} == {c: min((popcount(c, f), *o) for f, o in fps.items())[::2] for c in range(1, 16, 3)}
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in staged[3:]]
    assert plans and all("HashAggregate" in x and "SortAggregate" not in x and "ObjectHash" not in x for x in plans)


def test_nearest_reference_ties_go_to_the_first(spark):
    ref = spark.createDataFrame([(0b0001, 2, "b"), (0b0010, 1, "a"), (1 << 40, 3, "c")], "fp bigint, ref_order int, ref_id string")
    got = neardup.nearest_reference(spark.createDataFrame([(0,), (-1,)], "fp bigint"), ref, 2).collect()
    assert [(r.fp, r.distance, r.ref_id) for r in got] == [(0, 1, "a")]
    with pytest.raises(ValueError):
        neardup.within_distance(ref, ref, 8)


def test_fingerprints(spark):
    df = spark.createDataFrame([([3.0, 2.0, 2.0, 5.0],), ([1.0],)], "e array<double>")
    assert [r[0] for r in df.select(neighbour_fingerprint("e", 3)).collect()] == [0b100, None]
    null = spark.createDataFrame([(None, 1), (7, 2), (7, 3)], "fp bigint, id int")
    assert [(r.fp, r.members, r.first_id) for r in neardup.distinct_fingerprints(null, "fp", "id").collect()] == [(7, 2, 2)]


def test_payload_kind(spark):
    heads = [(b"\xff\xd8\xff\xe0abc", "jpg"), (b"\x89PNG\r\n\x1a\n", "png"), (b"RIFF\x10\x00\x00\x00WEBPVP8 ", "webp"), (b"RIFF\x10\x00\x00\x00WAVE", "png"), (b"x", "png")]
    df = spark.createDataFrame([(bytearray(h), k) for h, k in heads], "c binary, k string")
    assert [r[0] for r in df.select(payload_kind("c")).collect()] == [k for _, k in heads]


def test_text_rules(spark):
    texts = [("Remove the dog and add a cat", "object_removal", "object_removal"), ("Make the SKY purple", "background_replacement", "background_replacement"),
             ("at this address", "object_insertion", "object_insertion"), ("sharpen", "inpainting", "inpainting"), ("a hat on the dog", "face_modification", "inpainting"),
             ("replace the background", "background_replacement", "object_insertion")]
    df = spark.createDataFrame(texts, "t string, v1 string, v2 string")
    got = df.select(tx.first_keyword_label("t", tx.EDIT_RULES_V1), tx.first_keyword_label("t", tx.EDIT_RULES_V2), "v1", "v2").collect()
    assert all(r[0] == r[2] and r[1] == r[3] for r in got)


def test_year_and_ids(spark):
    rows = [("1923-05-01", "1923"), ("about 01/02/1888", "1888"), ("99999999999999 1799 2027", None), ("c1900", None), ("12 1850 1900", "1850"), ("", None)]
    df = spark.createDataFrame(rows, "t string, y string")
    assert all(r[0] == r[1] for r in df.select(tx.year_in_text("t"), "y").collect())
    ids = spark.createDataFrame([("mb_orig_77_turn1",), ("manip_8",), ("9",)], "i string")
    assert [r[0] for r in ids.select(tx.source_id("i", ["mb_orig_", "orig_", "manip_"])).collect()] == ["77", "8", "9"]


def test_containment_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["aa", "bb", "cc", "dd", "ee"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(5, 60)))) for i in range(120)]
    docs.append((500, "xxaa bb cc dd ee aa bb cc ddxx"))
    passages = [(i, " ".join(rng.choices(words, k=k))) for i, k in enumerate([3, 4, 5, 7, 8, 9, 10, 12])]
    for i, (_, d) in enumerate(docs[:6]):
        passages.append((100 + i, d[2:-2]))
    passages.append((200, "aa bb cc dd ee aa bb cc dd"))
    passages.append((201, "aa bb cc dd ee aa bb cc dd"))
    passages += [(300 + i, "aa bb cc dd ee aa " + " ".join(rng.choices(words, k=3))) for i in range(20)]
    docs += [(501, "alpha"), (502, "xalphay beta gammaz"), (503, " lead and trail "), (504, ""), (505, None), (506, "日本語のテキスト")]
    passages += [(400 + i, q) for i, q in enumerate(["beta gamma", "alpha", "alpha beta gamma", "ha", "a", " ", "a be", "lead ", " lead and", "本語", "nowhere", "aa bb", "e a", "beta gammaz"])]
    want = {(d, p) for d, t in docs for p, q in passages if t is not None and q in t}
    passages.append((499, None))
    got = containment.contained_passages(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text", spark.createDataFrame(passages, "item_id int, text string"), "item_id", "text")
    with pytest.raises(Exception, match="empty passage"):
        containment.contained_passages(spark.createDataFrame(docs, "doc_id int, text string"), "doc_id", "text", spark.createDataFrame([(1, "")], "item_id int, text string"), "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and {(500, 200), (500, 201)} <= want


def test_first_failing_key_and_blacklist(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, sha string")
    known = spark.createDataFrame([(1, "b"), (1, "b")], "id int, sha string")
    got = {r.id: r.exclude_reason for r in dc.first_failing_key(df, [("id", "id", known), ("sha", "sha", known)]).collect()}
    assert got == {1: "id", 2: "sha", 3: None, 4: None}
    members = known.withColumn("n", F.lit("p")).withColumn("origin", F.lit("x")).unionByName(df.withColumn("n", F.lit("q")).withColumn("origin", F.lit("y")))
    black = dc.blacklist(members, "sha", "n")
    b = {r.sha: (r.n_members, r.origins, r.first_origin) for r in black.collect()}
    assert b["b"] == (3, "x,y", "x") and None not in b
    assert {r.id for r in dc.without(df, known, "sha").collect()} == {1, 3, 4}


def test_keep_first_and_overlap(spark):
    df = spark.createDataFrame([("h", 2, 9, "x"), ("h", 1, 12, "y"), ("h", 1, 11, "z"), ("k", 3, 1, "x")], "sha string, prio int, id int, split string")
    got = {r.sha: (r.id, r.split, r.copies) for r in dc.keep_first(df, "sha", ["prio", "id"], ["id", "split"]).collect()}
    assert got == {"h": (11, "z", 3), "k": (1, "x", 1)}
    o = {(r.left_split, r.right_split): r.shared_keys for r in dc.cross_split_overlap(df.unionByName(spark.createDataFrame([("m", 1, 1, "q"), (None, 1, 1, "x"), (None, 1, 1, "y")], df.schema)), "sha", "split").collect()}
    assert o == {("x", "y"): 1, ("x", "z"): 1, ("y", "z"): 1, ("q", "x"): 0, ("q", "y"): 0, ("q", "z"): 0}


def test_compare_reported(spark):
    rep = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("c", 3.0), ("e", None)], "k string, value double")
    rec = spark.createDataFrame([("a", 1.0000001), ("b", 2.1), ("c", 3.0), ("d", 4.0), ("e", 1.0)], "k string, value double")
    got = {r.k: (r.status, r.note) for r in dc.compare_reported(rep, rec, ["k"], 1e-6).collect()}
    assert got == {"a": ("PASS", "within tolerance"), "b": ("FAIL", "differs"), "c": ("FAIL", "ambiguous"), "d": ("FAIL", "not reported"), "e": ("FAIL", "differs")}


def test_splits_are_disjoint_exhaustive_and_sized(spark):
    df = spark.range(1003).withColumn("c", (F.col("id") % 4 == 0).cast("int"))
    got = sp.split_by_shares(df, ["c"], "id", "s").collect()
    assert len(got) == 1003 and len({r.id for r in got}) == 1003
    for c in (0, 1):
        n = sum(1 for i in range(1003) if int(i % 4 == 0) == c)
        counts = Counter(r.split for r in got if r.c == c)
        assert counts["train"] == int(n * 0.70) and counts["validation"] == int(n * 0.15) and sum(counts.values()) == n
    grouped = sp.split_groups(df.withColumn("g", F.col("id") % 50), "g", "s").collect()
    where = defaultdict(set)
    for r in grouped:
        where[r.g].add(r.split)
    assert all(len(v) == 1 for v in where.values())
    assert Counter(next(iter(v)) for v in where.values()) == {"train": 35, "validation": 7, "test": 8}


def test_fixed_split_folds_and_draws(spark):
    df = spark.range(200).withColumn("c", (F.col("id") % 2).cast("int")).withColumn("g", F.when(F.col("id") >= 180, "new").otherwise("old"))
    c = Counter((r.c, r.split) for r in sp.split_fixed(df, ["c"], "id", "s", [("train", 50), ("test", 20)], held_out=F.col("g") == "new").collect())
    assert c[(0, "train")] == c[(1, "train")] == 50 and c[(0, "test")] == 20 and c[(0, "unused")] == 20 and c[(0, "test_unseen")] == 10
    f = Counter((r.c, r.fold) for r in sp.folds(df, ["c"], "id", "s").collect())
    assert all(f[(k, i)] == 20 for k in (0, 1) for i in range(5))
    pool = df.withColumn("ok", F.col("id") % 3 != 0)
    log = sp.audited_draw(pool, "c", "id", "ok", 12, "s").collect()
    for k in (0, 1):
        mine = sorted([r for r in log if r.c == k], key=lambda r: r["rank"])
        assert sum(r.ok for r in mine) == 12 and mine[-1].ok and [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert all(r.is_replacement == (r["rank"] > 12) for r in mine)


def test_quota_fill_and_names(spark):
    high = spark.createDataFrame([(i, "a") for i in range(3)], "id int, l string")
    low = spark.createDataFrame([(100 + i, "a" if i % 2 else "b") for i in range(20)], "id int, l string")
    c = Counter((r.l, r.filled) for r in sp.fill_to_target(high, low, "l", "id", 5, "s").collect())
    assert c == {("a", False): 3, ("a", True): 2, ("b", True): 5}
    names = sp.sequential_names(low, ["l"], "id", F.lit(7), "x_", 4).where("l = 'b'").orderBy("id").collect()
    assert [r.name for r in names][:2] == ["x_0008", "x_0009"] and names[-1].number == 17


def test_expectations(spark):
    df = spark.createDataFrame([(1, "p", "t"), (0, "p", "t"), (1, "q", "t"), (0, "q", "v"), (1, "r", "t")], "gt int, pair string, split string")
    got = {r.pair: r.valid for r in ex.pair_checks(df, "pair", "gt", "split").collect()}
    assert got == {"p": True, "q": False, "r": False}
    checks = ex.checks_from_aggregates(df, {"rows": (F.count("*"), 5), "ones": (F.sum("gt"), 9)})
    with pytest.raises(ex.ExpectationFailed, match="ones"):
        ex.gate(checks)
    with pytest.raises(ex.ExpectationFailed, match="nope"):
        ex.require_columns(df, ["gt", "nope"])
    v = {r.check_name: r.violations for r in ex.violation_counts(df, {"gt01": F.col("gt").isin(0, 1), "split_t": F.col("split") == "t"}).collect()}
    assert v == {"gt01": 0, "split_t": 1}


def test_ledger(spark):
    led = spark.createDataFrame([("a", "AB"), ("b", "cd"), ("c", "ef")], "path string, sha256 string")
    act = spark.createDataFrame([("a", "ab"), ("b", "xx"), ("d", "ef")], "path string, sha256 string")
    assert {r.path: r.status for r in ex.ledger_check(led, act).collect()} == {"a": "MATCH", "b": "MISMATCH", "c": "MISSING", "d": "UNLISTED"}


def test_one_key_holds_a_third_of_all_rows(spark):
    """A hot text, a hot stratum and a hot fingerprint: results stay whole and no pairs of members appear."""
    n = 3000
    df = spark.range(n).select("id", F.when(F.col("id") < n // 3, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("sha"), (F.col("id") % 5 == 0).alias("v"),
                               F.when(F.col("id") < n // 3, F.lit(0)).otherwise(F.col("id") * 7919).cast("bigint").alias("fp"))
    first = {r.sha: (r.id, r.copies) for r in dc.keep_first(df, "sha", ["id"], ["id"]).collect()}
    assert first["hot"] == (0, n // 3) and len(first) == n - n // 3 + 1
    assert dc.without(df, spark.createDataFrame([("hot",)], "sha string"), "sha").count() == n - n // 3
    split = sp.split_by_shares(df.withColumn("s", F.lit("one")), ["s"], "id", "x")
    assert Counter(r.split for r in split.collect()) == {"train": 2100, "validation": 450, "test": 450}
    fps = neardup.distinct_fingerprints(df, "fp", "id")
    assert fps.where("fp = 0").first().members == n // 3
    pairs = neardup.near_pairs(fps, 1, hot_key=5)
    values = sorted({0} | {i * 7919 for i in range(n // 3, n)})
    have = set(values)
    want = sum(1 for v in values for b in range(40) if (w := v ^ (1 << b)) > v and w in have)
    assert pairs.count() == want


def test_samples_beyond_a_thousand_gather_no_stratum(spark):
    df = spark.range(12_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"))
    got = sp.sample_per_stratum(df, "k", "id", 5000, "s")
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {"a": 4000, "b": 5000}
    assert {r.id for r in sp.sample_per_stratum(df, "k", "id", 50, "s").collect()} <= {r.id for r in got.collect()}
    first = sp.first_per_category(df, "k", "id", {"b": 3000})
    assert {r.id for r in first.collect()} == {i for i in range(4500) if i % 3}
    for frame in (got, first):  # every window works inside a bucket or over bucket totals
        windows = [x for x in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if x.strip(" +-:").startswith("Window ")]
        assert windows and all("_k" in x for x in windows)


def exchanged_rows(df):
    """Rows written to shuffles by running the plan of ``df``, staged tables before it not counted."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0

    def walk(node):
        nonlocal total
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        if node.nodeName().endswith("QueryStage"):
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
    walk(plan)
    return total


def test_samples_move_no_rows_of_the_pool(spark):
    n = 40_000
    df = spark.range(0, n, 1, 4).select(F.col("id"), F.when(F.col("id") % 3 == 0, None).otherwise("b").alias("k"), (F.col("id") % 7 > 0).alias("ok"))
    sample = sp.sample_per_stratum(df, "k", "id", 50, "s")
    audited = sp.audited_draw(df, "k", "id", "ok", 30, "s")
    fixed = sp.split_fixed(df, ["k"], "id", "s", [("a", 20), ("b", 10)])
    filled = sp.fill_to_target(df.where("id < 10"), df.where("id >= 10"), "k", "id", 40, "s")
    for frame in (sample, audited, fixed, filled):
        assert exchanged_rows(frame) < 1500
    by_rank = {k: sorted((hashlib.md5(f"s:{i}".encode()).hexdigest(), i) for i in range(n) if (None if i % 3 == 0 else "b") == k) for k in (None, "b")}
    assert {(r.k, r.id): r["rank"] for r in sample.collect()} == {(k, i): j + 1 for k, rows in by_rank.items() for j, (_, i) in enumerate(rows[:50])}
    want = set()
    for k, rows in by_rank.items():
        accepted = 0
        for _, i in rows:
            if accepted < 30:
                want.add((k, i))
            accepted += i % 7 > 0
    assert {(r.k, r.id) for r in audited.collect()} == want
    split = Counter((r.k, r.split) for r in fixed.collect())
    assert split[("b", "a")] == 20 and split[(None, "b")] == 10 and sum(split.values()) == n
    few = sp.sample_per_stratum(df.limit(20), "k", "id", 50, "s")
    assert few.count() == 20 and sp.sample_per_stratum(df.limit(0), "k", "id", 5, "s").count() == 0


def test_row_references_tell_equal_names_apart(spark, tmp_path):
    from plumbline.sources import scans
    for folder in ("one", "two"):
        spark.range(3).selectExpr("id", f"'{folder}' as origin").coalesce(1).write.parquet(str(tmp_path / folder))
        made = next((tmp_path / folder).glob("part-*.parquet"))
        made.rename(tmp_path / folder / "part-0.parquet")
    source = scans.shards(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    refs = source.select(F.concat_ws(":", "shard", F.col("row_in_shard").cast("string")).alias("storage_ref"), F.col("origin").alias("want"))
    rows = scans.resolve_rows(refs, source).collect()
    assert len(rows) == 6 and all(r.want == r.origin for r in rows) and {r.shard for r in rows} == {"one/part-0.parquet", "two/part-0.parquet"}
