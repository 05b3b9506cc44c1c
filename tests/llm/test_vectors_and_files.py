"""Vector operators, chat formatting, archives and token files: brute force and round trips."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import ann, chat, embdup, records, warc
from plumbline.llm.files import reading, writing

P = pytest.importorskip("public_tokenizers")
BPE = P.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int, node long, ids string"


def vectors(seed=0, n=220, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2:] = x[rng.integers(0, 12, n - n // 2)] + rng.normal(scale=.12, size=(n - n // 2, dim)) * rng.random((n - n // 2, 1)) * 2
    rows = [(i, [float(v) for v in np.float32(r)], i % 3) for i, r in enumerate(x)]
    rows += [(n + i, rows[3][1], None) for i in range(30)]  # copies
    rows += [(900, [2 * v for v in rows[3][1]], 1), (901, None, 1), (902, [], 1), (903, [0.0] * dim, 1), (904, [float("nan")] + [1.0] * (dim - 1), 1), (905, [float("inf")] + [1.0] * (dim - 1), 1),
             (906, [None] + [1.0] * (dim - 1), 1), (907, rows[5][1][:8], 1), (908, [1e-30] * dim, 1), (909, [1e30] * dim, 1), (None, rows[7][1], 1), (11, rows[9][1], 1)]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS)


def cosines(rows, dim=16):
    ok = [k for k, (_, v, _) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.zeros((len(ok), dim))
    for i, k in enumerate(ok):
        x[i, :len(rows[k][1])] = rows[k][1]
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return ok, x @ x.T


@pytest.mark.parametrize("tile", [4096, 40])
def test_vector_links_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embdup, "TILE", tile)
    rows = vectors()
    ok, c = cosines(rows)
    linked = (c >= 0.9) & ~np.eye(len(ok), dtype=bool)
    root = np.arange(len(ok))
    for _ in range(len(ok)):
        root = np.minimum(root, np.where(linked, root[None, :], len(ok)).min(axis=1))
    low = defaultdict(list)
    for i, k in enumerate(ok):
        if rows[k][0] is not None:
            low[root[i]].append(rows[k][0])
    want = {k: (rows[k][0], 0, rows[k][0], True) for k in range(len(rows))}
    for i, k in enumerate(ok):
        m = min(low[root[i]], default=None)
        want[k] = (rows[k][0], int(linked[i].sum()), m, rows[k][0] == m)
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embdup.near_duplicate_vectors(vector_frame(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.values()))


def test_vector_links_of_nothing(spark):
    assert embdup.near_duplicate_vectors(vector_frame(spark, [])).count() == 0
    assert [tuple(r) for r in embdup.near_duplicate_vectors(vector_frame(spark, [(4, None, 1)])).collect()] == [(4, 0, 4, True)]


def test_quantisation_bound_holds():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 32)) ** 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = embdup.quantise(x)
    about = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(x @ x.T - about) <= e[:, None] + e[None, :] + e[:, None] * e[None, :] + 1e-9).all()


def brute_nearest(rows, every, k):
    ok, c = cosines(rows)
    out = {}
    for i, a in enumerate(ok):
        q = rows[a][0]
        if q is not None and q % every == 0:
            out[q] = [(v, s) for s, v in sorted(((c[i, j], rows[b][0]) for j, b in enumerate(ok) if rows[b][0] not in (None, q)), key=lambda t: (-round(t[0], 12), t[1]))][:k]
    return out


def test_search_is_exact_on_one_leaf_and_orders_ties(spark):
    rows = vectors()
    got = defaultdict(list)
    for r in ann.nearest(vector_frame(spark, rows), every=50, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows, 50, 5)
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [x[0] for x in found] == [1, 2, 3, 4, 5]
        assert [x[2] for x in found] == pytest.approx([s for _, s in want[q]], abs=1e-12)
        assert [x[1] for x in found] == [v for v, _ in want[q]]


def test_search_over_many_leaves_has_recall(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in np.float32(r)], 0) for i, r in enumerate(rng.normal(size=(3000, 32)))]
    s = ann.Settings(sample=1000, leaf=128, least=8, block=64)
    hits = 0
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(set)
    for r in ann.nearest(vector_frame(spark, rows), 50, 5, s).collect():
        got[r.query_id].add(r.vec_id)
    for q, found in got.items():
        c = x @ x[q]
        c[q] = -2
        hits += len(found & set(np.argsort(-c)[:5].tolist()))
    assert len(got) == 60 and hits / 300 >= .9


def test_search_of_little(spark):
    assert ann.nearest(vector_frame(spark, [])).count() == 0
    assert ann.nearest(vector_frame(spark, [(50, [1.0, 0.0], 1)])).count() == 0
    got = ann.nearest(vector_frame(spark, [(50, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, None, 1)])).collect()
    assert [tuple(r) for r in got] == [(50, 1, 1, 0.0)]


HARD = st.lists(st.sampled_from([*"\\#</turn>: \n\t.aé\u2028", "### ", "</turn>", "日", "\x00", "'s"]), max_size=20).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), HARD), HARD), max_size=5))
@settings(max_examples=150, deadline=None)
def test_chat_round_trip_and_mask(turns):
    text, starts, ends = chat.render(turns, frozenset(["assistant"]))
    assert chat.parse(text) == turns
    e = chat._tokenizer(BPE).encode(text, add_special_tokens=False)
    a, b = (np.array([o[i] for o in e.offsets], dtype=np.int64) for i in range(2))
    s, t = np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)
    mask = chat.inside(s, t, a, b)
    for p, q, m in zip(a, b, mask, strict=True):  # a token is wholly inside a text or wholly outside
        spans = [(x, y) for x, y in zip(s, t, strict=True) if p < y and q > x]
        assert m == bool(spans) and all(x <= p and q <= y for x, y in spans)
    assert chat.masked_text(text, a, b, mask, s, t) == "".join(x for r, x in turns if r == "assistant")


def test_chat_tables(spark):
    rows = [(1, 1, "assistant", " b\n"), (1, 0, "user", "a"), (1, 1, "assistant", " b\n"), (2, None, None, None), (2, 0, "assistant", ""), (None, 3, "assistant", "no id"), (None, 1, "user", "first"), (3, 0, "user", "x" * 50_000 + " \\### </turn> é日")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, BPE)).collect()}
    said = {k: [(t.role, t.text) for t in v.turns] for k, v in out.items()}
    assert said == {1: [("user", "a"), ("assistant", " b\n"), ("assistant", " b\n")], 2: [("", ""), ("assistant", "")], None: [("user", "first"), ("assistant", "no id")], 3: [("user", rows[-1][3])]}
    assert {k: v.loss_text for k, v in out.items()} == {1: " b\n b\n", 2: "", None: "no id", 3: ""}
    assert chat.format_conversations(df.limit(0), BPE).count() == 0


def page_rows():
    big = "<p>" + "é" * 600
    return [(1, "http://a/b c", big), (9, "http://a/2", big), (4, None, big), (None, "http://n", big), (9, "http://a/2", big), (2, "u\r\nX: y", "small"), (3, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", "lonely" * 300), (None, "u", "lonely" * 300),
            (7, "u", "x\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n" * 40), (8, "u", "long" * 200_000)]


def test_archives_round_trip(spark, tmp_path):
    rows = page_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    archives = warc.archive(df, f"file://{tmp_path}/w")
    got = [tuple(r) for r in warc.read_archives(archives).collect()]
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max((k for k, _, g in rows if g == h and k is not None), default=None)
        revisit = len(raw) >= 1000 and top is not None and i != top
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.startswith("stream")]
    for a in archives.collect():  # a plain reader of many members sees the same records
        with reading(a.path) as f:
            assert len(list(warc._Inflated(f, 7).records())) == a.n_records
    assert warc.read_archives(warc.archive(df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_streams_roll_and_damage_is_seen(spark, tmp_path):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string").coalesce(1)
    streams = warc.write_streams(warc.plan_revisits(df), f"file://{tmp_path}/s", roll_bytes=3000)
    assert streams.count() > 2
    one = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    with writing(f"file://{tmp_path}/cut.gz") as out:
        out.write(zlib.compressobj(6, zlib.DEFLATED, 31).compress(one[:-3]) + b"")
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.write(z.compress(one[:-3]) + z.flush())
    with reading(f"file://{tmp_path}/cut.gz") as f, pytest.raises((ValueError, zlib.error)):
        list(warc._Inflated(f).records())


def test_files_are_spread_over_tasks(spark, tmp_path):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string").repartition(6)
    streams = warc.write_streams(warc.plan_revisits(df), f"file://{tmp_path}/s", roll_bytes=3000)
    archives = warc.normalise(streams, f"file://{tmp_path}/n")
    assert (n := streams.count()) > 2
    assert archives.select(F.input_file_name()).distinct().count() == n  # one file for each task with rows
    assert warc.read_archives(archives).select(F.spark_partition_id()).distinct().count() == n
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").repartition(5)
    manifest = records.write_tokens(docs, BPE, 2, f"file://{tmp_path}/t")
    read = records.read_tokens(manifest).select(F.spark_partition_id()).distinct().count()
    assert read == manifest.count()


TEXTS = ["", "a", " leading", "trailing \n", "a  b\n\n c\t\td", "it's don't I'LL 've", "Ünïcode — dash, 日本語 text", "x\u00a0\n y", "a\x1c b\x0b\x0c c", "<|endoftext|> inside", "1234 56.78e9", "\n\n\n", "😀😀 \ud7ff", "punct!!! ... ,,, ;'s", " \u2003 wide \u3000", "tab\there\r\nline"]


FRESH = Tokenizer.from_file(BPE)
FEW = records.Encoder(BPE, remember=50)


def library_ids(texts, dtype):
    """What the library gives for whole texts in its own default setting."""
    return [np.array(x.ids, dtype=dtype).tobytes() for x in FRESH.encode_batch(list(texts), add_special_tokens=False)] if texts else []


@given(st.lists(st.lists(st.sampled_from([*" \n\t\r\x0b\u00a0\u2003'stab.,!é日1😀-", "<|endoftext|>", "<|endof", "text|>"]), max_size=40).map("".join), max_size=8))
@settings(max_examples=150, deadline=None)
def test_pieces_encode_like_whole_texts(texts):
    for batch in (texts, TEXTS, texts):
        assert FEW.encode(list(batch)) == library_ids(batch, FEW.dtype)


def test_added_tokens_are_encoded_as_the_library_does(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endof text|>", "plain"]
    e = records.Encoder(BPE)
    assert np.frombuffer(e.encode(texts)[0], dtype=e.dtype).tolist() == [64, 220, 50256, 275]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = records.read_tokens(records.write_tokens(df, BPE, 2, f"file://{tmp_path}/t")).orderBy("doc_id").collect()
    want = [np.append(np.frombuffer(x, dtype=e.dtype), 2).astype("<u4") for x in library_ids(texts, e.dtype)]
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(x.size, zlib.crc32(x.tobytes())) for x in want]
    assert [r.start for r in rows] == [sum(x.size for x in want[:i]) for i in range(len(want))]


def test_chunks_of_texts_are_bounded_and_whole():
    for sizes in ([], [5], [0, 0, 0], [4, 4, 4, 9, 1, 1], [30, 1, 30]):
        texts = ["x" * n for n in sizes]
        cuts = list(records.chunks(texts, 10))
        assert [i for a, b in cuts for i in range(a, b)] == list(range(len(texts)))
        assert all(b - a == 1 or sum(sizes[a:b]) <= 10 for a, b in cuts)


def test_token_files_round_trip(spark, tmp_path):
    rows = [(i * 7 % 50, TEXTS[i % len(TEXTS)] + f" {i}") for i in range(50)] + [(None, "no id"), (None, None), (60, None), (60, ""), (61, "long word " * 30_000), (-5, "negative")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(5)
    manifest = records.write_tokens(df, BPE, 2, f"file://{tmp_path}/t")
    got = records.read_tokens(manifest).orderBy("start").collect()
    t = Tokenizer.from_file(BPE)
    ids = defaultdict(list)
    for k, text in rows:
        ids[k].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in [(x.size, zlib.crc32(x.tobytes())) for x in ids[r.doc_id]]
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((k or 0, x.size, zlib.crc32(x.tobytes())) for k, v in ids.items() for x in v)
    for m in manifest.collect():  # records in any order
        entries = list(records.read_index(m.path))[::-1]
        with reading(m.path, random=True) as f:
            assert [records.read_record(f, o, 2)[1].size for _, o, _ in entries] == [n for _, _, n in entries]
    empty = records.write_tokens(df.limit(0), BPE, 2)
    assert empty.count() == 0 and records.read_tokens(empty).count() == 0


def test_frames_show_damage(tmp_path):
    good = records.frame(b"abc") + records.frame(b"")
    for cut, k in ((good[:20], None), (good, 3), (good, 9), (good, 13), (good, 16)):
        data = bytearray(cut)
        if k is not None:
            data[k] ^= 1
        with writing(f"file://{tmp_path}/f") as out:
            out.write(bytes(data))
        with reading(f"file://{tmp_path}/f") as f, pytest.raises(ValueError):
            while records.read_frame(f) is not None:
                pass
