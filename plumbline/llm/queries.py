"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, chat, embdup, langid, linededup, minhash, mixing, packing, records, runs, toxicity, warc, whitening
from plumbline.llm.registry import QUERIES, query, table

__all__ = ["QUERIES"]

OP1_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rn from d group by source),
w as (select *, case (rn - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w, source_size * 2.0::double as cap from s),
l as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / w, rn rows between unbounded preceding and 1 preceding), 0))
             / (sum(w) over () - coalesce(sum(w) over (order by cap / w, rn rows between unbounded preceding and 1 preceding), 0)) as level from w),
a as (select first(level order by cap / w, rn) as lv from l where level <= cap / w),
t as (select source, source_size, least(coalesce(lv * w, cap), cap) as target from l left join a on true),
b as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as base from t),
r as (select *, target - base * source_size as rest from b),
g as (select source, h, sum(size)::bigint as words from d group by source, h),
c as (select g.*, sum(words) over (partition by g.source order by h) - words as before from g),
k as (select c.source, c.h, before + words * 0.5 <= rest as more from c join r on c.source is not distinct from r.source)
select d.doc_id, d.size, r.source_size, r.target, (d.size * (r.base + case when k.more then 1 else 0 end))::bigint as taken
from d join r on d.source is not distinct from r.source join k on k.source is not distinct from d.source and k.h = d.h
"""


@query(OP1_SQL)
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it."""
    return mixing.mixture(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learned from documents that are not held out."""
    docs = table(spark, folder, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    net = langid.train(docs.where("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), net).select("doc_id", "held_out", "lang_pred", "score")


OP3_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 2 then [w] else list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]) end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
g as (select s, count(*) as f from s group by s),
o as (select s.doc_id, s.s, n.n, row_number() over (partition by s.doc_id order by g.f, s.s) as r from s join g using (s) join n using (doc_id)),
p as (select * from o where r <= n - ceil(n * 0.8 - 1e-9) + 1),
c as (select distinct a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny from p a join p b on a.s = b.s and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
i as (select x, y, nx, ny, count(*) as k from c join s a on a.doc_id = x join s b on b.doc_id = y and a.s = b.s group by all),
l as (select x, y from i where 100 * k >= 80 * (nx + ny - k)),
e as (select x as a, y as b from l union select y, x from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) as kept
from documents d left join n using (doc_id) left join (select a, min(b) as b from r group by a) m on m.a = d.doc_id
"""


@query(OP3_SQL)
def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are at least 80 % alike."""
    return minhash.near_duplicates(table(spark, folder, "documents"), width=2, percent=80)


OP4_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select d.vec_id, coalesce(n.n, 0)::bigint as n_links, least(d.vec_id, coalesce(m.b, d.vec_id)) as component_id, d.vec_id = least(d.vec_id, coalesce(m.b, d.vec_id)) as kept
from embeddings d left join (select a, count(*) as n from l group by a) n on n.a = d.vec_id left join (select a, min(b) as b from r group by a) m on m.a = d.vec_id
"""


@query(OP4_SQL)
def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of vectors with cosine 0.9 or more."""
    return embdup.near_duplicate_vectors(table(spark, folder, "embeddings"), threshold=0.9)


OP5_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (key in (from f)))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (key not in (from f)), '')) as kept_sha256
from k group by doc_id
"""


@query(OP5_SQL)
def op5_dedup_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that ten or more documents share."""
    kept = linededup.dedup_lines(table(spark, folder, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query()
def op6_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth vector."""
    return ann.nearest(table(spark, folder, "embeddings"), every=50, k=5)


@query()
def op7_format_chats(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation formatted, masked and read back; one more holds the template's own control strings."""
    import public_tokenizers
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(more)
    back = chat.read_back(chat.format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("bigint").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


OP8_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, octet_length(encode(body))::bigint as payload_bytes, sha1(body) as payload_digest from p),
t as (select *, max(page_id) over (partition by payload_digest) as top from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from t
"""


@query(OP8_SQL)
def op8_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a WARC record, written, normalised and read back."""
    return warc.read_archives(warc.archive(table(spark, folder, "pages"), min_bytes=1000))


@query()
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in bins of 2,048 words without conflicts: near copies are of one cluster, so no bin holds two of them."""
    docs = minhash.clusters(table(spark, folder, "documents"), width=5, percent=80, carry=["source"])
    cluster = F.coalesce("cluster", packing.text_cluster(F.lit("")))
    return packing.pack(docs, capacity=2048, per_source=4, cluster=cluster, size=F.col("words"))


@query()
def op10_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole document, written to record files in the order of doc_id and read back."""
    import public_tokenizers
    manifest = records.write_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return records.read_tokens(manifest)


@query()
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from labelled documents that are not held out."""
    docs = table(spark, folder, "documents").withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    machine = toxicity.train(docs.where("not held_out"), table(spark, folder, "labels").where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs.select("doc_id", "held_out", "text"), machine).select("doc_id", "held_out", "score", "predicted")


@query()
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the sixteen strongest components of the different vectors. A deviation that no long holds is null there and whole in deviation_exact."""
    done = whitening.whiten(table(spark, folder, "embeddings"), count=16)
    return done.select("vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))


@query()
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words in every document; one document in ten is made to hold one."""
    docs = table(spark, folder, "documents").select("doc_id", runs.plant(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.with_runs(docs).select("doc_id", "found.*")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2(F.col("text"), 256).alias("collapsed_sha256"))
