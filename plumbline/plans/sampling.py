"""Samples, quotas, splits, manifests over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scalars import rounded
from plumbline.operators import decontaminate as dc, sampling as sp
from plumbline.plans import views as V
from plumbline.plans.integrity import SPLIT_SQL, docs_and_black, split_docs, _BLACK
from plumbline.plans.registry import query
from plumbline.plans.views import rnd, with_views
from plumbline.sources.scans import table

W = with_views


def _ranked(source: str, part: str, seed: str, key: str) -> str:
    over = f"partition by {part} " if part else ""
    return (f"select *, row_number() over ({over}order by md5('{seed}:'||{key}), {key}) as rank, "
            f"count(*) over ({over.strip()}) as n_group from {source}")


@query("E1, E5", W("samples", r=_ranked("samples", "generator", "draw", "sample_id")) + "select sample_id, generator, rank from r where rank <= 100")
def stratified_sample(spark, d):
    s = V.samples(spark, d).select("sample_id", "generator")
    return sp.sample_per_stratum(s, "generator", "sample_id", 100, "draw")


@query("E2", W("docs", black=_BLACK, r="select *, sha not in (select sha from black) as accepted from docs",
               k=_ranked("r", "lang", "audit", "doc_id"), a="select *, sum(cast(accepted as integer)) over (partition by lang order by rank) as n_accepted from k")
       + "select doc_id, lang, accepted, rank, n_accepted::bigint as n_accepted, rank > 25 as is_replacement from a where n_accepted - cast(accepted as integer) < 25")
def audited_sample(spark, d):
    """Draw 25 clean documents per language; every document looked at is logged, replacements marked."""
    docs, black = docs_and_black(spark, d)
    pool = docs.join(black.select("sha", F.lit(False).alias("accepted")), "sha", "left").select("doc_id", "lang", F.coalesce("accepted", F.lit(True)).alias("accepted"))
    return sp.audited_draw(pool, "lang", "doc_id", "accepted", 25, "audit").select("doc_id", "lang", "accepted", "rank", "n_accepted", "is_replacement")


@query("E3", W("docs", high="select doc_id, lang from docs where source in ('src3','src4','src5')", low="select doc_id, lang from docs where source not in ('src3','src4','src5')",
               r=_ranked("low", "lang", "fill", "doc_id")) + """select doc_id, lang, false as filled from high union all
 select doc_id, lang, true from r where rank <= greatest(150 - (select count(*) from high h where h.lang=r.lang), 0)""")
def quota_fill(spark, d):
    """All high-priority documents, then low-priority ones up to 150 per language."""
    docs = V.docs(spark, d).select("doc_id", "lang", "source")
    first = F.col("source").isin("src3", "src4", "src5")
    out = sp.fill_to_target(docs.where(first).drop("source"), docs.where(~first).drop("source"), "lang", "doc_id", 150, "fill")
    return out.select("doc_id", "lang", "filled")


QUOTAS = {"view": 120, "click": 80, "signup": 40, "purchase": 20}


@query("E4", W("samples", r="select *, row_number() over (partition by generator order by sample_id) as rank from samples") + "select sample_id, generator, rank from r where rank <= case generator "
       + " ".join(f"when '{k}' then {v}" for k, v in QUOTAS.items()) + " else 0 end")
def category_quota(spark, d):
    return sp.first_per_category(V.samples(spark, d).select("sample_id", "generator"), "generator", "sample_id", QUOTAS)


@query("E6", W("docs", s=SPLIT_SQL) + "select doc_id, lang, split from s")
def stratified_split(spark, d):
    return split_docs(spark, d).select("doc_id", "lang", "split")


_GROUP_SPLIT = """select *, case when rank <= floor(n_group*0.7e0) then 'train' when rank <= floor(n_group*0.7e0)+floor(n_group*0.15e0) then 'validation' else 'test' end as split from g"""


@query("E7", "WITH c as (select distinct o_custkey from orders), g as (" + _ranked("c", "", "group", "o_custkey") + f"), s as ({_GROUP_SPLIT}) "
       "select split, count(*) as n_orders, count(distinct o_custkey) as n_customers from orders join s using (o_custkey) group by 1")
def group_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return sp.split_groups(o, "o_custkey", "group").groupBy("split").agg(F.count("*").alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"))


@query("E8", W("samples", p="select * from samples where generator<>'purchase'", r=_ranked("p", "y", "fixed", "sample_id")) + """select sample_id, y, case when rank<=560 then 'train'
 when rank<=630 then 'validation' when rank<=700 then 'test' else 'unused' end as split from r union all select sample_id, y, 'test_unseen' from samples where generator='purchase'""")
def fixed_split_with_unseen(spark, d):
    """560/70/70 per class in seeded order; one generator is held out whole."""
    s = V.samples(spark, d).select("sample_id", "y", "generator")
    return sp.split_fixed(s, ["y"], "sample_id", "fixed", [("train", 560), ("validation", 70), ("test", 70)], held_out=F.col("generator") == "purchase").select("sample_id", "y", "split")


@query("E9", W("samples", r=_ranked("samples", "y", "half", "sample_id")) + "select sample_id, y, case when rank<=floor(n_group*0.5e0) then 'fit' else 'eval' end as half from r")
def calibration_halves(spark, d):
    return calibration_half(V.samples(spark, d).select("sample_id", "y"))


def calibration_half(df):
    r = sp.split_by_shares(df, ["y"], "sample_id", "half", 0.5, 0.5)
    return r.select(*df.columns, F.when(F.col("split") == "train", "fit").otherwise("eval").alias("half"))


@query("E10", W("samples", r=_ranked("samples", "y", "fold", "sample_id")) + "select sample_id, y, cast((rank-1)%5 as integer) as fold from r")
def stratified_folds(spark, d):
    return sp.folds(V.samples(spark, d).select("sample_id", "y"), ["y"], "sample_id", "fold")


@query("E11", W("branches", c="select truth, count(*) as n from branches group by 1") + f"select truth, n, {rnd('(select sum(n) from c)/((select count(*) from c)*n)')} as weight from c")
def class_weights(spark, d):
    return sp.class_weights(V.branches(spark, d), "truth").select("truth", "n", rounded("weight").alias("weight"))


@query("E12", W("docs", s=SPLIT_SQL) + """select coalesce(split,'all') as split, coalesce(lang,'all') as label, count(*) as n from s group by rollup(split,lang)""")
def manifest_split_summary(spark, d):
    return sp.split_summary(split_docs(spark, d), "split", "lang")


@query("E12", W("docs", s=SPLIT_SQL) + """select cast(doc_id as varchar) as sample_id, lang as ground_truth, source, split, sha as sha256, 'documents.parquet:'||doc_id as storage_ref, n_chars as file_size_bytes from s""")
def dataset_manifest(spark, d):
    s = split_docs(spark, d)
    m = sp.manifest(s, {"sample_id": "doc_id", "ground_truth": "lang", "source": "source", "split": "split", "sha256": "sha",
                        "storage_ref": F.concat(F.lit("documents.parquet:"), F.col("doc_id").cast("string")), "file_size_bytes": "n_chars"})
    return m.select("sample_id", "ground_truth", "source", "split", "sha256", "storage_ref", "file_size_bytes")


@query("E12", W("docs", s=SPLIT_SQL) + """select split, count(*) filter (where contains(source,'src1')) as n_src1_family, count(*) filter (where source='src1') as n_src1,
 count(*) filter (where not contains(source,'src1')) as n_other from s group by 1""")
def source_breakdown(spark, d):
    return split_docs(spark, d).groupBy("split").agg(
        F.count_if(F.contains("source", F.lit("src1"))).alias("n_src1_family"), F.count_if(F.col("source") == "src1").alias("n_src1"),
        F.count_if(~F.contains("source", F.lit("src1"))).alias("n_other"))


@query("E13", W("docs") + """select coalesce(lang,'all') as lang, coalesce(source,'all') as source, count(*) as n, min(n_chars) as min_chars, max(n_chars) as max_chars,
 """ + rnd("avg(n_chars)") + " as avg_chars from docs group by grouping sets ((lang),(source),())")
def dataset_statistics(spark, d):
    docs = V.docs(spark, d)
    sets = docs.groupingSets([["lang"], ["source"], []], "lang", "source")
    return sets.agg(F.count("*").alias("n"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), rounded(F.avg("n_chars")).alias("avg_chars")) \
        .select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n", "min_chars", "max_chars", "avg_chars")


@query("E14", W("docs", s=SPLIT_SQL) + """select lang, source, count(*) filter (where split='train') as train, count(*) filter (where split='validation') as validation,
 count(*) filter (where split='test') as test from s group by 1,2""")
def slice_grid(spark, d):
    names = ["train", "validation", "test"]
    g = split_docs(spark, d).groupBy("lang", "source").pivot("split", names).agg(F.count(F.lit(1)))
    return g.select("lang", "source", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


@query("E15", W("docs", n="select *, row_number() over (partition by lang order by doc_id) as k from docs") + """select doc_id, lang, 500+k as number, lang||'_'||lpad(cast(500+k as varchar),6,'0') as name from n""")
def sequential_names(spark, d):
    """Numbers per language continuing after an existing 500."""
    out = sp.sequential_names(V.docs(spark, d).select("doc_id", "lang"), ["lang"], "doc_id", F.lit(500), "")
    return out.select("doc_id", "lang", "number", F.concat_ws("_", "lang", "name").alias("name"))


@query("C1, E2, E6", W("docs", black=_BLACK, first="""select * from (select *, row_number() over (partition by sha order by cast(substr(source,4) as integer), doc_id) as rn1 from docs) where rn1=1
 and sha not in (select sha from black)""", s=SPLIT_SQL.replace("from docs)", "from first)")) + "select split, lang, count(*) as n, sum(n_chars)::bigint as n_chars from s group by 1,2")
def clean_dataset_build(spark, d):
    """Blacklist, deduplicate, decontaminate, split, count: the dataset build end to end, lazily.

    Deduplication comes first: it is a partial aggregation, and no repeated hash reaches the join.
    """
    docs, black = docs_and_black(spark, d)
    docs = docs.withColumn("priority", F.substring("source", 4, 10).cast("int"))
    first = dc.keep_first(docs, "sha", ["priority", "doc_id"], ["doc_id", "lang", "source", "n_chars"])
    kept = dc.without(first, black, "sha")
    return sp.split_by_shares(kept, ["lang"], "doc_id", "split").groupBy("split", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
