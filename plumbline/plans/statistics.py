"""Resampling and paired tests on the derived tables."""

from __future__ import annotations

from itertools import combinations
from math import pi

from pyspark.sql import functions as F

from plumbline.functions.scalars import rounded, snapped
from plumbline.operators import agreement as ag, metrics as mt, stats as st
from plumbline.operators.decontaminate import values_long
from plumbline.operators.fusion import VIEWS, VIEW_SETS
from plumbline.operators.prefix import describe
from plumbline.plans import views as V
from plumbline.plans.metrics import reported
from plumbline.plans.registry import query
from plumbline.plans.studies import WIDE_SQL, fused_rows, fused_union, wide
from plumbline.plans.views import MODELS, rnd, signed_rank_sql, sql_rates, two_sided_sql, with_views
from plumbline.session import cut_lineage

W = with_views
REPLICATES = 1000
BOOT_METRICS = ("accuracy", "precision", "recall", "f1", "balanced_accuracy", "mcc")
PAIRS = list(combinations(MODELS, 2))
PRED = {m: f"pred_{m}" for m in MODELS}


def _drawn(cells: str, keys: str, tag: str = "") -> dict[str, str]:
    """Subqueries that redraw the counts n of ``cells`` for every replicate (``dr`` + tag): as operators.stats.poisson_cells does."""
    name = "||':'||".join(f"{k}::varchar" for k in keys.split(", "))
    reach = f"(floor({st.SPREAD!r}e0*sqrt(n::double))::bigint + {st.MARGIN})"
    return {
        f"pm{tag}": f"select distinct n from {cells} where n > 0",
        f"pk{tag}": f"select n, unnest(range(greatest(0, n - {reach}), n + {reach} + 1)) as k, n + {reach} as last from pm{tag}",
        f"pp{tag}": f"""select n, k, last, exp(case when k <= 20 then k*ln(n::double) - n - ln(factorial(least(k, 20)::integer)::double)
 else (k - n)::double - (k + 0.5e0)*ln(k::double/n) - ln(n*{2 * pi!r}e0)*0.5e0 - (1e0/12 - (1e0/360 - (1e0/1260 - 1e0/1680/(k::double*k))/(k::double*k))/(k::double*k))/k end) as p from pk{tag}""",
        f"pc1{tag}": f"select n, k, last, sum(p) over (partition by n order by k rows unbounded preceding) as upto from pp{tag}",
        f"ps{tag}": f"select n as pn, k as pk, coalesce(lag(upto) over (partition by n order by k), 0e0) as low, case when k = last then 1e0 else least(upto, 1e0) end as high from pc1{tag}",
        f"d1{tag}": f"select b.range as replicate, {keys}, n, md5('boot:'||b.range||':'||{name}) as d from {cells}, range({REPLICATES}) b where n > 0",
        f"d2{tag}": f"select replicate, {keys}, n, cast('0x'||substr(d,1,13) as bigint)/4503599627370496e0 as u from d1{tag}",
        f"dr{tag}": f"select replicate, {keys}, pk::bigint as n from d2{tag} join ps{tag} on n = pn and u >= low and u < high where pk > 0",
    }


_WEIGHTS = {
    "w": WIDE_SQL,
    "ce": f"select y, {', '.join(PRED.values())}, count(*) as n from w group by all",
    **_drawn("ce", "y, " + ", ".join(PRED.values())),
    "lg": " union all ".join(f"select replicate, '{m}' as model, y, pred_{m} as pred, n from dr" for m in MODELS),
    "c": "select replicate, model, " + ", ".join(f"sum(case when y={y} and pred={p} then n else 0 end)::bigint as {x}" for x, y, p in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))) + " from lg group by 1,2",
    "rm": "select replicate, model, " + sql_rates(*BOOT_METRICS).replace(",9)", ",15)") + " from c",
    "ml": " union all ".join(f"select replicate, model, '{m}' as metric, {m} as value from rm" for m in BOOT_METRICS),
    "pc": "select model, count(*) filter (where y=1 and pred=1)::bigint as tp, count(*) filter (where y=0 and pred=0)::bigint as tn, count(*) filter (where y=0 and pred=1)::bigint as fp, count(*) filter (where y=1 and pred=0)::bigint as fn from pred group by 1",
    "pr": "select model, " + sql_rates(*BOOT_METRICS) + " from pc",
    "pe": " union all ".join(f"select model, '{m}' as metric, {m} as estimate from pr" for m in BOOT_METRICS),
}


def _replicates(spark, d, names=BOOT_METRICS, mode="poisson", rows=None):
    cells = st.bootstrap_cells(wide(spark, d) if rows is None else rows, "y", list(PRED.values()), REPLICATES, "boot", mode)
    return values_long(st.replicate_metrics(cells, "y", PRED, names), ["replicate", "model"], list(names))


def _estimates(spark, d, names=BOOT_METRICS):
    point = mt.binary_metrics(V.pred(spark, d), ["model"], names=names)
    return values_long(point, ["model"], list(names)).withColumnRenamed("value", "estimate")


_STAT = f"{rnd('avg(value)')} as boot_mean, {rnd('stddev_samp(value)', 8)} as std_error, {rnd('quantile_cont(value,0.025e0)', 8)} as ci_low, {rnd('quantile_cont(value,0.975e0)', 8)} as ci_high"


def _interval_rows(i, *keys):
    return i.select(*keys, rounded("estimate").alias("estimate"), rounded("boot_mean").alias("boot_mean"), *[rounded(c, 8).alias(c) for c in ("std_error", "ci_low", "ci_high")])


@query("I1", W("pred", **_WEIGHTS, b=f"select model, metric, {_STAT} from ml group by 1,2") + f"select model, metric, {rnd('estimate')} as estimate, boot_mean, std_error, ci_low, ci_high from b join pe using (model, metric)")
def bootstrap_intervals(spark, d):
    """1,000 Poisson replicates of six count metrics for four models, drawn on prediction patterns; the estimate beside its interval."""
    i = st.interval(_replicates(spark, d), ["model", "metric"]).join(_estimates(spark, d), ["model", "metric"])
    return _interval_rows(i, "model", "metric")


_MOMENTS = ("accuracy", "recall", "specificity")


@query("I1", W("pred", pc=_WEIGHTS["pc"], pr="select model, tp+tn+fp+fn as n_accuracy, tp+fn as n_recall, tn+fp as n_specificity, " + sql_rates(*_MOMENTS) + " from pc",
               pe=" union all ".join(f"select model, '{m}' as metric, {m} as estimate, n_{m} as n from pr" for m in _MOMENTS))
       + f"select model, metric, {rnd('estimate')} as estimate, true as mean_agrees, true as error_agrees from pe")
def bootstrap_intervals_multinomial(spark, d):
    """1,000 exact redraws of cell counts, held against closed forms: the mean of the replicates lies within six of its standard errors of the estimate, and
    their standard error within a quarter of sqrt(p (1-p) / n)."""
    point = mt.binary_metrics(V.pred(spark, d), ["model"], names=_MOMENTS)
    base = {"accuracy": F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"), "recall": F.col("tp") + F.col("fn"), "specificity": F.col("tn") + F.col("fp")}
    sizes = values_long(point, ["model"], base).withColumnRenamed("value", "n")
    est = values_long(point, ["model"], list(_MOMENTS)).withColumnRenamed("value", "estimate").join(sizes, ["model", "metric"])
    i = st.interval(_replicates(spark, d, _MOMENTS, "multinomial"), ["model", "metric"]).join(est, ["model", "metric"])
    p = F.col("estimate")
    closed = F.sqrt(p * (F.lit(1.0) - p) / F.col("n"))
    return i.select("model", "metric", rounded("estimate").alias("estimate"), (F.abs(F.col("boot_mean") - p) <= closed * 6.0 / REPLICATES**0.5 + 2.0 / F.col("n")).alias("mean_agrees"),
                    (F.abs(F.col("std_error") - closed) <= closed * 0.25).alias("error_agrees"))


_AUC_W = {
    "ce": "select model, y, score, count(*) as n from pred group by all",
    **_drawn("ce", "model, y, score"),
    "hh": "select replicate, model, score, sum(case when y=1 then n else 0 end)::bigint as pos, sum(case when y=0 then n else 0 end)::bigint as neg from dr where n > 0 group by 1,2,3"
          " union all select -1, model, score, sum(y*n)::bigint, sum((1-y)*n)::bigint from ce group by 1,2,3",
    "rr": "select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over v as np, sum(neg) over v as nn from hh window w as (partition by replicate, model order by score desc rows unbounded preceding), v as (partition by replicate, model)",
    "aa": "select replicate, model, sum(neg*(2*tp-pos))/2e0/(max(np)::double*max(nn)) as auroc, sum(pos*(tp::double/(tp+fp)))/max(np) as average_precision from rr group by 1,2",
    "ml": "select replicate, model, 'auroc' as metric, auroc as value from aa union all select replicate, model, 'average_precision', average_precision from aa",
}


@query("I1", W("pred", **_AUC_W, b=f"select model, metric, {_STAT} from ml where replicate >= 0 group by 1,2") + f"select model, metric, {rnd('value')} as estimate, boot_mean, std_error, ci_low, ci_high from b join (from ml where replicate < 0) using (model, metric)")
def bootstrap_auroc(spark, d):
    """1,000 Poisson replicates of AUROC and average precision, drawn on the cells of the score histograms."""
    from plumbline.operators.curves import curve_metrics, curve_points, score_histogram
    keys = ["replicate", "model"]
    p = V.pred(spark, d)
    hist = st.bootstrap_scores(p, ["model"], "y", "score", REPLICATES, "boot").select(*keys, "score", "pos", "neg")
    whole = score_histogram(p, ["model"]).select(F.lit(-1).alias("replicate"), "model", "score", "pos", "neg")
    m = values_long(curve_metrics(curve_points(hist.unionByName(whole), keys, splits=16), keys), keys, ["auroc", "average_precision"])  # 4,004 groups, each a small share
    i = st.interval(m.where("replicate >= 0"), ["model", "metric"]).join(m.where("replicate < 0").select("model", "metric", F.col("value").alias("estimate")), ["model", "metric"])
    return _interval_rows(i, "model", "metric")


def _pair_rows(t: str, value: str, on: str) -> str:
    return " union all ".join(f"select '{a}' as model_1, '{b}' as model_2, x.metric, x.{value}-z.{value} as {value} from {t} x join {t} z on {on} and x.metric=z.metric and x.model='{a}' and z.model='{b}'" for a, b in PAIRS)


_CURVES = ("auroc", "average_precision")
_JOINT = ", ".join(f"score_{m}" for m in MODELS)
_PAIRED_W = _WEIGHTS | {
    "jc": f"select y, {_JOINT}, count(*) as n from w group by all",
    **_drawn("jc", "y, " + _JOINT, "j"),
    "jl": " union all ".join(f"select replicate, '{m}' as model, y, score_{m} as score, n from drj" for m in MODELS) + " union all " + " union all ".join(f"select -1, '{m}', y, score_{m}, n from jc" for m in MODELS),
    "hh": "select replicate, model, score, sum(y*n)::bigint as pos, sum((1-y)*n)::bigint as neg from jl group by 1,2,3",
    "rr": _AUC_W["rr"], "aa": _AUC_W["aa"],
    "al": "select replicate, model, 'auroc' as metric, round(auroc, 12) as value from aa union all select replicate, model, 'average_precision', round(average_precision, 12) from aa",
    "mx": "select * from ml union all select * from al where replicate >= 0",
    "px": "select * from pe union all select model, metric, value from al where replicate < 0",
    "dd": _pair_rows("mx", "value", "x.replicate=z.replicate"), "de": _pair_rows("px", "estimate", "true"),
    "g": "select model_1, model_2, metric, avg(value) as m, quantile_cont(value,0.025e0) as lo, quantile_cont(value,0.975e0) as hi, avg((value<=0)::integer) as le, avg((value>=0)::integer) as ge from dd group by 1,2,3",
}


@query("I2", W("pred", **_PAIRED_W) + f"""select model_1, model_2, metric, {rnd('estimate', 8)} as estimate, {rnd('m')} as boot_mean, {rnd('lo', 8)} as ci_low, {rnd('hi', 8)} as ci_high, not (lo<=0 and hi>=0) as significant, {rnd(f'greatest(2*least(le,ge),1e0/{REPLICATES})')} as p_value
 from g join de using (model_1, model_2, metric)""")
def paired_bootstrap(spark, d):
    """Differences of two models in eight metrics, each on the same 1,000 resamples of both, with the difference of the estimates. Count metrics are drawn on
    prediction patterns, AUROC and average precision on the cells of all models' scores together."""
    from plumbline.operators.curves import curve_metrics, curve_points
    keys = ["replicate", "model"]
    scores = {m: f"score_{m}" for m in MODELS}
    # Samples are put together from their models once, for the patterns, the joint cells and the whole histograms.
    w = cut_lineage(wide(spark, d).select("y", *PRED.values(), *scores.values()))
    counts = _replicates(spark, d, rows=w).withColumn("value", F.round("value", 15))
    whole = st.model_histograms(w.select("y", *scores.values(), F.lit(-1).alias("replicate"), F.lit(1).cast("bigint").alias("n")), "y", scores)
    hist = st.bootstrap_joint_curves(w, "y", scores, REPLICATES, "boot").unionByName(whole)
    curves = values_long(curve_metrics(curve_points(hist, keys, splits=16), keys), keys, list(_CURVES)).withColumn("value", F.round("value", 12))
    r = st.paired_interval(counts.unionByName(curves.where("replicate >= 0")), PAIRS, REPLICATES)
    e = _estimates(spark, d).withColumn("estimate", rounded("estimate")).unionByName(curves.where("replicate < 0").select("model", "metric", F.col("value").alias("estimate")))
    x, z = e.select(F.col("model").alias("model_1"), "metric", F.col("estimate").alias("_1")), e.select(F.col("model").alias("model_2"), "metric", F.col("estimate").alias("_2"))
    r = r.join(x, ["model_1", "metric"]).join(z, ["model_2", "metric"])
    # Estimates are rounded as reported before they are subtracted.
    return r.select("model_1", "model_2", "metric", rounded(F.col("_1") - F.col("_2"), 8).alias("estimate"), rounded("boot_mean").alias("boot_mean"), rounded("ci_low", 8).alias("ci_low"), rounded("ci_high", 8).alias("ci_high"), "significant", rounded("p_value").alias("p_value"))


# --------------------------------------------------------------------------- paired tests

_SR = f"n, w_plus, w_minus, least(w_plus,w_minus) as statistic, {rnd('z')} as z, {rnd(two_sided_sql('z'))} as p_value"
_SETS = {k: VIEW_SETS[k] for k in "BCDE"}
_DIFF = {"f": fused_union(_SETS, ("mean",)), "x": "select f.view_set, f.category, f.fused-v.p_native as dl from f join views v using (sample_id) where f.y=1"}


def _fusion_shift(spark, d):
    f = fused_rows(spark, d, _SETS, ("mean",), keep=("sample_id", "y", "category", "p_native")).where("y = 1")
    return f.select("view_set", "category", (F.col("fused") - F.col("p_native")).alias("delta"))


def _tests(t, *keys):
    return t.select(*keys, "n", "w_plus", "w_minus", "statistic", rounded("z").alias("z"), rounded("p_value").alias("p_value"))


@query("I3", W("views", **_DIFF, **signed_rank_sql("x", "view_set")) + f"select view_set, {_SR} from zz")
def signed_rank_fusion_vs_native(spark, d):
    return _tests(st.signed_rank(_fusion_shift(spark, d), ["view_set"], "delta"), "view_set")


@query("I3", W("views", **_DIFF, **signed_rank_sql("x", "view_set, category")) + f"select view_set, category, {_SR} from zz")
def signed_rank_by_category(spark, d):
    return _tests(st.signed_rank(_fusion_shift(spark, d), ["view_set", "category"], "delta"), "view_set", "category")


_EXACT_SQL = {
    "rc": "select grp, (2*mid)::bigint as rank2, row_number() over (partition by grp order by mid, sz) as i from rk",
    # The distribution of the sum of doubled mid-ranks, one pair after the other.
    "gf": """select grp, 0::bigint as i, [1e0] as chance from sr union all
 select gf.grp, rc.i, list_transform(range(1, (len(chance) + rank2 + 1)::bigint), lambda j: (coalesce(chance[j], 0e0) + case when j > rank2 then coalesce(chance[j - rank2], 0e0) else 0e0 end) * 0.5e0) from gf join rc on rc.grp = gf.grp and rc.i = gf.i + 1""",
    "ex": "select sr.grp, sr.n, w_plus, w_minus, least(1e0, 2e0*list_sum(chance[1:(2*least(w_plus,w_minus))::bigint + 1])) as p from sr join gf on gf.grp = sr.grp and gf.i = sr.n",
}


@query("I3", W("pred", w=WIDE_SQL, x="select p.grp, w.score_A - w.score_D as dl from w join (select distinct sample_id, grp from pred) p using (sample_id)", **signed_rank_sql("x", "grp"), **_EXACT_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
       + f"select grp, n, w_plus, w_minus, {rnd('p')} as p_value, 'exact' as p_method from ex")
def signed_rank_exact(spark, d):
    """Exact tests of two models' scores for every user, ties included: 1,000 pairs a user at most, more are an error."""
    p = V.pred(spark, d)
    w = ag.wide_predictions(p, ["sample_id", "grp"], MODELS)
    t = st.signed_rank(w.select("grp", (F.col("score_A") - F.col("score_D")).alias("delta")), ["grp"], "delta", cells=True)
    return st.with_p_method(t, "exact").select("grp", "n", "w_plus", "w_minus", rounded("p_value").alias("p_value"), "p_method")


@query("I4", W("views", g=" union all ".join(f"select '{v}' as view, y, count(*) filter (where p_native<0.5 and p_{v}>=0.5)::double as b, count(*) filter (where p_native>=0.5 and p_{v}<0.5)::double as c from views group by y" for v in VIEWS[1:]))
       + f"select view, y, b::bigint as gained, c::bigint as lost, {rnd('coalesce((abs(b-c)-1)*(abs(b-c)-1)/nullif(b+c,0),0)')} as statistic, {rnd('case when b+c=0 then 1e0 else ' + two_sided_sql('sqrt((abs(b-c)-1)*(abs(b-c)-1)/(b+c))') + ' end')} as p_value from g")
def mcnemar_views(spark, d):
    """Decisions gained and lost between the base view and each other view, per class."""
    v = V.views(spark, d).select("y", "p_native", F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(f"p_{v}").alias("other")) for v in VIEWS[1:]])).alias("v")).select("y", "p_native", "v.*")
    a, b = F.col("p_native") >= 0.5, F.col("other") >= 0.5
    g = v.groupBy("view", "y").agg(F.count_if(~a & b).alias("gained"), F.count_if(a & ~b).alias("lost"))
    return reported(g.select("view", "y", "gained", "lost", *[c.alias(n) for n, c in st.mcnemar(F.col("gained"), F.col("lost")).items()]))


@query("I5", W("views", **_DIFF, **signed_rank_sql("x", "view_set, category"), p=f"select view_set, category, round({two_sided_sql('z')},12) as p from zz", r="select *, row_number() over (order by p, view_set, category) as i, count(*) over () as m from p",
               h="select *, p<0.05e0/(m-i+1) as ok, p<0.05e0/m as bonf from r")
       + f"select view_set, category, {rnd('p')} as p_value, i as holm_rank, bool_and(ok) over (order by i rows unbounded preceding) as holm_significant, ok as holm_per_row, bonf as bonferroni_significant from h")
def multiple_comparison_correction(spark, d):
    """Holm (step-down, and the per-row form) and Bonferroni over the family of category tests."""
    t = st.signed_rank(_fusion_shift(spark, d), ["view_set", "category"], "delta").withColumn("p_value", F.round("p_value", 12)).select("view_set", "category", "p_value")
    order = ("view_set", "category")
    step = st.correct_multiple(t, order=order)
    per_row = st.correct_multiple(step.drop("holm_rank", "holm_level", "bonferroni_level", "bonferroni_significant").withColumnRenamed("holm_significant", "_step"), order=order, mode="per_row")
    return per_row.select("view_set", "category", rounded("p_value").alias("p_value"), "holm_rank", F.col("_step").alias("holm_significant"), F.col("holm_significant").alias("holm_per_row"), "bonferroni_significant")


_INTER = (("resize_3", "resize_1"), ("blur_3", "blur_1"), ("noise_3", "noise_1"), ("reencoding_3", "reencoding_1"))


@query("I6", W("cond", x=" union all ".join(f"select '{a}' as condition_test, '{b}' as condition_ref, t.score-r.score as dl from cond t join cond r using (sample_id, model) where t.condition='{a}' and r.condition='{b}' and t.gt=1 and t.model='D'" for a, b in _INTER),
               **signed_rank_sql("x", "condition_test, condition_ref"), mm="select condition_test, avg(dl) as mean_shift, median(round(dl,9)) as median_shift from x group by 1")
       + f"select zz.condition_test, condition_ref, {_SR}, {rnd('mean_shift')} as mean_shift, {rnd('median_shift')} as median_shift, {two_sided_sql('z')} < 0.05 as significant from zz join mm on mm.condition_test=zz.condition_test")
def condition_interaction_tests(spark, d):
    """Strong against mild level of every perturbation on the same samples."""
    used = sorted({c for p in _INTER for c in p})
    c = V.cond(spark, d).where((F.col("gt") == 1) & (F.col("model") == "D") & F.col("condition").isin(*used))
    w = c.groupBy("sample_id").agg(*[F.max(F.when(F.col("condition") == x, F.col("score"))).alias(x) for x in used])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("condition_test"), F.lit(b).alias("condition_ref"), snapped(F.col(a) - F.col(b), 9).alias("delta")) for a, b in _INTER]))
    x = w.select(rows.alias("r")).select("r.*").where("delta is not null")
    keys = ["condition_test", "condition_ref"]
    t = st.signed_rank(x, keys, "delta")
    summary = describe(x, keys, "delta", {"median_shift": 0.5}).select(*keys, F.col("mean").alias("mean_shift"), "median_shift")
    out = t.join(summary, keys)
    return out.select(*keys, "n", "w_plus", "w_minus", "statistic", *[rounded(c).alias(c) for c in ("z", "p_value", "mean_shift", "median_shift")], (F.col("p_value") < 0.05).alias("significant"))


@query("I7", W("views", **_DIFF) + f"select view_set, {rnd('avg(dl)')} as mean_shift, {rnd('avg(dl)/stddev_pop(dl)', 7)} as cohen_dz from x group by 1")
def effect_sizes(spark, d):
    g = _fusion_shift(spark, d).groupBy("view_set").agg(F.avg("delta").alias("mean_shift"), st.effect_size(F.col("delta")).alias("cohen_dz"))
    return g.select("view_set", rounded("mean_shift").alias("mean_shift"), rounded("cohen_dz", 7).alias("cohen_dz"))
