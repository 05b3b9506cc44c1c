"""Agreement, slice, view and condition studies on the derived tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from plumbline.functions.scalars import ratio, rounded
from plumbline.operators import agreement as ag, fusion as fu, metrics as mt, robustness as rb
from plumbline.operators.decontaminate import compare_reported, values_long
from plumbline.operators.expectations import status_summary
from plumbline.operators.curves import auroc_rank_sum, curve_metrics, curve_points, score_histogram
from plumbline.operators.prefix import describe_counted
from plumbline.plans import views as V
from plumbline.plans.metrics import reported
from plumbline.plans.registry import query
from plumbline.plans.views import MODELS, SQL_COUNTS, rnd, signed_rank_sql, sql_points, sql_rates, two_sided_sql, with_views
from plumbline.sources.scans import table
from plumbline.sources.sinks import nested_report

W = with_views

WIDE_SQL = ("select sample_id, y, generator, " + ", ".join(f"max(case when model='{m}' then score end) as score_{m}, max(case when model='{m}' then pred end) as pred_{m}" for m in MODELS)
            + " from pred group by 1,2,3")


def wide(spark, d):
    return ag.wide_predictions(V.pred(spark, d), ["sample_id", "y", "generator"], MODELS)


def cells(spark, d):
    return ag.pattern_cells(wide(spark, d), ["y", "generator"], MODELS)


@query("C14", W("pred", w=WIDE_SQL) + "select sample_id, y, generator, " + ", ".join(f"score_{m}, pred_{m}" for m in MODELS) + " from w")
def wide_prediction_table(spark, d):
    """One row per sample, a column per model, by key; the job fails if a sample lacks a model."""
    return fu.require_complete(wide(spark, d), [f"score_{m}" for m in MODELS])


_V = "+".join(f"pred_{m}" for m in MODELS)


@query("H20", W("pred", w=WIDE_SQL, v=f"select y, {_V} as v from w", s="select 'all' as scope, * from v union all select case y when 1 then 'positive' else 'negative' end, * from v") + """
 select scope, count(*) as n_samples, count(*) filter (where v in (0,4)) as unanimous, count(*) filter (where v in (1,3)) as one_dissenter, count(*) filter (where v=2) as two_dissenters,
 count(*) filter (where v=4*y) as unanimous_right, count(*) filter (where v=4*(1-y)) as unanimous_wrong from s group by 1""")
def agreement_distribution(spark, d):
    return ag.agreement_distribution(cells(spark, d), MODELS)


@query("H21", W("pred") + f"""select a.model as model_1, b.model as model_2, count(*) filter (where a.pred=b.pred) as agreement, {rnd('count(*) filter (where a.pred=b.pred)/count(*)')} as agreement_share
 from pred a join pred b on a.sample_id=b.sample_id and a.model<b.model group by 1,2""")
def pairwise_agreement(spark, d):
    return reported(ag.pairwise_agreement(cells(spark, d), MODELS))


_MASK = "||".join(f"case when pred_{m}<>y then '{m}' else '' end" for m in MODELS)


@query("H22", W("pred", w=WIDE_SQL, g=f"select y, {_MASK} as wrong_models, count(*) as n from w group by 1,2")
       + f"select y, wrong_models, cast(length(wrong_models) as integer) as n_wrong, n, {rnd('n/sum(n) over (partition by y)')} as share from g")
def exclusive_error_groups(spark, d):
    return reported(ag.error_groups(cells(spark, d), MODELS))


_RIGHT = "array_to_string(list_filter([" + ",".join(f"case when pred_{m}=y then '{m}' end" for m in MODELS) + "], lambda x: x is not null), ', ')"


@query("H23", W("pred", w=WIDE_SQL) + f"select sample_id, generator, y, score_A, score_D, {_RIGHT} as right_models from w where pred_A=y and pred_D<>y")
def disagreement_extract(spark, d):
    """Samples model A gets right and model D wrong, with the list of models that are right."""
    w = ag.right_and_wrong(wide(spark, d), ["A"], ["D"])
    return w.select("sample_id", "generator", "y", "score_A", "score_D", ag.right_models(MODELS).alias("right_models"))


@query("H24", W("pred", w=WIDE_SQL) + """select generator, count(*) filter (where pred_A=y and pred_D<>y) as a_right_d_wrong, count(*) filter (where pred_D=y and pred_A<>y) as d_right_a_wrong,
 count(*) filter (where pred_C=y and pred_A<>y and pred_D<>y) as only_c_of_acd, count(*) filter (where pred_B=y and pred_A<>y and pred_C<>y and pred_D<>y) as only_b from w group by 1""")
def tradeoffs_by_generator(spark, d):
    c = cells(spark, d)
    right = {m: F.col(f"pred_{m}") == F.col("y") for m in MODELS}
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    return c.groupBy("generator").agg(
        n(right["A"] & ~right["D"]).alias("a_right_d_wrong"), n(right["D"] & ~right["A"]).alias("d_right_a_wrong"),
        n(right["C"] & ~right["A"] & ~right["D"]).alias("only_c_of_acd"), n(right["B"] & ~right["A"] & ~right["C"] & ~right["D"]).alias("only_b"))


@query("J2", W("pred", r="select *, row_number() over (partition by model order by score desc, sample_id) as rank from pred where y=0 and pred=1") + "select model, rank, sample_id, score from r where rank<=20")
def top_confident_false_positives(spark, d):
    fp = V.pred(spark, d).where("y = 0 and pred = 1").select("model", "sample_id", "score")
    return mt.rank_within(fp, ["model"], F.desc("score"), F.col("sample_id")).where("rank <= 20")


# --------------------------------------------------------------------------- audits of reported values

_AUDIT = (W("pred", **sql_points("pred", "model"), l="select *, lag(tp,1,0) over (partition by model order by score desc) as tp0, lag(fp,1,0) over (partition by model order by score desc) as fp0 from pts",
                    rk="select *, rank() over (partition by model order by score) + (count(*) over (partition by model, score)-1)/2e0 as rk from pred",
                    a="select model, sum((fp-fp0)::double/nn*(tp+tp0)::double/np/2) as auroc from l group by 1",
                    b="select model, (sum(rk) filter (where y=1) - count(*) filter (where y=1)*(count(*) filter (where y=1)+1)/2e0)/(count(*) filter (where y=1)::double*count(*) filter (where y=0)) as auroc from rk group by 1",
                    x="select model, avg((pred=y)::integer) as accuracy from pred group by 1") + f"""
 select model, 'auroc' as metric, {rnd('a.auroc')} as reported, {rnd('b.auroc')} as recomputed, case when abs(a.auroc-b.auroc)<=1e-5 then 'PASS' else 'FAIL' end as status from a join b using (model)
 union all select model, 'accuracy', {rnd("case when model='D' then accuracy+0.01e0 else accuracy end")}, {rnd('accuracy')}, case when model='D' then 'FAIL' else 'PASS' end from x""")


@query("C16, F5", _AUDIT)
def recompute_audit(spark, d):
    """Reported against recomputed metrics. AUROC is computed by two formulas; the accuracy reported for model D
    is off by 0.01 and must be caught."""
    p = V.pred(spark, d)
    pts = curve_points(score_histogram(p, ["model"]), ["model"])
    acc = p.groupBy("model").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
    claim = acc.withColumn("accuracy", F.when(F.col("model") == "D", F.col("accuracy") + 0.01).otherwise(F.col("accuracy")))
    rep = values_long(claim, ["model"], ["accuracy"]).unionByName(values_long(curve_metrics(pts, ["model"]), ["model"], ["auroc"]))
    rec = values_long(mt.binary_metrics(p, ["model"], names=("accuracy",)), ["model"], ["accuracy"]).unionByName(values_long(auroc_rank_sum(pts, ["model"]), ["model"], ["auroc"]))
    return reported(compare_reported(rep, rec, ["model", "metric"], 1e-5).select("model", "metric", "reported", "recomputed", "status"))


@query("F5", f"select metric, count(*) as n_checks, count(*) filter (where status='PASS') as n_pass, count(*) filter (where status<>'PASS') as n_fail from ({_AUDIT}) group by 1")
def recompute_audit_summary(spark, d):
    return status_summary(recompute_audit(spark, d), ["metric"])


@query("F6", W("pred", q="select model, y, score, 1e0/(1e0+exp(-(0.454958e0*ln(least(greatest(score,1e-7),1e0-1e-7)/(1e0-least(greatest(score,1e-7),1e0-1e-7)))+0.07699e0))) as cal from pred",
               r="""select *, rank() over (partition by model order by score) + (count(*) over (partition by model, score)-1)/2e0 as r1,
 rank() over (partition by model order by round(cal,12)) + (count(*) over (partition by model, round(cal,12))-1)/2e0 as r2 from q""")
       + f"select model, {rnd('max(abs(r1-r2))')} as rank_change, max(abs(r1-r2))=0 as auroc_unchanged from r group by 1")
def calibration_keeps_ranking(spark, d):
    """AUROC before and after a monotone calibration is the same."""
    from plumbline.operators.calibration import Calibration, apply_calibration
    p = V.pred(spark, d)
    cal = p.withColumn("score", F.round(apply_calibration("score", Calibration("platt", A=0.454958, B=0.07699)), 12))
    auc = lambda df, n: curve_metrics(curve_points(score_histogram(df, ["model"]), ["model"]), ["model"]).select("model", F.col("auroc").alias(n))
    j = auc(p, "before").join(auc(cal, "after"), "model")
    return j.select("model", rounded(F.abs(F.col("before") - F.col("after")), 6).alias("rank_change"), (F.abs(F.col("before") - F.col("after")) < 1e-9).alias("auroc_unchanged"))


# --------------------------------------------------------------------------- multi-view studies

def _fused_sql(views, rule):
    cols = [f"p_{v}" for v in views]
    n, lst = len(cols), "list_sort([" + ",".join(f"p_{v}" for v in views) + "])"
    if n == 1:
        return cols[0]
    if rule == "mean":
        return f"({'+'.join(cols)})/{n}e0"
    if rule == "max":
        return f"greatest({','.join(cols)})"
    if rule == "median":
        return f"({lst})[{n // 2 + 1}]" if n % 2 else f"(({lst})[{n // 2}]+({lst})[{n // 2 + 1}])/2e0"
    return "(" + "+".join(f"({lst})[{i}]" for i in range(2, n)) + f")/{n - 2}e0"


def fused_union(sets, rules):
    return " union all ".join(f"select '{s}' as view_set, '{r}' as rule, sample_id, y, category, {_fused_sql(v, r)} as fused from views"
                              for s, v in sets.items() for r in rules if r != "trimmed_mean" or len(v) >= 3)


_RULES = ("mean", "median", "max", "trimmed_mean")
_FUSED = {"f": f"select *, cast(fused>=0.5 as integer) as pred from ({fused_union(fu.VIEW_SETS, _RULES)})"}


def fused_rows(spark, d, sets=None, rules=_RULES, keep=("sample_id", "y", "category")):
    f = fu.explode_fusion(V.views(spark, d), keep, fu.fusion_table(sets or fu.VIEW_SETS, rules))
    return f.withColumn("pred", (F.col("fused") >= 0.5).cast("int"))


@query("G14, K3", W("views", **_FUSED, c=f"select view_set, rule, {SQL_COUNTS}, avg(fused) as m from f group by 1,2") + f"select view_set, rule, tp, tn, fp, fn, {sql_rates('recall', 'specificity', 'fpr', 'f1')}, {rnd('m')} as mean_fused from c")
def view_set_fusion(spark, d):
    f = fused_rows(spark, d, keep=("y",))
    g = f.groupBy("view_set", "rule").agg(*mt.cell_counts("y", "pred"), F.avg("fused").alias("mean_fused"))
    return reported(mt.with_rates(g, ("recall", "specificity", "fpr", "f1")))


_ABL = fu.leave_one_out(fu.VIEW_SETS["H"], fu.VIEW_SETS["H"][1:])


@query("G15", W("views", f=f"select *, cast(fused>=0.5 as integer) as pred from ({fused_union(_ABL, ('max',))})", c=f"select view_set, {SQL_COUNTS} from f group by 1") + f"select view_set, {sql_rates('recall', 'specificity', 'fpr', 'f1')} from c")
def leave_one_view_out(spark, d):
    f = fused_rows(spark, d, _ABL, ("max",), keep=("y",))
    return reported(mt.binary_metrics(f, ["view_set"], names=("recall", "specificity", "fpr", "f1")).drop(*mt.COUNTS))


_BRANCH = fu.VIEWS[1:]


@query("G16", W("views") + " union all ".join(f"select '{v}' as branch, {rnd(f'avg(p_{v}-p_native)')} as mean_delta, count(*) filter (where p_{v}<p_native) as n_decreased, count(*) filter (where p_{v}>p_native) as n_increased from views" for v in _BRANCH))
def branch_ablation_summary(spark, d):
    """Change from the base score per variant: mean, and how many samples went down or up."""
    v = V.views(spark, d).select(F.explode(F.array(*[F.struct(F.lit(b).alias("branch"), (F.col(f"p_{b}") - F.col("p_native")).alias("delta")) for b in _BRANCH])).alias("b")).select("b.*")
    return reported(v.groupBy("branch").agg(*fu.delta_summary(F.col("delta"))))


@query("G16", W("views", r="select category, " + ", ".join(f"p_{v}" for v in fu.VIEWS) + ", greatest(" + ",".join(f"p_{v}" for v in fu.VIEWS) + ")-least(" + ",".join(f"p_{v}" for v in fu.VIEWS) + ") as spread, "
               + "+".join(f"cast((p_{v}>=0.5)<>(p_native>=0.5) as integer)" for v in _BRANCH) + " as changes from views")
       + f"select category, {rnd('avg(spread)')} as mean_range, {rnd('max(spread)')} as max_range, count(*) filter (where changes>0) as n_changed, sum(changes)::bigint as n_changes from r group by 1")
def crop_sensitivity(spark, d):
    ps = [F.col(f"p_{v}") for v in fu.VIEWS]
    base = F.col("p_native") >= 0.5
    changes = sum([((p >= 0.5) != base).cast("int") for p in ps[2:]], ((ps[1] >= 0.5) != base).cast("int"))
    r = V.views(spark, d).select("category", (F.greatest(*ps) - F.least(*ps)).alias("spread"), changes.alias("changes"))
    return reported(r.groupBy("category").agg(F.avg("spread").alias("mean_range"), F.max("spread").alias("max_range"), F.count_if(F.col("changes") > 0).alias("n_changed"), F.sum("changes").alias("n_changes")))


_RECOVER = " union all ".join(f"""select '{v}' as view, count(*) filter (where y=1 and p_native<0.5) as base_fn, count(*) filter (where y=1 and p_native<0.5 and p_{v}>=0.5) as recovered_fn,
 count(*) filter (where y=1 and p_native>=0.5 and p_{v}<0.5) as lost_tp, count(*) filter (where y=0 and p_{v}>=0.5) as fp, count(*) filter (where y=0 and p_{v}>=0.5 and p_native<0.5) as new_fp,
 count(*) filter (where y=0 and p_{v}<0.5 and p_native>=0.5) as cleared_fp from views""" for v in _BRANCH)


@query("H29, J9", W("views") + _RECOVER)
def false_negative_recovery(spark, d):
    """What each alternative view recovers, loses, newly alarms and clears against the base view."""
    long = V.views(spark, d).select("y", F.col("p_native").alias("base"), F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(f"p_{v}").alias("other")) for v in _BRANCH])).alias("v")).select("y", "base", "v.view", "v.other")
    return long.groupBy("view").agg(*fu.recovery("base", "other"))


_ALT = " union all ".join(f"select category, '{v}' as view, {i} as ord, p_{v} as p, p_native, y from views" for i, v in enumerate(_BRANCH))


@query("H30", W("views", a=_ALT, r="""select category, view, ord, avg((p>=0.5)::integer) as recall, count(*) filter (where p_native<0.5) as native_misses, count(*) filter (where p_native<0.5 and p>=0.5) as recovered
 from a where y=1 group by 1,2,3""", b="select *, row_number() over (partition by category order by recall desc, ord) as rn, row_number() over (partition by category order by recovered desc, ord) as up, row_number() over (partition by category order by recovered, ord) as down from r")
       + f"""select category, max(case when rn=1 then view end) as best_view, {rnd('max(recall)')} as best_recall, max(native_misses)::bigint as native_misses, max(case when up=1 then view end) as most_recovering_view,
 max(recovered)::bigint as most_recovered, max(case when down=1 then view end) as least_useful_view, min(recovered)::bigint as least_recovered from b group by 1""")
def best_view_per_category(spark, d):
    """Per category the alternative view with the highest recall, how many positives the native view misses, and the views that recover most and
    fewest of them; the first listed wins a tie."""
    long = V.views(spark, d).where("y = 1").select("category", "p_native", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(v).alias("view"), F.col(f"p_{v}").alias("p")) for i, v in enumerate(_BRANCH)])).alias("v")).select("category", "p_native", "v.*")
    missed, hit = F.col("p_native") < 0.5, F.col("p") >= 0.5
    r = long.groupBy("category", "ord", "view").agg(ratio(F.count_if(hit), F.count("*")).alias("recall"), F.count_if(missed).alias("native_misses"), F.count_if(missed & hit).alias("recovered"))
    return reported(r.groupBy("category").agg(
        F.max_by("view", F.struct(F.col("recall"), -F.col("ord"))).alias("best_view"), F.max("recall").alias("best_recall"), F.max("native_misses").alias("native_misses"),
        F.max_by("view", F.struct(F.col("recovered"), -F.col("ord"))).alias("most_recovering_view"), F.max("recovered").alias("most_recovered"),
        F.min_by("view", F.struct("recovered", "ord")).alias("least_useful_view"), F.min("recovered").alias("least_recovered")))


@query("H30", W("views", **_FUSED, r="select category, view_set||'_'||rule as fusion, avg(pred) as recall from f where y=1 group by 1,2", b="select *, row_number() over (partition by category order by recall desc, fusion) as rn from r")
       + f"select category, fusion as best_fusion, {rnd('recall')} as best_recall from b where rn=1")
def best_fusion_per_category(spark, d):
    f = fused_rows(spark, d, keep=("y", "category")).where("y = 1")
    r = f.groupBy("category", F.concat_ws("_", "view_set", "rule").alias("fusion")).agg(F.avg(F.col("pred").cast("double")).alias("recall"))
    return reported(r.groupBy("category").agg(F.min_by("fusion", F.struct(-F.col("recall"), F.col("fusion"))).alias("best_fusion"), F.max("recall").alias("best_recall")))


_PLAIN = ("native", "pad_1_1", "pad_16_9", "pad_9_16", "pad_narrow")


@query("H31", W("views", a=" union all ".join(f"select '{q}' as compressed, p_{q} as p, greatest({','.join('p_' + v for v in _PLAIN)}) as best from views where y=1" for q in ("jpeg_95", "jpeg_75")))
       + f"select compressed, count(*) filter (where p<0.5) as missed, count(*) filter (where p<0.5 and best>=0.5) as recovered, {rnd('count(*) filter (where p<0.5 and best>=0.5)/count(*) filter (where p<0.5)')} as recovery_rate from a group by 1")
def compression_recovery(spark, d):
    """Misses of a compressed view that any uncompressed view catches."""
    any_plain = F.exists(F.array(*[F.col(f"p_{v}") for v in _PLAIN]), lambda p: p >= 0.5)
    long = V.views(spark, d).where("y = 1").select(any_plain.alias("caught"), F.explode(F.array(*[F.struct(F.lit(q).alias("compressed"), F.col(f"p_{q}").alias("p")) for q in ("jpeg_95", "jpeg_75")])).alias("c")).select("caught", "c.*")
    missed = F.col("p") < 0.5
    g = long.groupBy("compressed").agg(F.count_if(missed).alias("missed"), F.count_if(missed & F.col("caught")).alias("recovered"))
    return reported(g.withColumn("recovery_rate", ratio("recovered", "missed")))


@query("H32, H40", W("pred") + f"select model, count(*) as n, count(*) filter (where pred=0) as tn, count(*) filter (where pred=1) as fp, {rnd('avg(1-pred)')} as specificity, {rnd('avg(score)')} as mean_score from pred where y=0 group by 1")
def specificity_only(spark, d):
    """A set without positives: counts, specificity and mean score; nothing that needs a positive."""
    g = V.pred(spark, d).where("y = 0").groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == 0).alias("tn"), F.count_if(F.col("pred") == 1).alias("fp"), F.avg("score").alias("mean_score"))
    return reported(g.select("model", "n", "tn", "fp", ratio("tn", "n").alias("specificity"), "mean_score"))


# --------------------------------------------------------------------------- condition studies

_CC = f"select condition, family, level, cond_order, model, {SQL_COUNTS} from cond group by 1,2,3,4,5"
_ROLL = {"c": _CC, "m": "select *, coalesce(2e0*tp/nullif(2*tp+fp+fn,0),0) as f1, (tp+tn)::double/(tp+tn+fp+fn) as accuracy from c",
         "j": "select m.*, k.f1 as clean_f1, k.accuracy as clean_accuracy from m join m k on k.model=m.model and k.condition='clean'"}


def condition_rollup(spark, d, names=("accuracy", "f1", "balanced_accuracy", "mcc")):
    return mt.binary_metrics(V.cond(spark, d), ["condition", "family", "level", "cond_order", "model"], names=names)


def condition_table(spark, d):
    m = condition_rollup(spark, d, ("accuracy", "f1"))
    return rb.against_clean(m, ["f1", "accuracy"], F.col("condition") == "clean")


@query("H33, C15", W("cond", **_ROLL) + f"""select condition, model, tp, tn, fp, fn, {rnd('f1')} as f1, {rnd('clean_f1')} as clean_f1, {rnd('clean_f1-f1')} as f1_drop, {rnd('(clean_f1-f1)/clean_f1*100')} as f1_drop_pct,
 {rnd('f1/clean_f1')} as f1_retention from j where condition<>'clean'""")
def robustness_retention(spark, d):
    t = condition_table(spark, d).where("condition <> 'clean'")
    r = rb.retention("f1")
    return reported(t.select("condition", "model", *mt.COUNTS, "f1", "clean_f1", *[c.alias(n) for n, c in r.items()]))


_BW = "select *, row_number() over (partition by model order by f1 desc, cond_order) as hi, row_number() over (partition by model order by f1, cond_order) as lo from j where condition<>'clean'"


@query("H34", W("cond", **_ROLL, b=_BW) + f"""select model, {rnd('avg(f1)')} as mean_f1, max(case when hi=1 then condition end) as best_condition, {rnd('max(f1)')} as best_f1,
 max(case when lo=1 then condition end) as worst_condition, {rnd('min(f1)')} as worst_f1, {rnd('avg(clean_f1-f1)')} as mean_drop from b group by 1""")
def robustness_summary(spark, d):
    t = condition_table(spark, d).where("condition <> 'clean'")
    s = rb.best_and_worst(t, ["model"], "f1", "condition", "cond_order")
    return reported(s.join(t.groupBy("model").agg(F.avg(F.col("clean_f1") - F.col("f1")).alias("mean_drop")), "model"))


_WHO = ("all", "positive", "negative")
_BUCKET_SQL = dict(zip(rb.SHIFT_BUCKETS, ("dl < -0.1e0", "dl >= -0.1e0 and dl < -0.05e0", "abs(dl) <= 0.05e0", "dl > 0.05e0 and dl <= 0.1e0", "dl > 0.1e0"), strict=True))
_STUDY_RATES = ("accuracy", "precision", "recall", "f1")


def _study_sql():
    stats = {"mean": ("avg(dl)", 9), "median": ("median(dl)", 9), "std": ("stddev_pop(dl)", 7)} | {n: (f"count(*) filter ({t})*100e0/count(*)", 9) for n, t in _BUCKET_SQL.items()}
    parts = {
        "sh": "select condition, y, cast(score > 0.5e0 as integer) as pred, round(score-p_native, 9)+0e0 as dl from grid",
        "c": f"select condition, {SQL_COUNTS} from sh group by 1",
        "sc": "select 'all' as who, * from sh union all select case y when 1 then 'positive' else 'negative' end, * from sh",
        "ag": "select condition, who, count(*) as n, " + ", ".join(f"{rnd(x, digits)} as {n}" for n, (x, digits) in stats.items()) + " from sc group by 1,2",
        "wd": "select condition, " + ", ".join(f"max(case when who='{w}' then {n} end) as {w}_{n}" for w in _WHO for n in ("n", *stats)) + " from ag group by 1",
        "xx": "select condition, dl from sh where y=1", **signed_rank_sql("xx", "condition"),
        "ts": f"select condition, least(w_plus,w_minus) as statistic, {two_sided_sql('z')} as p from zz",
    }
    return W("grid", **parts) + f"""select condition, tp, tn, fp, fn, {sql_rates(*_STUDY_RATES)}, {', '.join(f'{w}_{n}' for w in _WHO for n in ('n', *stats))},
 coalesce(statistic, 0e0) as statistic, {rnd('coalesce(p, 1e0)')} as p_value, coalesce(p, 1e0) < 0.05e0/39 as bonferroni_significant from c join wd using (condition) left join ts using (condition)"""


@query("H35, B15, I5", _study_sql())
def condition_shift_study(spark, d):
    """40 conditions of aspect ratio and compression against the untouched score: confusion and rates, moments and five buckets of the shift for all, positive and
    negative rows, the signed-rank test of the positive ones, and Bonferroni over the 39 conditions beside the baseline."""
    out = rb.condition_study(V.grid(spark, d), "condition", "native_baseline", "y", "p_native", "score", inclusive=False, metrics=_STUDY_RATES)
    keep = ("condition", "tp", "tn", "fp", "fn", "statistic", "bonferroni_significant", *(f"{w}_n" for w in _WHO))
    return out.select(*[F.col(c) if c in keep else rounded(c, 7 if c.endswith("_std") else 9).alias(c) for c in out.columns])


@query("H35", W("cond", s="select condition, gt, score-clean_score as dl from cond") + f"""select condition, gt, count(*) as n, {rnd('avg(dl)')} as mean_delta, {rnd('median(dl)')} as median_delta, {rnd('stddev_pop(dl)', 7)} as std_delta from s group by 1,2""")
def condition_shift_by_class(spark, d):
    """Score shift against clean per condition and class: mean, median, spread."""
    out = describe_counted(V.cond_shifts(spark, d), ["condition", "gt"], "delta", "n", {"median_delta": 0.5})
    return out.select("condition", "gt", "n", rounded("mean").alias("mean_delta"), rounded("median_delta").alias("median_delta"), rounded("std", 7).alias("std_delta"))


@query("H35", W("cond", c=f"select condition, generator, {SQL_COUNTS} from cond group by 1,2") + f"select condition, generator, tp, tn, fp, fn, {sql_rates('accuracy')} from c")
def condition_by_category(spark, d):
    return reported(mt.binary_metrics(V.cond(spark, d), ["condition", "generator"], names=("accuracy",)))


_HH = "select condition, max(case when model='A' then f1 end) as a, max(case when model='D' then f1 end) as b from m group by 1"


@query("H36", W("cond", c=_CC, m=_ROLL["m"], h=_HH) + f"select condition, {rnd('a')} as first, {rnd('b')} as second, {rnd('b-a')} as difference from h")
def head_to_head_by_condition(spark, d):
    return reported(rb.head_to_head(condition_rollup(spark, d, ("f1",)), "A", "D", "f1", ["condition"]))


@query("H36", W("cond", c=_CC, m=_ROLL["m"], h=_HH) + f"""select count(*) filter (where b>a) as second_better, count(*) filter (where b<a) as first_better, count(*) filter (where b=a) as tied, {rnd('avg(b-a)')} as mean_difference
 from h where condition<>'clean'""")
def head_to_head_totals(spark, d):
    h = rb.head_to_head(condition_rollup(spark, d, ("f1",)), "A", "D", "f1", ["condition"]).where("condition <> 'clean'")
    return reported(h.agg(F.count_if(F.col("difference") > 0).alias("second_better"), F.count_if(F.col("difference") < 0).alias("first_better"), F.count_if(F.col("difference") == 0).alias("tied"),
                          F.avg("difference").alias("mean_difference")))


@query("H37", W("cond", **_ROLL) + f"select condition, model, {rnd('clean_accuracy')} as clean_accuracy, {rnd('accuracy')} as accuracy, {rnd('clean_accuracy-accuracy')} as accuracy_drop from j")
def accuracy_drop_table(spark, d):
    t = condition_table(spark, d)
    return reported(t.select("condition", "model", "clean_accuracy", "accuracy", (F.col("clean_accuracy") - F.col("accuracy")).alias("accuracy_drop")))


@query("J1", W("cond", c=_CC, m=_ROLL["m"]) + f"select condition, model, {rnd('f1')} as f1, row_number() over (partition by condition order by round(f1,12) desc, model) as rank from m")
def rank_models_per_condition(spark, d):
    m = condition_rollup(spark, d, ("f1",))
    return reported(mt.rank_within(m, ["condition"], F.desc(F.round("f1", 12)), F.col("model")).select("condition", "model", "f1", "rank"))


@query("H38", W("cond", **_ROLL, cl="select model, f1 as clean_f1 from m where condition='clean'", rob="select model, avg(f1) as robust_f1 from m where condition<>'clean' group by 1",
               gen="select model, avg(r) as macro_recall from (select model, generator, avg(pred) as r from cond where condition='clean' and y=1 group by 1,2) group by 1",
               x="select *, row_number() over (order by clean_f1 desc, model) as clean_rank, row_number() over (order by robust_f1 desc, model) as robust_rank, row_number() over (order by macro_recall desc, model) as external_rank from cl join rob using (model) join gen using (model)")
       + f"select model, {rnd('clean_f1')} as clean_f1, {rnd('robust_f1')} as robust_f1, {rnd('macro_recall')} as macro_recall, clean_rank, robust_rank, external_rank, clean_rank-robust_rank as rank_change from x")
def longitudinal_comparison(spark, d):
    """Clean, robustness and per-generator results side by side with the change of rank."""
    m = condition_rollup(spark, d, ("f1",))
    summary = m.groupBy("model").agg(F.max(F.when(F.col("condition") == "clean", F.col("f1"))).alias("clean_f1"), F.avg(F.when(F.col("condition") != "clean", F.col("f1"))).alias("robust_f1"))
    g = V.pred(spark, d).where("y = 1").groupBy("model", "generator").agg(F.avg(F.col("pred").cast("double")).alias("r")).groupBy("model").agg(F.avg("r").alias("macro_recall"))
    j = summary.join(g, "model")
    for metric, name in (("clean_f1", "clean_rank"), ("robust_f1", "robust_rank"), ("macro_recall", "external_rank")):
        j = mt.rank_within(j, [], F.desc(metric), F.col("model"), name=name)
    return reported(j.withColumn("rank_change", F.col("clean_rank") - F.col("robust_rank")))


_HYP = {"g": "select generator, model, avg(pred) as r from pred where y=1 group by 1,2", "c": f"select model, {SQL_COUNTS} from pred group by 1", "k": f"select model, {sql_rates('fpr', 'macro_f1')} from c",
        "w": WIDE_SQL}


def _h(gen, m):
    return f"(select r from g where generator='{gen}' and model='{m}')"


@query("H39", W("pred", **_HYP) + f"""select 'H1_new_generator_recall' as hypothesis, {_h('view', 'D')}>=0.5 and {_h('view', 'D')}>{_h('view', 'A')} as supported
 union all select 'H2_no_forgetting', {_h('click', 'D')}>={_h('click', 'A')}-0.15e0 union all select 'H3_unseen_transfer', {_h('signup', 'D')}>{_h('signup', 'A')}
 union all select 'H4_false_alarms_within_10_percent', (select fpr from k where model='D')<=0.1
 union all select 'H5_misses_recovered', (select count(*) filter (where y=1 and pred_D=0 and pred_B=1)>0 or count(*) filter (where y=1 and pred_D=0)=0 from w)
 union all select 'H6_macro_f1_better', (select macro_f1 from k where model='D')>(select macro_f1 from k where model='A')""")
def hypothesis_gate(spark, d):
    """Six yes/no hypotheses about model D against model A, decided from the metrics in one row."""
    p = V.pred(spark, d)
    rec = lambda g, m: ratio(F.count_if((F.col("generator") == g) & (F.col("model") == m) & (F.col("pred") == 1)), F.count_if((F.col("generator") == g) & (F.col("model") == m)))
    row = p.agg(*[rec(g, m).alias(f"{g}_{m}") for g in ("view", "click", "signup") for m in "AD"])
    k = mt.with_rates(mt.confusion(p, ["model"]), ("fpr", "macro_f1")).agg(
        F.max(F.when(F.col("model") == "D", F.col("fpr"))).alias("fpr_D"), *[F.max(F.when(F.col("model") == m, F.col("macro_f1"))).alias(f"mf_{m}") for m in "AD"])
    miss = (F.col("y") == 1) & (F.col("pred_D") == 0)
    r = cells(spark, d).agg(F.coalesce(F.sum(F.when(miss, F.col("n"))), F.lit(0)).alias("missed"), F.coalesce(F.sum(F.when(miss & (F.col("pred_B") == 1), F.col("n"))), F.lit(0)).alias("recovered"))
    # Three one-row tables side by side: as (metric, value) rows in one union, folded into one row. No join.
    names = [n for x in (row, k, r) for n in x.columns]
    long = values_long(row, [], row.columns).unionByName(values_long(k, [], k.columns)).unionByName(values_long(r, [], r.columns))
    j = long.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])
    c = F.col
    tests = {
        "H1_new_generator_recall": (c("view_D") >= 0.5) & (c("view_D") > c("view_A")), "H2_no_forgetting": c("click_D") >= c("click_A") - 0.15,
        "H3_unseen_transfer": c("signup_D") > c("signup_A"), "H4_false_alarms_within_10_percent": c("fpr_D") <= 0.10,
        "H5_misses_recovered": (c("recovered") > 0) | (c("missed") == 0), "H6_macro_f1_better": c("mf_D") > c("mf_A"),
    }
    return j.select(F.explode(F.array(*[F.struct(F.lit(n).alias("hypothesis"), t.alias("supported")) for n, t in tests.items()])).alias("t")).select("t.*")


# --------------------------------------------------------------------------- nested reports

@query("K1", "select event_type, count(*) as n, sum(cast(json_extract_string(props,'$.k') as bigint))::bigint as sum_k from events group by 1")
def flatten_json_props(spark, d):
    """A JSON column parsed with a stated schema into a map, exploded and summed."""
    e = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string, bigint>")).alias("name", "value"))
    return e.where("name = 'k'").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("sum_k"))


@query("K1", W("cond", c=_CC) + f"select model, condition, tp as true_positive, tp+tn+fp+fn as total, {sql_rates('accuracy', 'f1')} from c")
def metric_report_round_trip(spark, d):
    """The model -> condition -> metrics report built as JSON text and flattened again by two explodes."""
    from plumbline.sources.reports import flatten_report
    m = reported(condition_rollup(spark, d, ("accuracy", "precision", "recall", "f1")))
    leaf = m.select("model", "condition", "accuracy", "precision", "recall", "f1", F.col("tp").alias("true_positive"), F.col("tn").alias("true_negative"), F.col("fp").alias("false_positive"),
                    F.col("fn").alias("false_negative"), (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("total"))
    rep = nested_report(leaf, "model", "condition", ["accuracy", "precision", "recall", "f1", "true_positive", "true_negative", "false_positive", "false_negative", "total"])
    flat = flatten_report(rep.select(F.concat(F.lit('{"models":'), F.col("report"), F.lit("}")).alias("t")), "t")
    return flat.select("model", "condition", "true_positive", "total", "accuracy", "f1")


@query("K2", W("pred", r=f"select generator, model, {sql_rates('accuracy', 'recall')}, tp, fn from (select generator, model, {SQL_COUNTS} from pred group by 1,2)",
               e="""select model, string_agg('"'||generator||'":{"accuracy":'||accuracy::varchar||',"recall":'||recall::varchar||',"tp":'||tp||',"fn":'||fn||'}', ',' order by generator) as j from r group by 1""")
       + """select '{'||string_agg('"'||model||'":{'||j||'}', ',' order by model)||'}' as report from e""")
def nested_json_report(spark, d):
    m = reported(mt.binary_metrics(V.pred(spark, d), ["generator", "model"], names=("accuracy", "recall")))
    return nested_report(m, "model", "generator", ["accuracy", "recall", "tp", "fn"])


@query("J6", """select event_id, user_id, rank from (select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events) where rank <= 50""")
def recent_history_per_user(spark, d):
    """The newest fifty events of every user; Spark keeps fifty per user per task before the shuffle."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return mt.rank_within(e, ["user_id"], F.desc("ts"), F.desc("event_id")).where("rank <= 50").select("event_id", "user_id", "rank")


@query("J6", "select event_id, user_id, event_type from events order by ts desc, event_id desc limit 50")
def recent_history(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


@query("J10, J7", "select event_type, user_id, count(*) as n from events group by 1,2 order by n desc, event_type, user_id limit 30")
def most_common(spark, d):
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type", "user_id").limit(30)


@query("J9", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def key_set_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
