"""Metric queries on the prediction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scalars import confidence, ratio, rounded, snapped
from plumbline.operators import curves, metrics as mt
from plumbline.operators.prefix import describe
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.plans.views import SQL_COUNTS, rnd, sql_points, sql_rates, with_views
from plumbline.sources.scans import table

W = with_views
RATES = mt.MAIN_RATES


def reported(df, *skip):
    """Round every double column for the report."""
    return df.select(*[rounded(f.name).alias(f.name) if f.dataType.simpleString() == "double" and f.name not in skip else F.col(f.name) for f in df.schema])


_COUNTED = f"select model, {SQL_COUNTS} from pred group by 1"


@query("H1", W("pred", c=_COUNTED) + f"select model, tp, tn, fp, fn, {sql_rates(*RATES)} from c")
def binary_metrics_by_model(spark, d):
    return reported(mt.binary_metrics(V.pred(spark, d), ["model"]))


@query("H1, J1, J7", W("pred", c=_COUNTED, r=f"select model, tp, tn, fp, fn, {sql_rates('accuracy', 'f1')} from c")
       + "select *, row_number() over (order by f1 desc, model) as rank from r")
def model_ranking(spark, d):
    m = reported(mt.binary_metrics(V.pred(spark, d), ["model"], names=("accuracy", "f1")))
    return mt.rank_within(m, [], F.desc("f1"), F.col("model"))


@query("H1", "WITH pred as (select quality as y, toxic as pred from labels), c as (select " + SQL_COUNTS + f" from pred) select tp, tn, fp, fn, {sql_rates(*RATES)} from c")
def unbalanced_confusion(spark, d):
    """The two label columns against each other: a confusion table with very unequal classes."""
    lab = table(spark, d, "labels").select(F.col("quality").alias("y"), F.col("toxic").alias("pred"))
    return reported(mt.binary_metrics(lab, []))


@query("H1", W("pred", p2="select model, 1-y as y, 1-pred as pred from pred", c=f"select model, {SQL_COUNTS} from p2 group by 1") + f"select model, tp, tn, fp, fn, {sql_rates('precision', 'recall', 'f1')} from c")
def negative_as_positive_class(spark, d):
    """The same table with REAL as the positive class."""
    return reported(mt.with_rates(mt.confusion(V.pred(spark, d), ["model"], positive=0), ("precision", "recall", "f1")))


@query("H2", W("pred", c=_COUNTED) + f"select model, {sql_rates(*mt.MACRO_RATES)} from c")
def macro_metrics_by_model(spark, d):
    m = mt.with_rates(mt.confusion(V.pred(spark, d), ["model"]), mt.MACRO_RATES)
    return reported(m.drop(*mt.COUNTS))


_PTS = sql_points("pred", "model")


def _points(spark, d):
    return curves.curve_points(curves.score_histogram(V.pred(spark, d), ["model"]), ["model"])


@query("H4, J3", W("pred", **_PTS) + f"""select model, score as threshold, {rnd('fp::double/nn')} as fpr, {rnd('tp::double/np')} as tpr from pts
 union all select model, max(score)+1e-6, 0e0, 0e0 from pred group by 1""")
def roc_curve_points(spark, d):
    return reported(curves.roc_curve(_points(spark, d), ["model"]), "threshold")


@query("H5, J4", W("pred", **_PTS, l="select *, lag(tp,1,0) over (partition by model order by score desc) as tp0, lag(fp,1,0) over (partition by model order by score desc) as fp0 from pts")
       + f"select model, {rnd('sum((fp-fp0)::double/nn*(tp+tp0)::double/np/2)')} as auroc from l group by 1")
def auroc_trapezoid(spark, d):
    return reported(curves.curve_metrics(_points(spark, d), ["model"]).select("model", "auroc"))


@query("H6, J5", W("pred", r="select *, rank() over (partition by model order by score) + (count(*) over (partition by model, score)-1)/2e0 as rk from pred")
       + f"""select model, {rnd('(sum(rk) filter (where y=1) - count(*) filter (where y=1)*(count(*) filter (where y=1)+1)/2e0)/(count(*) filter (where y=1)::double*count(*) filter (where y=0))')} as auroc from r group by 1""")
def auroc_by_ranks(spark, d):
    return reported(curves.auroc_rank_sum(_points(spark, d), ["model"]))


@query("H7", W("pred", **_PTS, l="select *, lag(tp,1,0) over (partition by model order by score desc) as tp0 from pts")
       + f"select model, {rnd('sum((tp-tp0)::double/np*tp::double/(tp+fp))')} as average_precision from l group by 1")
def average_precision(spark, d):
    return reported(curves.curve_metrics(_points(spark, d), ["model"]).select("model", "average_precision"))


@query("H8", W("pred", **_PTS, g="""select model, (fp::double/nn+1e0-tp::double/np)/2e0 as e, row_number() over (partition by model order by abs(fp::double/nn-(1e0-tp::double/np)), score desc) as rn from pts""")
       + f"select model, {rnd('e')} as eer from g where rn=1")
def equal_error_rate(spark, d):
    return reported(curves.curve_metrics(_points(spark, d), ["model"]).select("model", "eer"))


def _tpr_sql(x):
    return f"""(select {rnd(f"coalesce(a.t0,0)+coalesce((b.t1-coalesce(a.t0,0))*({x}e0-coalesce(a.f0,0))/(b.f1-coalesce(a.f0,0)),0)")} from
 (select max(fp::double/nn) as f0, max(tp::double/np) as t0 from pts where pts.model=m.model and fp::double/nn <= {x}e0) a,
 (select min(fp::double/nn) as f1, min(tp::double/np) as t1 from pts where pts.model=m.model and fp::double/nn > {x}e0) b)"""


@query("H9", W("pred", **_PTS) + f"select model, {_tpr_sql(0.01)} as tpr_at_fpr_1, {_tpr_sql(0.05)} as tpr_at_fpr_5, {_tpr_sql(0.1)} as tpr_at_fpr_10 from (select distinct model from pts) m")
def tpr_at_fixed_fpr(spark, d):
    return reported(curves.curve_metrics(_points(spark, d), ["model"]).select("model", "tpr_at_fpr_1", "tpr_at_fpr_5", "tpr_at_fpr_10"))


def _scores_sql(eps):
    q = f"least(greatest(score,{eps}),1e0-{eps})"
    return f"{rnd(f'-avg(y*ln({q})+(1-y)*ln(1e0-{q}))')} as nll, {rnd('avg((score-y)*(score-y))', 10)} as brier"


@query("H10", W("pred") + f"select model, {_scores_sql('1e-12')} from pred group by 1")
def nll_and_brier(spark, d):
    m = mt.proper_scores(V.pred(spark, d), ["model"])
    return m.select("model", rounded("nll").alias("nll"), rounded("brier", 10).alias("brier"))


def bins_sql(source, keys, on="score"):
    """Reliability bins by counting the edges at or below the value."""
    edges = " + ".join(f"cast({on} >= {i}*0.1e0 as integer)" for i in range(1, 10))
    filled = (f"select {keys}, {edges} as bin, count(*) as n, avg(((score>=0.5)::integer=y)::integer) as bin_accuracy, avg(greatest(score,1e0-score)) as bin_confidence, "
              f"avg(score) as mean_score, avg(y) as positive_share from {source} group by {keys}, bin")
    return {"filled": filled, "frame": f"select distinct {keys}, cast(range as integer) as bin from filled, range(10)"}


@query("H11", W("pred", **bins_sql("pred", "model")) + f"""select f.model, f.bin, coalesce(n,0) as n, {rnd('bin_accuracy')} as bin_accuracy, {rnd('bin_confidence')} as bin_confidence,
 {rnd('coalesce(mean_score,(f.bin+0.5e0)/10e0)')} as mean_score, {rnd('positive_share')} as positive_share from frame f left join filled x on f.model=x.model and f.bin=x.bin""")
def reliability_table(spark, d):
    return reported(mt.reliability_bins(V.pred(spark, d), ["model"]))


_ECE = f"{rnd('sum(n*abs(bin_accuracy-bin_confidence))/sum(n)')} as ece, {rnd('max(abs(bin_accuracy-bin_confidence))')} as mce"


@query("H11", W("pred", **bins_sql("pred", "model")) + f"select model, {_ECE} from filled group by 1")
def calibration_error_by_probability(spark, d):
    return reported(mt.calibration_error(mt.reliability_bins(V.pred(spark, d), ["model"]), ["model"]))


@query("H11", W("pred", **bins_sql("pred", "model", "greatest(score,1e0-score)")) + f"select model, {_ECE} from filled group by 1")
def calibration_error_by_confidence(spark, d):
    return reported(mt.calibration_error(mt.reliability_bins(V.pred(spark, d), ["model"], bin_on="confidence"), ["model"]))


_LEVELS = ", ".join(f"({t}e0)" for t in mt.COVERAGE_LEVELS)


@query("H12", W("pred", lv=f"select t as level from (values {_LEVELS}) v(t)", c="""select model, level, count(*) as total, count(*) filter (where k) as covered, count(*) filter (where k and pred=y) as hit,
 count(*) filter (where k and pred=1 and y=1) as tp, count(*) filter (where k and pred=1 and y=0) as fp, count(*) filter (where k and pred=0 and y=1) as fn
 from (select *, greatest(score,1e0-score)>=level as k from pred, lv) group by 1,2""") + f"""select model, level, covered, total-covered as abstained, {rnd('covered::double/total')} as coverage,
 {rnd('coalesce(hit::double/nullif(covered,0),1e0)')} as selective_accuracy, {rnd('1e0-coalesce(hit::double/nullif(covered,0),1e0)')} as selective_risk,
 {rnd('coalesce(2e0*tp/nullif(2*tp+fp+fn,0),0)')} as selective_f1 from c""")
def risk_coverage_table(spark, d):
    return reported(mt.risk_coverage(V.pred(spark, d), ["model"]), "level")


@query("H14", W("pred") + f"""select model, y, count(*) as n, {rnd('avg(score)')} as mean, {rnd('median(score)')} as median, {rnd('stddev_pop(score)')} as std, min(score) as lowest, max(score) as highest,
 {rnd('avg((score>=0.5)::integer)*100')} as pct_ge_50, {rnd('avg((score>=0.7)::integer)*100')} as pct_ge_70, {rnd('avg((score>=0.9)::integer)*100')} as pct_ge_90 from pred group by 1,2""")
def probability_summary(spark, d):
    return reported(describe(V.pred(spark, d), ["model", "y"], "score", {"median": 0.5}, {f"pct_ge_{t}": t / 100 for t in (50, 70, 90)}), "lowest", "highest")


_GEN = "select model, generator, count(*) as n, count(*) filter (where pred=1) as tp, count(*) filter (where pred=0) as fn from pred where y=1 group by 1,2"


@query("H15", W("pred", m="select model, generator, avg(score) as mean_score, median(score) as median_score from pred where y=1 group by 1,2", g=_GEN)
       + f"select model, generator, n, tp, fn, {rnd('tp::double/n')} as recall, {rnd('fn::double/n')} as fnr, {rnd('mean_score')} as mean_score, {rnd('median_score')} as median_score from g join m using (model, generator)")
def generator_recall_matrix(spark, d):
    p = V.pred(spark, d).where("y = 1")
    # A decision is its score against the threshold, so the counts too come from the counted scores.
    g = describe(p, ["model", "generator"], "score", {"median_score": 0.5}, {"hit": 0.5}).withColumn("tp", F.round(F.col("hit") * F.col("n") / 100.0).cast("bigint"))
    g = g.withColumn("fn", F.col("n") - F.col("tp"))
    return reported(g.select("model", "generator", "n", "tp", "fn", ratio("tp", "n").alias("recall"), ratio("fn", "n").alias("fnr"), F.col("mean").alias("mean_score"), "median_score"))


@query("H15, F6", W("pred", g=_GEN, r="select model, generator, n, tp, tp::double/n as recall from g") + f"""select model, {rnd('avg(recall)')} as macro_recall, {rnd('min(recall)')} as worst_recall,
 {rnd('stddev_samp(recall)')} as recall_std, {rnd('sum(tp)/sum(n)')} as overall_recall, arg_min(generator, recall*1000000-0e0) as hardest, arg_max(generator, recall) as easiest, min(n)=max(n) as equal_sizes from r group by 1""")
def generator_macro_recall(spark, d):
    """Macro, worst and spread of recall over generators next to the overall recall, which it equals only for equal sizes."""
    g = V.pred(spark, d).where("y = 1").groupBy("model", "generator").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == 1).alias("tp"))
    g = g.withColumn("recall", ratio("tp", "n"))
    return reported(g.groupBy("model").agg(
        F.avg("recall").alias("macro_recall"), F.min("recall").alias("worst_recall"), F.stddev_samp("recall").alias("recall_std"),
        ratio(F.sum("tp"), F.sum("n")).alias("overall_recall"), F.min_by("generator", "recall").alias("hardest"), F.max_by("generator", "recall").alias("easiest"),
        (F.min("n") == F.max("n")).alias("equal_sizes")))


@query("H16", W("pred", neg="select model, count(*) filter (where pred=0) as tn, count(*) filter (where pred=1) as fp from pred where y=0 group by 1", g=_GEN,
               c="select model, generator, tp, tn, fp, fn from g join neg using (model)") + f"select model, generator, tp, tn, fp, fn, {sql_rates(*RATES)} from c")
def generator_against_real(spark, d):
    """Each generator's positives with all negatives. The negatives are counted once and attached to the rollup."""
    from pyspark.sql import Window
    g = mt.confusion(V.pred(spark, d), ["model", "generator"])
    w = Window.partitionBy("model")
    c = g.select("model", "generator", "tp", F.sum("tn").over(w).alias("tn"), F.sum("fp").over(w).alias("fp"), "fn").where("tp + fn > 0")
    return reported(mt.with_rates(c))


SUBGROUPS = {"all": "true", "interactive": "generator in ('view','click','error')", "conversion": "generator in ('signup','purchase','error')", "named_i": "contains(generator,'i') or y=0"}
_SUB = " union all ".join(f"select '{n}' as subgroup, * from pred where {c}" for n, c in SUBGROUPS.items())


@query("H17", W("pred", sub=_SUB, c=f"select subgroup, model, {SQL_COUNTS} from sub group by 1,2", **sql_points("sub", "subgroup, model"),
               l="select *, lag(tp,1,0) over (partition by subgroup,model order by score desc) as tp0, lag(fp,1,0) over (partition by subgroup,model order by score desc) as fp0 from pts",
               a=f"select subgroup, model, {rnd('sum((fp-fp0)::double/nn*(tp+tp0)::double/np/2)')} as auroc from l group by 1,2")
       + f"select subgroup, model, tp, tn, fp, fn, {sql_rates(*RATES)}, auroc from c join a using (subgroup, model)")
def subgroup_metrics(spark, d):
    """Overlapping subgroups by predicate: memberships are exploded from the score histogram, not from the facts."""
    g, y = F.col("generator"), F.col("y")
    member = {"all": F.lit(True), "interactive": g.isin("view", "click", "error"), "conversion": g.isin("signup", "purchase", "error"),
              "named_i": F.contains("generator", F.lit("i")) | (y == 0)}
    names = F.array_compact(F.array(*[F.when(c, n) for n, c in member.items()]))
    p = V.pred(spark, d)
    hist = p.groupBy("model", "generator", "score", "y", "pred").agg(F.count("*").alias("n")).withColumn("subgroup", F.explode(names))
    keys = ["subgroup", "model"]
    counts = mt.with_rates(hist.groupBy(*keys).agg(*mt.cell_counts("y", "pred", F.col("n"))))
    auc = curves.curve_metrics(curves.curve_points(curves.score_histogram(hist, keys, weight="n"), keys), keys).select(*keys, "auroc")
    return reported(counts.join(auc, keys))


@query("H18", W("pred", c=f"select model, grp, {SQL_COUNTS} from pred group by 1,2") + f"select model, grp, tp, tn, fp, fn, {sql_rates('accuracy')}, tp+tn+fp+fn < 10 as small_sample from c")
def category_breakdown(spark, d):
    c = mt.with_rates(mt.confusion(V.pred(spark, d), ["model", "grp"]), ("accuracy",))
    return reported(c.withColumn("small_sample", F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") < 10))


@query("H19", W("pred", c="select *, greatest(score,1e0-score) as conf from pred") + f"""select model, correct, count(*) as n, {rnd('avg(conf)')} as mean_confidence, {rnd('median(conf)')} as median_confidence from c group by 1,2""")
def confidence_by_correctness(spark, d):
    # Confidence is rounded to the scores' own precision so that equal ones are counted together.
    p = V.pred(spark, d).withColumn("conf", snapped(confidence("score"), 9))
    g = describe(p, ["model", "correct"], "conf", {"median_confidence": 0.5})
    return reported(g.select("model", "correct", "n", F.col("mean").alias("mean_confidence"), "median_confidence"))
