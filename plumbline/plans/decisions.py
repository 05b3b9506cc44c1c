"""Decision rules, fusion and calibration on the derived score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scalars import logit, rounded
from plumbline.operators import calibration as cal, metrics as mt, rules
from plumbline.operators.curves import curve_metrics, curve_points, score_histogram
from plumbline.plans import views as V
from plumbline.plans.integrity import DOMAIN_SQL
from plumbline.plans.metrics import bins_sql, reported
from plumbline.plans.registry import query
from plumbline.plans.sampling import _ranked, calibration_half
from plumbline.plans.views import rnd, sql_points, uq, with_views
from plumbline.sources.scoring import linear_scorer, score_batches
from plumbline.sources.scans import table

W = with_views


def decided(df, name, decision):
    return df.withColumn(name, decision).select("*", f"{name}.*").drop(name)


def _decision_query(rule):
    def run(spark, d):
        out = decided(V.branches(spark, d), "_d", rule(rules.Scores.of()))
        return out.select("sample_id", "label", rounded("confidence").alias("confidence"), "decision_case")
    return run


def _cases(*rows, end):
    """CASE over (condition, label, confidence expression, case) rows, one CASE per output column."""
    def one(i):
        return "case " + " ".join(f"when {r[0]} then {r[i]}" for r in rows) + f" else {end[i - 1]} end"
    return f"select sample_id, {one(1)} as label, round_even({one(2)},4)+0e0 as confidence, {one(3)} as decision_case from b"


_B = """select *, greatest(p_real,p_generated) as gc, greatest(p_original,p_manipulated) as mc, least(greatest(p_real,p_generated),greatest(p_original,p_manipulated)) as wk,
 p_generated>=0.5 as sg, p_manipulated>=0.5 as sm from branches"""
_U, _G, _M, _R = "'UNCERTAIN'", "'AI_GENERATED'", "'AI_MANIPULATED'", "'REAL_ORIGINAL'"
_HIER = (
    ("(sg and p_original>=0.85e0 and p_generated<0.9e0) or (sg and sm and abs(p_generated-p_manipulated)<=0.05e0 and p_generated>=0.7e0 and p_manipulated>=0.7e0)", _U, "wk", "'CASE_4_CONTRADICTORY'"),
    ("sg", _G, "p_generated", "'CASE_1_AI_GENERATED'"),
    ("sm", _M, "p_manipulated", "'CASE_3_AI_MANIPULATED'"),
)
_END = (_R, "least(p_real,p_original)", "'CASE_2_REAL_ORIGINAL'")
_LOW = "'CASE_4_LOW_CONFIDENCE'"


@query("G5", W("branches", b=_B) + _cases(("gc<0.55e0", _U, "gc", _LOW), ("mc<0.55e0", _U, "mc", _LOW), *_HIER, end=_END))
def baseline_decisions(spark, d):
    return _decision_query(rules.baseline_engine)(spark, d)


_STRATEGY_SQL = {
    "A": _cases(("wk<0.55e0", _U, "wk", _LOW), *_HIER, end=_END),
    "B": _cases(("p_generated>=0.55e0", _G, "p_generated", "'GEN_FIRST_AI_GENERATED'"), ("p_real>=0.55e0 and p_manipulated>=0.55e0", _M, "p_manipulated", "'GEN_FIRST_AI_MANIPULATED'"),
                ("p_real>=0.55e0 and p_original>=0.55e0", _R, "least(p_real,p_original)", "'GEN_FIRST_REAL_ORIGINAL'"), ("p_real>=0.55e0", _U, "mc", "'GEN_FIRST_UNCERTAIN_MANIP'"),
                end=(_U, "gc", "'GEN_FIRST_UNCERTAIN_GEN'")),
    "C": _cases(("gc<0.55e0 or mc<0.55e0", _U, "wk", "'MANIP_PRIORITY_LOW_CONF'"), ("p_real>=0.55e0 and p_original>=0.55e0", _R, "least(p_real,p_original)", "'MANIP_PRIORITY_REAL_ORIGINAL'"),
                ("p_real>=0.55e0 and p_manipulated>=0.55e0", _M, "p_manipulated", "'MANIP_PRIORITY_AI_MANIPULATED_ISOLATED'"),
                ("p_generated>=0.55e0 and p_manipulated>=0.55e0", _M, "p_manipulated", "'MANIP_PRIORITY_AI_MANIPULATED_CONFLICT'"),
                ("p_generated>=0.55e0 and p_original>=0.55e0", _G, "p_generated", "'MANIP_PRIORITY_AI_GENERATED'"), end=(_U, "0e0", "'MANIP_PRIORITY_FALLBACK'")),
    "D": _cases(("gc<0.55e0 or mc<0.55e0", _U, "wk", "'MARGIN_LOW_CONF'"), ("p_real>=0.55e0 and p_original>=0.55e0", _R, "least(p_real,p_original)", "'MARGIN_REAL_ORIGINAL'"),
                ("p_generated>=0.55e0 and p_original>=0.55e0", _G, "p_generated", "'MARGIN_AI_GENERATED_PURE'"), ("p_real>=0.55e0 and p_manipulated>=0.55e0", _M, "p_manipulated", "'MARGIN_AI_MANIPULATED_PURE'"),
                ("p_manipulated-p_generated>0.1e0", _M, "p_manipulated", "'MARGIN_AI_MANIP_DOMINANT'"), ("p_manipulated-p_generated<-0.1e0", _G, "p_generated", "'MARGIN_AI_GEN_DOMINANT'"),
                end=(_U, "least(p_generated,p_manipulated)", "'MARGIN_COMPETING_AMBIGUITY'")),
}


@query("G5", W("branches", b=_B) + _STRATEGY_SQL["A"])
def strategy_a_current_rule(spark, d):
    return _decision_query(rules.current_rule)(spark, d)


@query("G6", W("branches", b=_B) + _STRATEGY_SQL["B"])
def strategy_b_generation_first(spark, d):
    return _decision_query(rules.generation_first)(spark, d)


@query("G7", W("branches", b=_B) + _STRATEGY_SQL["C"])
def strategy_c_manipulation_priority(spark, d):
    return _decision_query(rules.manipulation_priority)(spark, d)


@query("G8", W("branches", b=_B) + _STRATEGY_SQL["D"])
def strategy_d_margin(spark, d):
    return _decision_query(rules.margin_rule)(spark, d)


def _logit_sql(i, g, m):
    w, b = rules.FUSION_WEIGHTS[i], rules.FUSION_BIASES[i]
    return f"({g}*({w[0]!r}e0)+{m}*({w[1]!r}e0)+({b!r}e0))"


def fusion_sql(source, g="p_generated", m="p_manipulated"):
    return {
        "z": f"select *, {_logit_sql(0, g, m)} as z0, {_logit_sql(1, g, m)} as z1, {_logit_sql(2, g, m)} as z2 from {source}",
        "e": "select *, exp(z0-greatest(z0,z1,z2)) as e0, exp(z1-greatest(z0,z1,z2)) as e1, exp(z2-greatest(z0,z1,z2)) as e2 from z",
        "q": f"select *, e0/(e0+e1+e2) as q0, e1/(e0+e1+e2) as q1, e2/(e0+e1+e2) as q2, greatest(e0,e1,e2)/(e0+e1+e2) as best, case when e0>=e1 and e0>=e2 then {_R} when e1>=e2 then {_G} else {_M} end as top from e",
    }


@query("G9", W("branches", **fusion_sql("branches")) + f"""select sample_id, {rnd('q0')} as q_real, {rnd('q1')} as q_generated, {rnd('q2')} as q_manipulated,
 case when best<0.5 then {_U} else top end as label from q""")
def strategy_e_fusion(spark, d):
    out = rules.fusion_decision(rules.with_fusion(V.branches(spark, d), prefix="q"), rules.Scores.of())
    return out.select("sample_id", rounded("q_p0").alias("q_real"), rounded("q_p1").alias("q_generated"), rounded("q_p2").alias("q_manipulated"), "decision.label")


@query("G10", W("branches", k="select truth as label, count(*) as n, avg(p_generated) as g, avg(p_manipulated) as m from branches group by 1")
       + f"""select label, n, {rnd('1e0/(select count(*) from k)')} as model_share, {rnd('g/(select count(*) from k)', 8)} as model_generated, {rnd('m/(select count(*) from k)', 8)} as model_manipulated, true as settled from k""")
def strategy_e_training(spark, d):
    """The fusion model fitted on the derived scores, with its certificate: per label the class-weighted means under the fitted probabilities, which at the
    minimum, and nowhere else, are those of the label's own rows."""
    rows = V.branches(spark, d)
    c = cal.fusion_certificate(rows, "truth", cal.fit_fusion(rows, "truth"))
    return c.select("label", "n", rounded("model_share").alias("model_share"), rounded("model_p_generated", 8).alias("model_generated"), rounded("model_p_manipulated", 8).alias("model_manipulated"), (F.col("residual") < 1e-9).alias("settled"))


_ENGINE = {
    "s": "select *, greatest(p_spatial,p_frequency,p_hybrid)-least(p_spatial,p_frequency,p_hybrid) as spread from q",
    "o": f"""select sample_id, truth, case
 when domain_risk='HIGH' then 'high' when domain_risk='LOW' and p_spatial>=0.75e0 and p_frequency>=0.75e0 then 'strong_ai'
 when domain_risk='LOW' and p_spatial<0.4e0 and p_frequency<0.6e0 and p_hybrid<0.2e0 and p_original>=0.85e0 then 'strong_real'
 when domain_risk='LOW' and spread>=0.45e0 then 'disagree' when domain_risk='MEDIUM' and (spread>=0.3e0 or best<0.65e0) then 'medium' when best<0.5e0 then 'floor' else 'fused' end as step,
 best, top, p_spatial, p_frequency, p_original, spread, domain_risk_score from s""",
    "v": f"""select sample_id, truth, case step when 'strong_ai' then {_G} when 'strong_real' then {_R} when 'fused' then top else {_U} end as label,
 round_even(case step when 'high' then domain_risk_score when 'strong_ai' then case when top={_G} then best else greatest(p_spatial,p_frequency) end when 'strong_real' then p_original when 'disagree' then spread else best end,4)+0e0 as confidence,
 case step when 'high' then 'domain_risk_abstention' when 'strong_ai' then case when top={_G} then 'strategy_e_calibration' else 'generation_consensus_override' end when 'strong_real' then 'genuine_photograph_consensus'
 when 'disagree' then 'high_disagreement_abstention' when 'medium' then 'moderate_disagreement_abstention' else 'strategy_e_calibration' end as decision_source,
 case step when 'high' then 'OUT_OF_DOMAIN' when 'strong_ai' then 'STRONG_AI' when 'strong_real' then 'STRONG_REAL' else 'CONFLICT' end as consensus_state from o""",
}


def engine_rows(spark, d):
    b = rules.with_domain_risk(V.branches(spark, d))
    return rules.reliability_decision(b, rules.Scores.of(), rules.Evidence.of()).select("sample_id", "truth", "decision.*")


@query("G11", W("branches", **DOMAIN_SQL, **fusion_sql("domains", "p_frequency"), **_ENGINE, x="""select sample_id, best as fusion_confidence, domain_risk, domain_risk_score,
 case when domain_risk='HIGH' or spread>=0.45e0 then 'LOW' when domain_risk='MEDIUM' or spread>=0.3e0 then 'MODERATE' else 'RELIABLE' end as reliability_state from s""")
       + f"select sample_id, label, confidence, decision_source, consensus_state, {rnd('fusion_confidence')} as fusion_confidence, reliability_state, domain_risk, {rnd('domain_risk_score')} as domain_risk_score, true as shares_agree from v join x using (sample_id)")
def reliability_aware_decisions(spark, d):
    """The engine's verdict with the fusion, reliability and domain fields beside it; the fused probabilities add up to one and their largest is the fusion confidence."""
    v = F.map_values("fusion_probabilities")
    agree = (F.abs(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) - 1.0) < 1e-9) & (F.abs(F.array_max(v) - F.col("fusion_confidence")) < 1e-12)
    return engine_rows(spark, d).select("sample_id", "label", rounded("confidence").alias("confidence"), "decision_source", "consensus_state", rounded("fusion_confidence").alias("fusion_confidence"),
                                        "reliability_state", "domain_risk", rounded("domain_risk_score").alias("domain_risk_score"), agree.alias("shares_agree"))


@query("G11, K4", W("branches", **fusion_sql("branches")) + f"select sample_id, case when best<0.5 then {_U} else top end as label, 'V2_CALIBRATED_'||case when best<0.5 then {_U} else top end as decision_case from q")
def calibrated_without_evidence(spark, d):
    """The calibrated engine chosen by name; without auxiliary streams the fusion model alone decides."""
    return rules.decide(V.branches(spark, d), " Strategy_E ", rules.Scores.of()).select("sample_id", "decision.label", "decision.decision_case")


@query("B13, G5", W("branches", c=f"""select *, case cast(floor({uq("'bad:'||sample_id")}*10) as integer) when 0 then null when 1 then 'nan'::double when 2 then 1.5e0 when 3 then p_real+0.1e0 when 4 then 'inf'::double else p_real end as a from branches""",
       v="select *, a is null or isnan(a) or isinf(a) or a<0 or a>1 or abs(a+p_generated-1e0)>0.02e0 as bad from c") + "select bad as invalid, count(*) as n from v group by 1")
def invalid_inputs_abstain(spark, d):
    """Half of the rows are given a broken probability pair; exactly those come out as CASE_4_INVALID."""
    k = F.floor(V.u("bad", "sample_id") * 10)
    a = (F.when(k == 0, F.lit(None).cast("double")).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(1.5)).when(k == 3, F.col("p_real") + 0.1).when(k == 4, F.lit(float("inf"))).otherwise(F.col("p_real")))
    b = V.branches(spark, d).withColumn("p_real", a)
    return decided(b, "_d", rules.baseline_engine(rules.Scores.of())).groupBy((F.col("decision_case") == "CASE_4_INVALID").alias("invalid")).agg(F.count("*").alias("n"))


@query("G12", W("branches", **DOMAIN_SQL, s="select *, greatest(p_spatial,p_frequency,p_hybrid)-least(p_spatial,p_frequency,p_hybrid) as spread from domains") + f"""select sample_id, {rnd('spread')} as generation_disagreement, {rnd('abs(p_spatial-p_frequency)')} as spatial_frequency_disagreement,
 {rnd('greatest(abs(p_hybrid-p_spatial),abs(p_hybrid-p_frequency))')} as hybrid_disagreement, case when domain_risk='HIGH' or spread>=0.45e0 then 'LOW' when domain_risk='MEDIUM' or spread>=0.3e0 then 'MODERATE' else 'RELIABLE' end as reliability_state from s""")
def disagreement_metrics(spark, d):
    b = rules.with_domain_risk(V.branches(spark, d))
    m = rules.disagreement(rules.Evidence.of())
    return reported(b.select("sample_id", *[c.alias(n) for n, c in m.items()]))


@query("G13", W("branches", **fusion_sql("branches"), p=f"""select sample_id, case when {uq("'primary:'||sample_id")}<0.8e0 then 'primary' else 'fallback' end as primary_source, case when best<0.5 then {_U} else top end as fused,
 case when {uq("'primary:'||sample_id")}<0.8e0 then p_frequency else p_hybrid end as p from q""", r="select *, case when p>=0.5 then 'AI-GENERATED' else 'REAL' end as verdict from p")
       + f"""select primary_source, verdict as primary_verdict, case when (verdict='REAL' and fused={_R}) or (verdict='AI-GENERATED' and fused in ({_G},{_M})) then 'CONSISTENT' else 'CONFLICTING' end as status, count(*) as n from r group by 1,2,3""")
def primary_cross_check(spark, d):
    """Primary verdict (missing for a fifth of the rows, then the fallback's) checked against the fused label."""
    b = V.branches(spark, d).withColumn("primary", F.when(V.u("primary", "sample_id") < 0.8, F.col("p_frequency")))
    pick = rules.primary_pick("primary", "p_hybrid")
    out = rules.fusion_decision(b, rules.Scores.of()).select(pick["primary_source"].alias("primary_source"), pick["primary_verdict"].alias("primary_verdict"), F.col("decision.label").alias("fused"))
    return out.groupBy("primary_source", "primary_verdict", rules.cross_check(F.col("primary_verdict"), F.col("fused")).alias("status")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- verdict metrics

_CLS = ("REAL_ORIGINAL", "AI_GENERATED", "AI_MANIPULATED")


def verdict_sql(source, keys):
    """Confusion by class from (keys, truth, label) rows."""
    def cnt(t, v):
        return f"count(*) filter (where truth='{t}' and label='{v}')"
    parts = {}
    for t in _CLS:
        s = t.lower()
        tp, pr, n = cnt(t, t), f"count(*) filter (where label='{t}')", f"count(*) filter (where truth='{t}')"
        parts[f"precision_{s}"] = f"coalesce({tp}/nullif({pr},0),0)"
        parts[f"recall_{s}"] = f"coalesce({tp}/nullif({n},0),0)"
        parts[f"f1_{s}"] = f"coalesce(2e0*{tp}/nullif({pr}+{n},0),0)"
    sel = ", ".join(f"{rnd(x)} as {n}" for n, x in parts.items())
    macro = ", ".join(rnd("(" + "+".join(parts[f"{k}_{t.lower()}"] for t in _CLS) + ")/3e0") + f" as macro_{k}" for k in ("precision", "recall", "f1"))
    return f"select {keys}, {rnd('avg((truth=label)::integer)')} as accuracy, {sel}, {macro}, {rnd('avg((label=' + _U + ')::integer)')} as uncertain_rate from {source} group by {keys}"


_ALL = " union all ".join(f"select '{k}' as strategy, b.truth, x.label from ({s}) x join branches b using (sample_id)" for k, s in _STRATEGY_SQL.items())
_STRATEGIES = {"A": rules.current_rule, "B": rules.generation_first, "C": rules.manipulation_priority, "D": rules.margin_rule}


@query("H3", W("branches", b=_B, a=_ALL) + verdict_sql("a", "strategy"))
def strategy_comparison(spark, d):
    """Three classes by four verdicts for every strategy; all strategies are evaluated in one scan."""
    s = rules.Scores.of()
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), r(s)["label"].alias("verdict")) for k, r in _STRATEGIES.items()]))
    long = V.branches(spark, d).select("truth", rows.alias("r")).select("truth", "r.strategy", "r.verdict")
    return reported(mt.verdict_rates(mt.verdict_confusion(long, ["strategy"])))


@query("H3, H40", W("branches", **DOMAIN_SQL, **fusion_sql("domains", "p_frequency"), **_ENGINE) + "select truth, label as verdict, count(*) as n from v group by 1,2")
def verdict_confusion_counts(spark, d):
    return engine_rows(spark, d).groupBy("truth", F.col("label").alias("verdict")).agg(F.count("*").alias("n"))


@query("H40", W("branches", **DOMAIN_SQL, **fusion_sql("domains", "p_frequency"), **_ENGINE) + f"select label as verdict, count(*) as n, {rnd('avg(confidence)')} as mean_confidence, {rnd('min(confidence)')} as lowest, {rnd('max(confidence)')} as highest from v group by 1")
def unlabelled_profile(spark, d):
    """Verdict counts and confidences of a set whose truth is not used."""
    return reported(engine_rows(spark, d).groupBy(F.col("label").alias("verdict")).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("lowest"), F.max("confidence").alias("highest")))


GRID = (0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90)


def _grid_sql():
    g = ", ".join(f"({t}e0)" for t in GRID)
    c = f"""case when greatest(p_real,p_generated)<tg or greatest(p_original,p_manipulated)<tm then {_U} when p_real>=tg and p_original>=tm then {_R} when p_real>=tg and p_manipulated>=tm then {_M}
 when p_generated>=tg and p_manipulated>=tm then {_M} when p_generated>=tg and p_original>=tm then {_G} else {_U} end"""
    dd = f"""case when greatest(p_real,p_generated)<tg or greatest(p_original,p_manipulated)<tm then {_U} when p_real>=tg and p_original>=tm then {_R} when p_generated>=tg and p_original>=tm then {_G}
 when p_real>=tg and p_manipulated>=tm then {_M} when p_manipulated-p_generated>0.1e0 then {_M} when p_manipulated-p_generated<-0.1e0 then {_G} else {_U} end"""
    return W("branches", x=f"select truth, tg, tm, 'C' as strategy, {c} as label from branches, (values {g}) a(tg), (values {g}) b(tm) union all select truth, tg, tm, 'D', {dd} from branches, (values {g}) a(tg), (values {g}) b(tm)",
             r=verdict_sql("x", "strategy, tg, tm")) + "select strategy, tg as th_gen, tm as th_manip, accuracy, macro_f1, recall_real_original, recall_ai_generated, recall_ai_manipulated, uncertain_rate from r"


@query("H13", _grid_sql())
def threshold_grid(spark, d):
    """Strategies C and D over a 10 x 10 threshold grid.

    A threshold test on a score depends only on how many grid values it reaches, so samples are first counted
    into cells (four such counts, the sign of the margin, truth); the grid is multiplied out over cells.
    """
    idx = lambda c: mt.level_index(F.col(c), GRID)
    lead = F.col("p_manipulated") - F.col("p_generated")
    cells = V.branches(spark, d).groupBy(
        "truth", *[idx(c).alias(c) for c in ("p_real", "p_generated", "p_original", "p_manipulated")],
        F.when(lead > 0.10, 1).when(lead < -0.10, -1).otherwise(0).alias("lead")).agg(F.count("*").alias("n"))
    # In index space a score of rank i passes threshold number k (from 1) when i >= k.
    s = rules.Scores.of()
    grid = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("kg"), F.lit(j + 1).alias("km"), F.lit(a).alias("th_gen"), F.lit(b).alias("th_manip")) for i, a in enumerate(GRID) for j, b in enumerate(GRID)]))
    g = cells.withColumn("g", grid).select("*", "g.*").drop("g")
    k = (F.col("kg"), F.col("km"))
    verdicts = F.explode(F.array(
        F.struct(F.lit("C").alias("strategy"), rules.manipulation_priority(s, *k)["label"].alias("verdict")),
        F.struct(F.lit("D").alias("strategy"), rules.margin_rule(s, *k, margin=0.5, lead=F.col("lead"))["label"].alias("verdict"))))
    long = g.select("truth", "n", "th_gen", "th_manip", verdicts.alias("v")).select("truth", "n", "th_gen", "th_manip", "v.strategy", "v.verdict")
    keys = ["strategy", "th_gen", "th_manip"]
    r = mt.verdict_rates(mt.verdict_table(long.groupBy(*keys, "truth", "verdict").agg(F.sum("n").alias("n")), keys, "truth", "verdict", "n"))
    return reported(r.select(*keys, "accuracy", "macro_f1", "recall_real_original", "recall_ai_generated", "recall_ai_manipulated", "uncertain_rate"), "th_gen", "th_manip")


@query("H25", W("branches") + """select case when p_generated<0.5 and p_manipulated<0.5 then 'A' when p_generated>=0.5 and p_manipulated<0.5 then 'B' when p_generated<0.5 then 'C' else 'D' end as region,
 count(*) filter (where truth='REAL_ORIGINAL') as n_real_original, count(*) filter (where truth='AI_GENERATED') as n_ai_generated, count(*) filter (where truth='AI_MANIPULATED') as n_ai_manipulated from branches group by 1""")
def region_by_truth(spark, d):
    s = rules.Scores.of()
    region = F.when(~s.says_generated & ~s.says_manipulated, "A").when(s.says_generated & ~s.says_manipulated, "B").when(~s.says_generated, "C").otherwise("D")
    return V.branches(spark, d).groupBy(region.alias("region")).agg(*[F.count_if(F.col("truth") == t).alias(f"n_{t.lower()}") for t in mt.TRUTHS])


@query("H26", W("branches") + f"select sample_id, truth, p_generated, p_manipulated, {rnd('p_manipulated-p_generated')} as delta from branches where p_generated>=0.55e0 and p_manipulated>=0.55e0")
def conflict_region(spark, d):
    b = V.branches(spark, d).where((F.col("p_generated") >= 0.55) & (F.col("p_manipulated") >= 0.55))
    return b.select("sample_id", "truth", "p_generated", "p_manipulated", rounded(F.col("p_manipulated") - F.col("p_generated")).alias("delta"))


@query("H27, C13", W("branches", b=_B, x=_STRATEGY_SQL["A"], p=f"""select m.generator, o1.label={_R} as o_ok, m1.label={_M} as m_ok from branches o join branches m on o.pair_id=m.pair_id and o.gt=0 and m.gt=1
 join x o1 on o1.sample_id=o.sample_id join x m1 on m1.sample_id=m.sample_id""") + f"""select case when o_ok and m_ok then 'BOTH_CORRECT' when o_ok then 'ORIGINAL_ONLY' when m_ok then 'MANIPULATED_ONLY' else 'BOTH_INCORRECT' end as outcome,
 count(*) as n, {rnd('count(*)/sum(count(*)) over ()')} as share from p group by 1""")
def pair_outcomes(spark, d):
    """Original and variant of each pair judged together: both right, one right, none."""
    from pyspark.sql import Window
    b = decided(V.branches(spark, d), "_d", rules.current_rule(rules.Scores.of()))
    o = b.where("gt = 0").select("pair_id", (F.col("label") == rules.REAL).alias("o_ok"))
    m = b.where("gt = 1").select("pair_id", (F.col("label") == rules.MANIPULATED).alias("m_ok"))
    oo, mm = F.col("o_ok"), F.col("m_ok")
    outcome = F.when(oo & mm, "BOTH_CORRECT").when(oo, "ORIGINAL_ONLY").when(mm, "MANIPULATED_ONLY").otherwise("BOTH_INCORRECT")
    g = o.join(m, "pair_id").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
    return reported(g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())))


# --------------------------------------------------------------------------- calibration

FROZEN_T, FROZEN_A, FROZEN_B = 2.1983866642849734, 0.454958, 0.076990
_CLIP = "least(greatest(score,1e-7),1e0-1e-7)"


@query("G3", W("pred", s=f"select sample_id, model, score, ln({_CLIP}/(1e0-{_CLIP})) as s from pred where model='D'")
       + f"select sample_id, score as raw, {rnd(f'1e0/(1e0+exp(-s/{FROZEN_T}e0))')} as temperature, {rnd(f'1e0/(1e0+exp(-({FROZEN_A}e0*s+{FROZEN_B}e0)))')} as platt from s")
def apply_calibrations(spark, d):
    p = V.pred(spark, d).where("model = 'D'")
    return p.select("sample_id", cal.apply_calibration("score", None).alias("raw"), rounded(cal.apply_calibration("score", cal.Calibration("temperature", T=FROZEN_T))).alias("temperature"),
                    rounded(cal.apply_calibration("score", cal.Calibration("platt", A=FROZEN_A, B=FROZEN_B))).alias("platt"))


def _fit_half(spark, d):
    p = V.pred(spark, d).where("model = 'D'").select("sample_id", "y", "score")
    return calibration_half(p).withColumn("s", logit("score"))


_HALVES = {"dd": "select sample_id, y, score from pred where model='D'", "r": _ranked("dd", "y", "half", "sample_id"),
           "h": f"select *, ln({_CLIP}/(1e0-{_CLIP})) as s, rank<=floor(n_group*0.5e0) as in_fit from r", "f": "select s, y, count(*)::double as w from h where in_fit group by 1,2"}


def _narrow(level, previous, width, name):
    """One level of a grid search on 1/T: 201 points around the best of the level before."""
    centre = f"(select b from {previous})"
    return {f"{name}g": f"select {centre} + (range-100)*{width:.8f}::double/100 as b from range(201)",
            name: f"select b from (select b, sum(w*(ln(1e0+exp(-abs(b*s)))+greatest(b*s,0e0)-y*b*s)) as loss from f, {name}g where b between 0.1e0 and 100e0 group by b) order by loss limit 1"}


@query("G1", W("pred", **_HALVES, s0="select 2e0 as b", **_narrow(1, "s0", 1.9, "s1"), **_narrow(2, "s1", 0.04, "s2"), **_narrow(3, "s2", 0.001, "s3"), **_narrow(4, "s3", 0.00002, "s4"))
       + f"select (select count(*) from h where in_fit) as n_fit, {rnd('1e0/(select b from s4)', 3)} as temperature")
def temperature_fit(spark, d):
    """Temperature fitted on one half of the data; the check finds the same minimum by grid search."""
    half = _fit_half(spark, d).where("half = 'fit'")
    c = cal.fit_temperature(half)
    return half.agg(F.count("*").alias("n_fit")).select("n_fit", rounded(F.lit(c.T), 3).alias("temperature"))


def _narrow2(previous, width, name):
    ca, cb = f"(select a from {previous})", f"(select b from {previous})"
    loss = "sum(w*(ln(1e0+exp(-abs(a*s+b)))+greatest(a*s+b,0e0)-y*(a*s+b)))/(select sum(w) from f)+1e-5*(a*a+b*b)"
    return {f"{name}g": f"select {ca}+(i.range-10)*{width}e0/10 as a, {cb}+(j.range-10)*{width}e0/10 as b from range(21) i, range(21) j",
            name: f"select a, b from (select a, b, {loss} as loss from f, {name}g where a>=1e-4 group by a,b) order by loss limit 1"}


_PLATT_LEVELS = {}
for _i, _w in enumerate((4.0, 1.2, 0.36, 0.12, 0.04, 0.012, 0.004, 0.0012, 0.0004)):
    _PLATT_LEVELS.update(_narrow2(f"t{_i}", _w, f"t{_i + 1}"))


@query("G2", W("pred", **_HALVES, t0="select 2e0 as a, 0e0 as b", **_PLATT_LEVELS) + f"select {rnd('(select a from t9)', 2)} as slope, {rnd('(select b from t9)', 2)} as intercept")
def platt_fit(spark, d):
    c = cal.fit_platt(_fit_half(spark, d).where("half = 'fit'"))
    return spark.range(1).select(rounded(F.lit(c.A), 2).alias("slope"), rounded(F.lit(c.B), 2).alias("intercept"))


METHODS = {"raw": cal.Calibration("raw"), "temperature": cal.Calibration("temperature", T=FROZEN_T), "platt": cal.Calibration("platt", A=FROZEN_A, B=FROZEN_B)}
_METHOD_SQL = (f"select 'raw' as method, y, score from h where not in_fit union all select 'temperature', y, round(1e0/(1e0+exp(-s/{FROZEN_T}e0)),12) from h where not in_fit "
               f"union all select 'platt', y, round(1e0/(1e0+exp(-({FROZEN_A}e0*s+{FROZEN_B}e0))),12) from h where not in_fit")
_Q7 = "least(greatest(score,1e-7),1e0-1e-7)"


@query("G4", W("pred", **_HALVES, x=_METHOD_SQL, **bins_sql("x", "method", "greatest(score,1e0-score)"), e="select method, sum(n*abs(bin_accuracy-bin_confidence))/sum(n) as ece, max(abs(bin_accuracy-bin_confidence)) as mce from filled group by 1",
               **sql_points("x", "method"), l="select *, lag(tp,1,0) over (partition by method order by score desc) as tp0, lag(fp,1,0) over (partition by method order by score desc) as fp0 from pts",
               a="select method, sum((fp-fp0)::double/nn*(tp+tp0)::double/np/2) as auroc from l group by 1",
               k=f"select method, -avg(y*ln({_Q7})+(1-y)*ln(1e0-{_Q7})) as nll, avg((score-y)*(score-y)) as brier, avg(((score>=0.5)::integer=y)::integer) as accuracy from x group by 1")
       + f"select method, {rnd('nll')} as nll, {rnd('brier')} as brier, {rnd('ece')} as ece, {rnd('mce')} as mce, {rnd('accuracy')} as accuracy, {rnd('auroc')} as auroc, row_number() over (order by nll, method)=1 as picked from k join e using (method) join a using (method)")
def calibration_comparison(spark, d):
    """Raw, temperature and Platt scores on the held-out half; the lowest NLL is picked."""
    half = _fit_half(spark, d).where("half = 'eval'")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), (F.col("score") if n == "raw" else F.round(cal.apply_calibration("score", c), 12)).alias("score")) for n, c in METHODS.items()]))
    x = half.select("y", rows.alias("m")).select("y", "m.method", "m.score").withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    k = ["method"]
    j = (mt.proper_scores(x, k, eps=1e-7).join(mt.calibration_error(mt.reliability_bins(x, k, bin_on="confidence"), k), k)
         .join(mt.binary_metrics(x, k, names=("accuracy",)).select("method", "accuracy"), k)
         .join(curve_metrics(curve_points(score_histogram(x, k), k), k).select("method", "auroc"), k))
    ranked = mt.rank_within(j, [], F.col("nll"), F.col("method"))
    return reported(ranked.select("method", "nll", "brier", "ece", "mce", "accuracy", "auroc", (F.col("rank") == 1).alias("picked")))


# --------------------------------------------------------------------------- scoring surface

SCORER_WEIGHTS = [round(((i * 37) % 19 - 9) / 10.0, 1) for i in range(64)]


@query("K5", "WITH s as (select vec_id as sample_id, 1e0/(1e0+exp(-(" + "+".join(f"embedding[{i + 1}]::double*({w}e0)" for i, w in enumerate(SCORER_WEIGHTS)) + "))) as p from embeddings) "
       "select sample_id, 'linear' as model, " + rnd("p", 6) + " as score, cast(p>=0.5 as integer) as pred from s")
def batch_scoring(spark, d):
    """A user's scorer applied to feature arrays in Arrow batches, giving prediction rows."""
    p = score_batches(table(spark, d, "embeddings"), "vec_id", "embedding", "linear", linear_scorer(SCORER_WEIGHTS))
    return p.select("sample_id", "model", rounded("score", 6).alias("score"), "pred")
