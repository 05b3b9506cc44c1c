"""Decision rules as ordered rule lists compiled to column expressions.

A rule list reads top to bottom: the first rule whose condition holds gives (label, confidence, case).
Everything is stateless, so the same columns work on batch and streaming frames.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import clip, col, half_even, ramp, softmax

REAL, GENERATED, MANIPULATED, UNCERTAIN = "REAL_ORIGINAL", "AI_GENERATED", "AI_MANIPULATED", "UNCERTAIN"
LABELS = (REAL, GENERATED, MANIPULATED)

# Thresholds of the baseline rule.
MIN_CONFIDENCE = 0.55
STRONG_ORIGINAL = 0.85
GENERATION_OVERRULES = 0.90
COMPETING_MARGIN = 0.05
COMPETING_FLOOR = 0.70

# Thresholds of the reliability-aware engine.
STRONG_AI_SPATIAL = 0.75
STRONG_AI_FREQUENCY = 0.75
STRONG_REAL_SPATIAL = 0.40
STRONG_REAL_FREQUENCY = 0.60
STRONG_REAL_HYBRID = 0.20
STRONG_REAL_ORIGINAL = 0.85
HIGH_DISAGREEMENT = 0.45
MODERATE_DISAGREEMENT = 0.30
DECISIVE_FUSION = 0.65
FUSION_FLOOR = 0.50

# Frozen fusion model, one row per label in LABELS order, features (generation, manipulation).
FUSION_WEIGHTS = (
    (-1.7879907846450807, -4.235018396377564),
    (4.0133381366729735, -5.3892566680908205),
    (-2.2253125667572022, 9.624278831481934),
)
FUSION_BIASES = (3.055479621887207, 0.35649876594543456, -3.411933946609497)

# Domain risk levels.
DOMAIN_HIGH = 0.50
DOMAIN_MEDIUM = 0.28


@dataclass(frozen=True)
class Rule:
    when: Column
    label: Column | str
    confidence: Column | float
    case: Column | str


def _text(v: Column | str) -> Column:
    return F.lit(v) if isinstance(v, str) else v


def _number(v: Column | float) -> Column:
    return (v if isinstance(v, Column) else F.lit(float(v))).cast("double")


def first_match(rules: Sequence[Rule], case_otherwise: str, digits: int = 4) -> Column:
    """Struct (label, confidence, decision_case) of the first rule that holds, else an abstention at 0.

    One CASE per field: a query that reads only the label evaluates only the label's.
    """
    def field(value: Callable[[Rule], Column], otherwise: Column) -> Column:
        chain = F.when(rules[0].when, value(rules[0]))
        for r in rules[1:]:
            chain = chain.when(r.when, value(r))
        return chain.otherwise(otherwise)
    return F.struct(
        field(lambda r: _text(r.label), F.lit(UNCERTAIN)).alias("label"),
        half_even(field(lambda r: _number(r.confidence), F.lit(0.0)), digits).alias("confidence"),
        field(lambda r: _text(r.case), F.lit(case_otherwise)).alias("decision_case"))


@dataclass(frozen=True)
class Scores:
    """The two detector outputs of a sample: generation (real / generated) and manipulation (original / manipulated)."""
    real: Column
    generated: Column
    original: Column
    manipulated: Column

    @classmethod
    def of(cls, real="p_real", generated="p_generated", original="p_original", manipulated="p_manipulated") -> Scores:
        return cls(col(real), col(generated), col(original), col(manipulated))

    @property
    def generation_confidence(self) -> Column:
        return F.greatest(self.real, self.generated)

    @property
    def manipulation_confidence(self) -> Column:
        return F.greatest(self.original, self.manipulated)

    @property
    def weakest(self) -> Column:
        return F.least(self.generation_confidence, self.manipulation_confidence)

    @property
    def says_generated(self) -> Column:
        return self.generated >= 0.50

    @property
    def says_manipulated(self) -> Column:
        return self.manipulated >= 0.50

    def rounded(self, digits: int = 4) -> Scores:
        return Scores(*[half_even(c, digits) for c in (self.real, self.generated, self.original, self.manipulated)])


# --------------------------------------------------------------------------- input validation

def pair_problem(first: str | Column, second: str | Column, tolerance: float = 0.02) -> Column:
    """NULL for a valid probability pair, otherwise the first problem found."""
    a, b = col(first), col(second)
    problem = None
    for name, c in (("first", a), ("second", b)):
        for bad, why in (
            (c.isNull(), "missing"),
            (F.isnan(c) | (F.abs(c) == float("inf")), "not finite"),
            ((c < 0.0) | (c > 1.0), "out of range"),
        ):
            text = F.lit(f"{name} {why}")
            problem = F.when(bad, text) if problem is None else problem.when(bad, text)
    return problem.when(F.abs(a + b - 1.0) > tolerance, F.lit("do not sum to 1"))


def invalid_input(s: Scores) -> Rule:
    """Invalid inputs keep their row and come out as an abstention. Goes first in a rule list."""
    bad = F.coalesce(pair_problem(s.real, s.generated), pair_problem(s.original, s.manipulated)).isNotNull()
    return Rule(bad, UNCERTAIN, 0.0, "CASE_4_INVALID")


# --------------------------------------------------------------------------- strategies A to D

def _baseline(s: Scores, raw: Scores, low: Sequence[Rule], strong_original: float, margin: float) -> Column:
    """The hierarchy on scores ``s``; which side a detector is on is read from the unrounded ``raw``."""
    generated, manipulated = raw.says_generated, raw.says_manipulated
    clash = generated & (s.original >= strong_original) & (s.generated < GENERATION_OVERRULES)
    rivals = (generated & manipulated & (F.abs(s.generated - s.manipulated) <= margin)
              & (s.generated >= COMPETING_FLOOR) & (s.manipulated >= COMPETING_FLOOR))
    return first_match([
        *low,
        Rule(clash | rivals, UNCERTAIN, s.weakest, "CASE_4_CONTRADICTORY"),
        Rule(generated, GENERATED, s.generated, "CASE_1_AI_GENERATED"),
        Rule(manipulated, MANIPULATED, s.manipulated, "CASE_3_AI_MANIPULATED"),
        Rule(~generated & ~manipulated, REAL, F.least(s.real, s.original), "CASE_2_REAL_ORIGINAL"),
    ], "CASE_4_FALLBACK")


def baseline_engine(s: Scores, min_confidence: float = MIN_CONFIDENCE, strong_original: float = STRONG_ORIGINAL,
                    margin: float = COMPETING_MARGIN) -> Column:
    """The hierarchical rule as served: an abstention for low confidence reports the detector tested first.

    Labels follow the unrounded scores, thresholds the scores rounded to four places.
    """
    r = s.rounded()
    low = [Rule(c < min_confidence, UNCERTAIN, c, "CASE_4_LOW_CONFIDENCE") for c in (r.generation_confidence, r.manipulation_confidence)]
    return _baseline(r, s, [invalid_input(s), *low], strong_original, margin)


def current_rule(s: Scores, min_confidence: float = MIN_CONFIDENCE, strong_original: float = STRONG_ORIGINAL,
                 margin: float = COMPETING_MARGIN) -> Column:
    """Strategy A: the same hierarchy, but low confidence reports the weaker of the two detectors."""
    low = [Rule(s.weakest < min_confidence, UNCERTAIN, s.weakest, "CASE_4_LOW_CONFIDENCE")]
    return _baseline(s, s, low, strong_original, margin)


def generation_first(s: Scores, th_gen: float | Column = 0.55, th_manip: float | Column = 0.55) -> Column:
    """Strategy B: the generation detector decides; manipulation is asked only about what it calls real."""
    real = s.real >= th_gen
    return first_match([
        Rule(s.generated >= th_gen, GENERATED, s.generated, "GEN_FIRST_AI_GENERATED"),
        Rule(real & (s.manipulated >= th_manip), MANIPULATED, s.manipulated, "GEN_FIRST_AI_MANIPULATED"),
        Rule(real & (s.original >= th_manip), REAL, F.least(s.real, s.original), "GEN_FIRST_REAL_ORIGINAL"),
        Rule(real, UNCERTAIN, s.manipulation_confidence, "GEN_FIRST_UNCERTAIN_MANIP"),
        Rule(F.lit(True), UNCERTAIN, s.generation_confidence, "GEN_FIRST_UNCERTAIN_GEN"),
    ], "GEN_FIRST_UNCERTAIN_GEN")


def _quadrants(s: Scores, th_gen, th_manip) -> dict[str, Column]:
    return {
        "low": (s.generation_confidence < th_gen) | (s.manipulation_confidence < th_manip),
        "clean": (s.real >= th_gen) & (s.original >= th_manip),
        "edited": (s.real >= th_gen) & (s.manipulated >= th_manip),
        "both": (s.generated >= th_gen) & (s.manipulated >= th_manip),
        "synthetic": (s.generated >= th_gen) & (s.original >= th_manip),
    }


def manipulation_priority(s: Scores, th_gen: float | Column = 0.55, th_manip: float | Column = 0.55) -> Column:
    """Strategy C: where both detectors fire, call it manipulated."""
    q = _quadrants(s, th_gen, th_manip)
    tag = "MANIP_PRIORITY_"
    return first_match([
        Rule(q["low"], UNCERTAIN, s.weakest, tag + "LOW_CONF"),
        Rule(q["clean"], REAL, F.least(s.real, s.original), tag + "REAL_ORIGINAL"),
        Rule(q["edited"], MANIPULATED, s.manipulated, tag + "AI_MANIPULATED_ISOLATED"),
        Rule(q["both"], MANIPULATED, s.manipulated, tag + "AI_MANIPULATED_CONFLICT"),
        Rule(q["synthetic"], GENERATED, s.generated, tag + "AI_GENERATED"),
    ], tag + "FALLBACK")


def margin_rule(s: Scores, th_gen: float | Column = 0.55, th_manip: float | Column = 0.55, margin: float = 0.10,
                lead: Column | None = None) -> Column:
    """Strategy D: where both detectors fire, the clearly stronger one wins and a near tie abstains.

    ``lead`` (manipulated minus generated) is given only where the scores are replaced by their ranks.
    """
    q = _quadrants(s, th_gen, th_manip)
    lead = s.manipulated - s.generated if lead is None else lead
    return first_match([
        Rule(q["low"], UNCERTAIN, s.weakest, "MARGIN_LOW_CONF"),
        Rule(q["clean"], REAL, F.least(s.real, s.original), "MARGIN_REAL_ORIGINAL"),
        Rule(q["synthetic"], GENERATED, s.generated, "MARGIN_AI_GENERATED_PURE"),
        Rule(q["edited"], MANIPULATED, s.manipulated, "MARGIN_AI_MANIPULATED_PURE"),
        Rule(q["both"] & (lead > margin), MANIPULATED, s.manipulated, "MARGIN_AI_MANIP_DOMINANT"),
        Rule(q["both"] & (lead < -margin), GENERATED, s.generated, "MARGIN_AI_GEN_DOMINANT"),
        Rule(q["both"], UNCERTAIN, F.least(s.generated, s.manipulated), "MARGIN_COMPETING_AMBIGUITY"),
    ], "MARGIN_FALLBACK")


# --------------------------------------------------------------------------- strategy E: fusion

@dataclass(frozen=True)
class FusionModel:
    """Softmax weights over (generation, manipulation) per label. Feature order is part of the model."""
    weights: tuple[tuple[float, float], ...] = FUSION_WEIGHTS
    biases: tuple[float, ...] = FUSION_BIASES
    labels: tuple[str, ...] = LABELS
    features: tuple[str, ...] = ("p_generated", "p_manipulated")
    floor: float = FUSION_FLOOR

    def __post_init__(self) -> None:
        if tuple(self.features) != ("p_generated", "p_manipulated"):
            raise ValueError(f"Invalid calibration feature order: {self.features}")
        if len(self.weights) != len(self.labels) or len(self.biases) != len(self.labels) or any(len(w) != 2 for w in self.weights):
            raise ValueError("one weight pair and one bias per label are needed")


def with_fusion(df: DataFrame, generated: str | Column = "p_generated", manipulated: str | Column = "p_manipulated",
                model: FusionModel = FusionModel(), prefix: str = "fused") -> DataFrame:
    """Add <prefix>_p0.. (one probability per label), <prefix>_label and <prefix>_confidence; the first label wins a tie.

    Built in steps, each a projection: as one expression the logits would be repeated in every branch above them.
    """
    n = range(len(model.labels))
    z, e, p = ([f"_{prefix}_{c}{i}" for i in n] for c in "zep")
    p = [f"{prefix}_p{i}" for i in n]
    g, m = col(generated), col(manipulated)
    out = df.withColumns({z[i]: g * F.lit(float(model.weights[i][0])) + m * F.lit(float(model.weights[i][1])) + F.lit(float(model.biases[i])) for i in n})
    out = out.withColumn(f"_{prefix}_top", F.greatest(*z))
    out = out.withColumns({e[i]: F.exp(F.col(z[i]) - F.col(f"_{prefix}_top")) for i in n})
    out = out.withColumn(f"_{prefix}_sum", sum([F.col(x) for x in e[1:]], F.col(e[0])))
    out = out.withColumns({p[i]: F.col(e[i]) / F.col(f"_{prefix}_sum") for i in n})
    out = out.withColumn(f"{prefix}_confidence", F.greatest(*p))
    label = F.when(F.col(p[0]) == F.col(f"{prefix}_confidence"), model.labels[0])
    for i in n[1:]:
        label = label.when(F.col(p[i]) == F.col(f"{prefix}_confidence"), model.labels[i])
    return out.withColumn(f"{prefix}_label", label).drop(*z, *e, f"_{prefix}_top", f"_{prefix}_sum")


def fusion_decision(df: DataFrame, s: Scores, model: FusionModel = FusionModel(), out: str = "decision") -> DataFrame:
    """Strategy E: the label the fusion model finds most probable, an abstention below its floor."""
    f = with_fusion(df, s.generated, s.manipulated, model, "_f")
    best, label = F.col("_f_confidence"), F.col("_f_label")
    rule = first_match([
        Rule(best < model.floor, UNCERTAIN, best, "LOGISTIC_LOW_PROB"),
        Rule(F.lit(True), label, best, F.concat(F.lit("LOGISTIC_"), label)),
    ], "LOGISTIC_LOW_PROB")
    return f.withColumn(out, rule).drop(*[c for c in f.columns if c.startswith("_f_")])


# --------------------------------------------------------------------------- reliability-aware engine

@dataclass(frozen=True)
class Evidence:
    """Auxiliary streams. ``available`` is false on rows where they are missing: fusion alone then decides."""
    spatial: Column
    frequency: Column
    hybrid: Column
    domain_risk: Column
    domain_score: Column
    available: Column

    @classmethod
    def of(cls, spatial="p_spatial", frequency="p_frequency", hybrid="p_hybrid", domain_risk="domain_risk",
           domain_score="domain_risk_score") -> Evidence:
        s, f, h = col(spatial), col(frequency), col(hybrid)
        return cls(s, f, h, F.coalesce(col(domain_risk), F.lit("LOW")), F.coalesce(col(domain_score), F.lit(0.0)),
                   s.isNotNull() & f.isNotNull() & h.isNotNull())


def disagreement(e: Evidence) -> dict[str, Column]:
    """Spread of the streams and the reliability state it implies; all zero and RELIABLE without evidence."""
    zero = lambda c: F.when(e.available, c).otherwise(F.lit(0.0))
    spread = zero(F.greatest(e.spatial, e.frequency, e.hybrid) - F.least(e.spatial, e.frequency, e.hybrid))
    state = (F.when(~e.available, "RELIABLE")
              .when((e.domain_risk == "HIGH") | (spread >= HIGH_DISAGREEMENT), "LOW")
              .when((e.domain_risk == "MEDIUM") | (spread >= MODERATE_DISAGREEMENT), "MODERATE").otherwise("RELIABLE"))
    return {
        "generation_disagreement": spread,
        "spatial_frequency_disagreement": zero(F.abs(e.spatial - e.frequency)),
        "hybrid_disagreement": zero(F.greatest(F.abs(e.hybrid - e.spatial), F.abs(e.hybrid - e.frequency))),
        "reliability_state": state,
    }


def reliability_decision(df: DataFrame, s: Scores, e: Evidence | None = None, model: FusionModel = FusionModel(), out: str = "decision") -> DataFrame:
    """Add a struct (label, confidence, decision_case, decision_source, consensus_state, fusion_confidence, fusion_probabilities,
    reliability_state, domain_risk, domain_risk_score). The fusion fields are NULL on invalid rows, the last two without evidence.

    Order with evidence: high domain risk abstains; at low risk strong consensus decides and strong
    disagreement abstains; at medium risk anything short of decisive abstains; then the fusion model.
    """
    r = s.rounded()
    generated = r.generated if e is None else F.when(e.available, e.frequency).otherwise(r.generated)
    staged = df.withColumns({"_g": generated, "_m": r.manipulated, "_o": r.original,
                             "_bad": F.coalesce(pair_problem(s.real, s.generated), pair_problem(s.original, s.manipulated)).isNotNull()})
    f = with_fusion(staged, "_g", "_m", model, "_f")
    label, best, original = F.col("_f_label"), F.col("_f_confidence"), F.col("_o")

    def outcome(lab, conf, source: Column | str, state: str) -> Column:
        lab = _text(lab)
        return F.struct(lab.alias("label"), half_even(_number(conf), 4).alias("confidence"),
                        F.concat(F.lit("V2_CALIBRATED_"), lab).alias("decision_case"),
                        _text(source).alias("decision_source"), F.lit(state).alias("consensus_state"))

    steps: list[tuple[Column, Column]] = []
    if e is not None:
        f = f.withColumn("_spread", F.greatest(e.spatial, e.frequency, e.hybrid) - F.least(e.spatial, e.frequency, e.hybrid))
        spread = F.col("_spread")
        low, medium = e.available & (e.domain_risk == "LOW"), e.available & (e.domain_risk == "MEDIUM")
        strong_ai = (e.spatial >= STRONG_AI_SPATIAL) & (e.frequency >= STRONG_AI_FREQUENCY)
        strong_real = ((e.spatial < STRONG_REAL_SPATIAL) & (e.frequency < STRONG_REAL_FREQUENCY)
                       & (e.hybrid < STRONG_REAL_HYBRID) & (original >= STRONG_REAL_ORIGINAL))
        agreed = label == GENERATED
        steps += [
            (e.available & (e.domain_risk == "HIGH"), outcome(UNCERTAIN, e.domain_score, "domain_risk_abstention", "OUT_OF_DOMAIN")),
            (low & strong_ai, outcome(
                GENERATED, F.when(agreed, best).otherwise(F.greatest(e.spatial, e.frequency)),
                F.when(agreed, "strategy_e_calibration").otherwise("generation_consensus_override"), "STRONG_AI")),
            (low & strong_real, outcome(REAL, original, "genuine_photograph_consensus", "STRONG_REAL")),
            (low & (spread >= HIGH_DISAGREEMENT), outcome(UNCERTAIN, spread, "high_disagreement_abstention", "CONFLICT")),
            (medium & ((spread >= MODERATE_DISAGREEMENT) | (best < DECISIVE_FUSION)),
             outcome(UNCERTAIN, best, "moderate_disagreement_abstention", "CONFLICT")),
        ]
    steps.append((best < model.floor, outcome(UNCERTAIN, best, "strategy_e_calibration", "CONFLICT")))
    chain = F.when(F.col("_bad"), F.struct(
        F.lit(UNCERTAIN).alias("label"), F.lit(0.0).alias("confidence"), F.lit("CASE_4_INVALID").alias("decision_case"),
        F.lit("validation").alias("decision_source"), F.lit("INVALID").alias("consensus_state")))
    for when, result in steps:
        chain = chain.when(when, result)
    sound = lambda c: F.when(~F.col("_bad"), c)
    shares = F.map_from_arrays(F.array(*[F.lit(v) for v in model.labels]), F.array(*[F.col(f"_f_p{i}") for i in range(len(model.labels))]))
    more = {"fusion_confidence": sound(best), "fusion_probabilities": sound(shares),
            "reliability_state": F.lit("RELIABLE") if e is None else disagreement(e)["reliability_state"],
            "domain_risk": F.lit(None).cast("string") if e is None else F.when(e.available, e.domain_risk),
            "domain_risk_score": F.lit(None).cast("double") if e is None else F.when(e.available, e.domain_score)}
    decided = f.withColumn("_c", chain.otherwise(outcome(label, best, "strategy_e_calibration", "CONFLICT")))
    decided = decided.withColumn(out, F.struct("_c.*", *[c.alias(k) for k, c in more.items()])).drop("_c")
    return decided.drop("_g", "_m", "_o", "_bad", "_spread", *[c for c in f.columns if c.startswith("_f_")])


def baseline_decision(df: DataFrame, s: Scores, out: str = "decision", **thresholds) -> DataFrame:
    return df.withColumn(out, baseline_engine(s, **thresholds))


# Accepted strategy names.
ENGINES: dict[str, Callable[..., DataFrame]] = {
    "baseline": baseline_decision, "v1_baseline": baseline_decision, "phase10_baseline": baseline_decision,
    "calibrated": reliability_decision, "v2_calibrated": reliability_decision, "strategy_e": reliability_decision,
}


def decide(df: DataFrame, strategy: str, scores: Scores, *args, **kwargs) -> DataFrame:
    """Add the decision struct of the engine chosen by name (case and outer blanks ignored)."""
    name = strategy.strip().lower()
    if name not in ENGINES:
        raise ValueError(f"Unknown decision strategy: {strategy!r}; one of {sorted(ENGINES)}")
    return ENGINES[name](df, scores, *args, **kwargs)


# --------------------------------------------------------------------------- domain risk, cross-check

def with_domain_risk(df: DataFrame, paper="paper_fraction", glyphs="text_glyphs", lines="line_energy", mono="mono_fraction") -> DataFrame:
    """Add risk score, level and type of an image domain from its four measured signals."""
    d = df.withColumns({"_paper": ramp(paper, 0.35, 0.25), "_glyphs": ramp(glyphs, 50.0, 150.0), "_lines": ramp(lines, 0.0, 0.12), "_mono": ramp(mono, 0.45, 0.40)})
    d = d.withColumn("_canvas", F.col("_paper") * F.col("_glyphs"))
    canvas, s_paper, s_lines, s_mono = (F.col(c) for c in ("_canvas", "_paper", "_lines", "_mono"))
    base = canvas * 0.40 + s_paper * s_mono * 0.25 + s_lines * 0.25 + s_mono * 0.10
    boost = F.when((canvas > 0.40) & (s_lines > 0.40), 1.30).when((s_lines > 0.70) & (s_mono > 0.70), 1.25).otherwise(1.0)
    d = d.withColumn("domain_risk_score", half_even(clip(base * boost, 0.0, 1.0), 4))
    score = F.col("domain_risk_score")
    level = F.when(score >= DOMAIN_HIGH, "HIGH").when(score >= DOMAIN_MEDIUM, "MEDIUM").otherwise("LOW")
    kind = (F.when((score >= DOMAIN_HIGH) & (s_lines > 0.60) & (col(mono) < 0.60), "SCREENSHOT_LIKE")
             .when(score >= DOMAIN_HIGH, "DOCUMENT_LIKE")
             .when((score >= DOMAIN_MEDIUM) & ((canvas > 0.25) | (s_paper > 0.35)), "DOCUMENT_LIKE")
             .when(score >= DOMAIN_MEDIUM, "UNKNOWN").otherwise("NATURAL_PHOTO"))
    return d.withColumns({"domain_risk": level, "domain_type": kind}).drop("_paper", "_glyphs", "_lines", "_mono", "_canvas")


def primary_pick(primary_p: str | Column, fallback_p: str | Column) -> dict[str, Column]:
    """The primary model's verdict, or the fallback model's where the primary gave none."""
    p = F.coalesce(col(primary_p), col(fallback_p))
    return {
        "primary_source": F.when(col(primary_p).isNotNull(), "primary").otherwise("fallback"),
        "primary_verdict": F.when(p >= 0.5, "AI-GENERATED").otherwise("REAL"),
        "primary_confidence": F.greatest(p, 1.0 - p),
    }


def cross_check(primary_verdict: Column, fused_label: Column) -> Column:
    same = (((primary_verdict == "REAL") & (fused_label == REAL))
            | ((primary_verdict == "AI-GENERATED") & fused_label.isin(GENERATED, MANIPULATED)))
    return F.when(same, "CONSISTENT").otherwise("CONFLICTING")


def two_class_result(z_real: str | Column, z_ai: str | Column) -> dict[str, Column]:
    """Softmax of two logits with the decision and its confidence."""
    real, ai = softmax(col(z_real), col(z_ai))
    return {
        "p_real": real, "p_ai": ai, "predicted_class": (ai >= 0.5).cast("int"),
        "prediction": F.when(ai >= 0.5, "AI-GENERATED").otherwise("REAL"),
        "confidence": F.when(ai >= 0.5, ai).otherwise(real),
    }
