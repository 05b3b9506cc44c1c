"""Decision rules against known cases: score tuples and the verdict they must give."""

import math

import pytest

from plumbline.operators import rules

COLUMNS = "id int, p_real double, p_generated double, p_original double, p_manipulated double"


def verdicts(spark, rows, strategy):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS)
    out = rules.decide(df, strategy, rules.Scores.of()).select("id", "decision.*").orderBy("id").collect()
    return [(r.label, r.decision_case, r.confidence) for r in out]


def test_baseline_cases(spark):
    rows = [
        (0.05, 0.95, 0.70, 0.30), (0.02, 0.98, 0.20, 0.80), (0.92, 0.08, 0.88, 0.12), (0.89, 0.11, 0.08, 0.92),
        (0.48, 0.52, 0.10, 0.90), (0.90, 0.10, 0.47, 0.53), (0.35, 0.65, 0.92, 0.08), (0.20, 0.80, 0.19, 0.81)]
    want = [
        ("AI_GENERATED", "CASE_1_AI_GENERATED", 0.95), ("AI_GENERATED", "CASE_1_AI_GENERATED", 0.98),
        ("REAL_ORIGINAL", "CASE_2_REAL_ORIGINAL", 0.88), ("AI_MANIPULATED", "CASE_3_AI_MANIPULATED", 0.92),
        ("UNCERTAIN", "CASE_4_LOW_CONFIDENCE", 0.52), ("UNCERTAIN", "CASE_4_LOW_CONFIDENCE", 0.53),
        ("UNCERTAIN", "CASE_4_CONTRADICTORY", 0.65), ("UNCERTAIN", "CASE_4_CONTRADICTORY", 0.80)]
    assert verdicts(spark, rows, "baseline") == want


@pytest.mark.parametrize("strategy", ["v1_baseline", "calibrated"])
def test_invalid_inputs_abstain(spark, strategy):
    rows = [(None, 0.5, 0.8, 0.2), (0.7, 0.7, 0.8, 0.2), (-0.1, 1.1, 0.8, 0.2), (float("nan"), 0.5, 0.8, 0.2),
            (float("inf"), 0.5, 0.7, 0.3), (1.5, -0.5, 0.7, 0.3), (0.8, 0.2, None, None)]
    assert verdicts(spark, rows, strategy) == [("UNCERTAIN", "CASE_4_INVALID", 0.0)] * len(rows)


def test_calibrated_cases(spark):
    rows = [(0.95, 0.05, 0.92, 0.08), (0.02, 0.98, 0.95, 0.05), (0.95, 0.05, 0.05, 0.95), (0.15, 0.85, 0.10, 0.90)]
    got = verdicts(spark, rows, "strategy_e")
    assert [g[0] for g in got] == ["REAL_ORIGINAL", "AI_GENERATED", "AI_MANIPULATED", "AI_MANIPULATED"]
    assert got[3][1] == "V2_CALIBRATED_AI_MANIPULATED"


def test_fusion_probabilities_match_numpy(spark):
    import numpy as np
    rows = [(0, 1 - g / 7, g / 7, 1 - m / 7, m / 7) for g in range(8) for m in range(8)]
    df = rules.with_fusion(spark.createDataFrame(rows, COLUMNS))
    for r in df.collect():
        z = np.array(rules.FUSION_WEIGHTS) @ np.array([r.p_generated, r.p_manipulated]) + np.array(rules.FUSION_BIASES)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose([r.fused_p0, r.fused_p1, r.fused_p2], p, atol=1e-12)
        assert r.fused_label == rules.LABELS[int(p.argmax())]


EVIDENCE = "id int, p_real double, p_generated double, p_original double, p_manipulated double, p_spatial double, p_frequency double, p_hybrid double, domain_risk string, domain_risk_score double"


def test_reliability_hierarchy(spark):
    base = (0.9, 0.1, 0.9, 0.1)
    rows = [
        (0, *base, 0.9, 0.9, 0.9, "HIGH", 0.7),      # domain abstention comes before consensus
        (1, *base, 0.8, 0.8, 0.8, "LOW", 0.0),       # strong AI consensus
        (2, *base, 0.1, 0.1, 0.1, "LOW", 0.0),       # strong real consensus
        (3, *base, 0.9, 0.2, 0.3, "LOW", 0.0),       # streams disagree
        (4, *base, 0.7, 0.3, 0.3, "MEDIUM", 0.3),    # medium risk, moderate disagreement
        (5, *base, None, None, None, None, None),    # no evidence: fusion alone
        (6, *base, 0.5, 0.2, 0.3, "LOW", 0.0),       # moderate disagreement at low risk does not abstain
    ]
    df = spark.createDataFrame(rows, EVIDENCE)
    out = rules.reliability_decision(df, rules.Scores.of(), rules.Evidence.of()).orderBy("id").select("decision.*").collect()
    got = [(r.label, r.decision_source, r.consensus_state) for r in out]
    assert got[0] == ("UNCERTAIN", "domain_risk_abstention", "OUT_OF_DOMAIN") and out[0].confidence == 0.7
    assert got[1][0] == "AI_GENERATED" and got[1][2] == "STRONG_AI"
    assert got[2] == ("REAL_ORIGINAL", "genuine_photograph_consensus", "STRONG_REAL") and out[2].confidence == 0.9
    assert got[3] == ("UNCERTAIN", "high_disagreement_abstention", "CONFLICT") and out[3].confidence == 0.7
    assert got[4] == ("UNCERTAIN", "moderate_disagreement_abstention", "CONFLICT")
    assert got[5] == ("REAL_ORIGINAL", "strategy_e_calibration", "CONFLICT")
    assert got[6][1] == "strategy_e_calibration"


def test_strategy_names(spark):
    with pytest.raises(ValueError):
        rules.decide(spark.createDataFrame([(0, 0.1, 0.9, 0.1, 0.9)], COLUMNS), "majority", rules.Scores.of())
    assert set(rules.ENGINES) == {"baseline", "v1_baseline", "phase10_baseline", "calibrated", "v2_calibrated", "strategy_e"}


def test_fusion_model_checks_feature_order():
    with pytest.raises(ValueError, match="feature order"):
        rules.FusionModel(features=("p_manipulated", "p_generated"))
    with pytest.raises(ValueError):
        rules.FusionModel(weights=((1.0, 2.0),))


def test_domain_risk_levels(spark):
    rows = [(0.9, 300.0, 0.2, 0.95), (0.1, 5.0, 0.0, 0.1), (0.6, 120.0, 0.02, 0.7), (0.2, 0.0, 0.12, 0.5)]
    df = rules.with_domain_risk(spark.createDataFrame(rows, "paper_fraction double, text_glyphs double, line_energy double, mono_fraction double"))
    got = [(r.domain_risk, r.domain_type) for r in df.collect()]
    assert got[0] == ("HIGH", "DOCUMENT_LIKE") and got[1] == ("LOW", "NATURAL_PHOTO")
    assert got[2][0] == "MEDIUM" and got[3][0] == "LOW"


def test_decisions_run_on_a_stream(spark, tmp_path):
    src, schema = str(tmp_path / "in"), COLUMNS
    spark.createDataFrame([(0, 0.05, 0.95, 0.7, 0.3), (1, 0.92, 0.08, 0.88, 0.12)], schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    out = rules.decide(stream, "calibrated", rules.Scores.of()).select("id", "decision.label")
    q = out.writeStream.format("memory").queryName("verdicts").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.id, r.label) for r in spark.table("verdicts").collect()} == {(0, "AI_GENERATED"), (1, "REAL_ORIGINAL")}


def test_two_class_result(spark):
    r = rules.two_class_result("a", "b")
    row = spark.createDataFrame([(1.0, 3.0), (800.0, -800.0)], "a double, b double").select(*[c.alias(n) for n, c in r.items()]).collect()
    assert math.isclose(row[0].p_ai, 1 / (1 + math.exp(-2.0)), abs_tol=1e-12) and row[0].prediction == "AI-GENERATED"
    assert row[1].p_real == 1.0 and row[1].prediction == "REAL"
