"""Time catalogue queries: one JSON line with seconds per query and in total.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list or "all").
Every query is run to completion through the no-op sink after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.plans.catalog import load  # noqa: E402
from plumbline.session import get_session  # noqa: E402

HEADLINE = (
    "model_ranking", "binary_metrics_by_model", "roc_curve_points", "auroc_trapezoid", "tpr_at_fixed_fpr", "nll_and_brier", "reliability_table", "risk_coverage_table",
    "probability_summary", "generator_recall_matrix", "generator_against_real", "subgroup_metrics", "confidence_by_correctness",
    "agreement_distribution", "exclusive_error_groups", "wide_prediction_table", "top_confident_false_positives", "recompute_audit",
    "exact_decontamination", "deduplicate_by_priority", "leak_filter_waterfall", "clean_dataset_build", "near_duplicates_of_reference", "nearest_reference_within",
    "benchmark_containment", "cross_split_exact_overlap", "audited_sample", "stratified_split", "group_split", "order_line_join",
    "strategy_comparison", "reliability_aware_decisions", "threshold_grid", "view_set_fusion", "robustness_summary", "condition_shift_study",
    "bootstrap_intervals", "bootstrap_intervals_multinomial", "paired_bootstrap", "signed_rank_by_category", "temperature_fit", "platt_fit",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load()
    names = list(catalog) if chosen == "all" else (chosen.split(",") if chosen else list(HEADLINE))
    catalog["model_ranking"].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for n in names:
        start = time.perf_counter()
        catalog[n].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[n] = round(time.perf_counter() - start, 3)
        print(f"{n} {seconds[n]}", file=sys.stderr, flush=True)
    sf = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
