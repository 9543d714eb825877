"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the local core count.  Each query's
first run is reported under ``first``: it compiles, and builds the shared sample tables where it is the
first to need them.  Later runs read those from the cache; ``queries`` has the median of ``BENCH_RUNS``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from strandmill.plans import catalog  # noqa: E402
from strandmill.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_recency_report", "j4_build_samples", "q15_exact_counts_from_log",
    "s6_last_prediction", "s9_diagnostic_log", "p5_sequence_alignment", "f5_rare_zeroing", "j1_item_lookup",
    "a1_robust_scaler", "a2_category_counts", "a4_first_seen_mapping",
    "q3_dense_seq_stats", "q4_time_buckets", "q5_run_length_compress", "q7_budget_compress", "q8_seq_truncate",
    "q13_target_evidence", "q16_conversion_state", "q17_temporal_velocity", "q18_temporal_fatigue", "q28_recency_pool",
    "w2_w3_session_flags", "l3_exact_subsample", "g0_global_rank", "g0_exact_quantiles",
    "e1_roc_auc", "e4_group_auc", "e12_hard_easy_profile", "e13_rank_inversions", "e15_distorted_slices", "e17_bucket_outcomes",
    "e29_hard_example_loss", "e30_frontier_loss", "t1_running_label_rate", "u2_feature_chain",
]


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in (os.environ.get("BENCH_QUERIES") or ",".join(HEADLINE)).split(",") if n]
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    timed, first = {}, {}
    for name in names:
        query = catalog.QUERIES[name]
        first[name] = round(run(query, spark, sf_dir), 4)
        timed[name] = round(statistics.median(run(query, spark, sf_dir) for _ in range(runs)), 4)
        print(f"{name} {timed[name]:.3f}s", file=sys.stderr, flush=True)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(timed.values()), 4), "unit": "sec", "queries": timed, "first": first, "sf": sf,
        "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
