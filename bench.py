"""Seconds per headline query: one JSON line."""

from __future__ import annotations

import json
import os
import time

from hitledger.plans import all_queries
from hitledger.session import local_session

HEADLINES = (
    "parse_access_log semantic_event_name gap_by_app gap_by_url dim_metrics metric_gap top_gap_segments identity_gap observability_measurement "
    "match_behavior_transaction match_transaction_state reconciliation_measurement mapping_coverage_join sessionize behavior_kpi_hourly distribution "
    "stream_completeness_minute stream_duplicates_minute stream_ordering_minute stream_summary_minute replay_lag_minute replay_gaps metric_baseline "
    "stat_profile threshold_calibration statistical_evidence psi risk recommend_actions root_cause_candidates reorder_blocks stream_minute_quality "
    "check_unsupported_claims source_contract_check"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "hitledger-bench")
    queries, took = all_queries(), {}
    # one query warms the session, so the first headline is not charged for it
    queries["hit_metrics"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINES:
        start = time.time()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
