"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Each query builds everything it needs
from the source tables; nothing computed by one query is reused by the next.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from duewise import catalog
from duewise.session import build_session

HEADLINE = [
    "table_dws_loan_status_snapshot_di",
    "table_dws_case_status_snapshot_di",
    "table_dws_collection_process_wide_di",
    "table_ads_vendor_performance_di",
    "table_ads_postloan_dashboard_di",
    "metric_m1_recovery_rate",
    "metric_recovery_rate_d30",
    "state_loan_daily",
    "anomaly_checks",
    "attribution_results",
    "join_asof_events",
    "features_dataset",
    "features_state_targets",
    "evaluate_lift_table",
    "order_exact_median",
    "text_scan_levels",
    "contact_frequency",
    "tool_vendor_performance",
    "strategy_results",
]


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    catalog.load()
    # One small query starts the executors, the code cache and the Python workers outside the timings.
    catalog.QUERIES["table_ads_vendor_performance_di"](spark, folder).limit(1).collect()
    timings: dict[str, float] = {}
    for name in wanted:
        catalog.forget_analyses()
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
