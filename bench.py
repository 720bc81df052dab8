"""Headline queries, timed: prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_RUNS`` (default 3).
Each query is warmed up once; its figure is the median of the runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from opsloom.plans.catalogue import REGISTRY
from opsloom.session import local_session

HEADLINE = [
    "top_talkers", "rejected_traffic", "flow_matrix", "category_performance", "revenue_by_region", "port_scans", "ip_profile",
    "latency_percentiles_exact", "merged_uniques", "daily_active_users", "alarm_states", "customers_with_large_orders",
    "cidr_enrichment", "last_click_before_purchase", "graph_reach", "leaderboard", "order_value_rank", "keep_last_per_user",
    "latest_orders_nested", "replay_running", "compacted_log", "decrement_stock", "rate_fixed_window", "rate_sliding_count",
    "rate_token_bucket", "user_sessions", "parsed_access_log", "text_search", "nearest_vectors", "service_map", "run_tumbling_stream",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus)
    timings = {}
    for name in sys.argv[1:] or HEADLINE:
        samples = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            REGISTRY[name](spark, path).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(samples[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                      "sf": os.path.basename(path.rstrip("/")), "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
