"""Wall time of the headline queries: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3, the best counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tideline.catalogue import all_queries  # noqa: E402
from tideline.session import local_session  # noqa: E402

HEADLINE = [
    # query packs
    "top_artists", "loyal_customers", "genre_popularity", "playlist_diversity", "employee_performance", "revenue_trend",
    "country_genre_coverage", "customer_cross_sell", "playlist_revenue_rank", "media_type_basket", "heavy_user_product",
    "order_total", "orders_per_user", "latest_orders", "nested_orders",
    # statement log and health
    "slow_query_page", "facet_lists", "slowest_per_statement", "table_heat", "performance_summary", "latency_percentiles",
    "ewma_per_statement", "dirty_transaction", "failure_breaker",
    # rules, sync, replication, series
    "rule_match", "reconcile", "route_decision", "sync_state_update", "cdc_apply", "cdc_state_machine", "sync_monitor",
    "counter_rate", "histogram_quantile", "log_flatten",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("tideline-bench", cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    for name in names:
        best = None
        for _ in range(runs):
            t = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - t
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
