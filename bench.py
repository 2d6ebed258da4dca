"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores, BENCH_RUNS
the timed runs per query after one warm-up; the median counts.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from spendscope.session import local_session
from spendscope_checks import queries

HEADLINE = (
    "a1_priced_usage",
    "a2_totals",
    "a3_cost_by_dimension",
    "a4_tag_coverage",
    "a5_weekend_pattern",
    "a7_warehouse_rollup",
    "a8_interactive_cluster_costs",
    "a9_job_costs",
    "a11_run_metrics",
    "a13_top_cluster_utilization",
    "a15_idle_clusters",
    "a17_autoscale_stats",
    "a18_user_stats",
    "a19_disk_spill",
    "a21_pattern_counts",
    "c9_autoscale_verdict",
    "c10_cluster_issues",
    "c11_warehouse_issues",
    "c12_long_running_warehouses",
    "c13_upscaled_warehouses",
    "c14_idle_warehouses",
    "t1_top_items",
    "t5_recent_events",
)
FULL_RUN = "r25_recommendations"


def timed(name: str, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    queries.run(name, spark, sf_dir, fresh=True).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    seconds = {}
    for name in HEADLINE:
        timed(name, spark, sf_dir)
        seconds[name] = round(statistics.median(timed(name, spark, sf_dir) for _ in range(runs)), 3)
    # Computes every result; the queries before have warmed it up.
    seconds[FULL_RUN] = round(timed(FULL_RUN, spark, sf_dir), 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
