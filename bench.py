"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The value is the sum of the per-query medians over the timed repetitions; each
query runs to the end of its plan, including the jobs it starts while planning.
Axes: the four score queries, rule sets of 5, 50 and 100 values, repair with
and without run compression.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.session import local_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "cvq_entity",
    "cvq_entity_multi",
    "cvq_cohort_avg",
    "cvq_db_avg",
    "hsq_entity",
    "hsq_entity_multi",
    "hsq_cohort_avg",
    "hsq_db_avg",
    "cvq_orders",
    "hsq_orders",
    "cvq_parts",
    "hsq_parts",
    "cvq_lines",
    "hsq_lines",
    "latest_values",
    "present_edges",
    "topo_row_number",
    "run_compress",
    "detect_errors",
    "repair_status",
    "repair_compressed",
    "repair_events",
    "repair_join_back",
    "rule_closure",
    "rule_rank",
    "value_relation",
    "value_counts",
    "value_versions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cpus, "tidemark-bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    names = sys.argv[1:] or HEADLINE
    for name in names:  # warm up: class loading, code generation, Python workers
        run(name)
    seconds = {}
    for name in names:
        seconds[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
