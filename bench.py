"""Time the headline queries; one JSON line on standard output.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the runs
after the warm-up (the median counts), ``BENCH_QUERIES`` other queries than the headline ones.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from packetflow.plans.queries import QUERIES  # noqa: E402
from packetflow.session import get_session  # noqa: E402

HEADLINE = [
    "build_flows",
    "build_flows_biflow",
    "build_flows_interim",
    "sample_n_of_N",
    "rtt_summary",
    "classify_by_port",
    "drift_fit",
    "correct_time",
    "aggregate_cascade",
    "project_template",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = get_session(cpus, "packetflow-bench", **{"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8"})
    packets = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries (median after warm-up)",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "packets": packets,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
