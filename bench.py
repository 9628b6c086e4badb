"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is built fresh and fully executed into Spark's ``noop`` sink (the
whole plan runs, nothing is collected to the driver). One warm-up run, then
the median of ``BENCH_RUNS`` runs. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ranktide.catalog.registry import load_all  # noqa: E402
from ranktide.session import build_session  # noqa: E402

HEADLINE = [
    "mart_opportunities",
    "mart_opportunity_state",
    "join_tiered_source",
    "flt_outdated",
    "pipe_briefs",
    "man_dep_lines",
    "triage_listing",
]


def run_once(spark, build, sf_dir: str) -> float:
    t0 = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", app="ranktide-bench", partitions=int(cpus))
    reg = load_all()
    keys = [k for k in HEADLINE if k in reg]
    times: dict[str, float] = {}
    for k in keys:
        run_once(spark, reg[k].build, sf_dir)  # warm-up
        times[k] = round(statistics.median(run_once(spark, reg[k].build, sf_dir) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_total_median_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": int(cpus),
        "runs": runs,
    }))


if __name__ == "__main__":
    main()
