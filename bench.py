"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then ``$BENCH_REPEATS`` times (default 3); the
median counts. Results go to Spark's ``noop`` sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from transectra.session import local_session
from transectra.workload import QUERIES

HEADLINE = (
    "severity_rollup", "dataset_findings", "report_headers", "worst_per_file", "download_plan", "manifest_coverage",
    "quality_stats", "threshold_arms", "confidence_filter", "confidence_sweep", "elevation_grid", "gradual_selection",
    "residual_rms", "nearest_markers", "stage_columns", "input_set_hashes", "contact_sheet_layout", "cpu_summary",
    "streamed_cpu_summary",
)
# Rows of the table that drives a query, for the rates.
DRIVING = {
    "severity_rollup": "documents", "confidence_filter": "lineitem", "confidence_sweep": "lineitem", "elevation_grid": "lineitem",
    "gradual_selection": "lineitem", "residual_rms": "lineitem", "quality_stats": "events", "cpu_summary": "events",
}


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("transectra-bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, name, sf_dir)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(repeats)), 3)
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in sorted(set(DRIVING.values()))}
    rates = {q: round(rows[t] / times[q]) for q, t in DRIVING.items() if q in times}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "rows_per_sec": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
