"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder (default sf0.1), BENCH_CPUS the cores, BENCH_RUNS the
timed runs per query after one warm-up (the median is reported).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sightline.plans import registry  # noqa: E402
from sightline.session import local_session  # noqa: E402

HEADLINE = [
    "coverage_global", "coverage_by_source", "coverage_by_region", "coverage_by_infra_and_log_type", "role_network", "kpi_table", "partially_covered_assets",
    "matches_all", "detections", "matches_industry", "detections_boosted", "fragment_counts",
    "column_profile_all", "catalog_profile", "field_meaning", "requirement_reports", "classified_fields",
    "readiness_per_job", "value_summary", "compliance_frameworks_per_job", "report",
    "lineage_report", "ingestion_pattern",
    "performance_summary", "rolling_error_rate", "concurrent_operations", "request_counts", "failure_streaks", "duration_percentile", "rate_windows", "dashboard_stats", "folded_operations",
    "similar_vectors_loose", "stream_request_windows", "stream_live_detections",
]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    queries = registry.queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            queries[name](spark, base).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name:36} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(base).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
