"""Time the headline queries: median of three runs after a warm-up, one JSON line at the end."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rulegrain.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "code_lines",
    "rule_match_line",
    "js_findings",
    "sec_findings",
    "py_findings",
    "all_findings",
    "dep_findings",
    "prj_findings",
    "dast_findings",
    "dedupe_findings",
    "merge_roots",
    "findings_by_file",
    "sorted_findings",
    "suppress_by_path",
    "join_osv_new_ids",
    "patched_files",
    "report_json",
    "stream_severity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    folder = tempfile.TemporaryDirectory(prefix="bench-")  # driver and executors are one process here
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", folder.name)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {times[name]} s (first {taken[0]:.1f} s)", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}
        )
    )


if __name__ == "__main__":
    main()
