"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.  Each query runs once to warm up
and is then timed over a full evaluation of its rows.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from recollect.catalog import all_queries

HEADLINE = (
    "normalize_text", "exact_lookup", "knn_join", "lsh_knn_join", "two_tier_lookup", "static_threshold_match",
    "conformal_threshold", "threshold_trace", "aggregate_metrics", "latency_percentiles", "running_hit_rate",
    "reuse_distance", "drift_scan", "evict_lowest", "admission_gate", "session_fusion", "token_bucket",
    "build_workload", "ring_assign", "replay_oplog",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    took: dict[str, float] = {}
    for name in names:
        known[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        known[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
