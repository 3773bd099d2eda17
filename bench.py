"""Time the headline queries on one machine; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the cores, BENCH_QUERIES (optional, comma
separated, or "all") the queries.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from tunegrain.plans.catalog import QUERIES
from tunegrain.runtime import build_session

HEADLINE = [
    "age_range", "hottest_songs", "largest_group", "longest_row", "decade_histogram", "label_summary",
    "array_stats", "segment_signature", "array_signature", "adjacency", "bfs_levels", "shortest_path",
    "shortest_paths", "first_per_key", "balance_bins", "balance_eras", "stratified_split", "standard_scale",
    "robust_scale", "correlation_matrix", "regression_metrics", "error_histogram", "classification_metrics",
    "weighted_rows", "linear_model", "ridge_loocv", "linear_sgd", "run_times", "compact_small_files",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "tunegrain-bench",
        master=f"local[{cpus}]",
        **{
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="tunegrain-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()  # start the executor before the clock
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall clock",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
