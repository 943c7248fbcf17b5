"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the warm median of three runs of each."""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from chronolane import plans

HEADLINE = [
    "runs_encode",
    "interval_view",
    "summary_fold",
    "query_state_at",
    "carry_forward_state",
    "asof_left_default",
    "patch_apply",
    "debounce",
    "corrections_fold",
    "interval_overlay",
    "interval_merge_overlap",
    "episodes_screen",
    "agg_grouping_sets",
    "search_all_tokens",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("chronolane-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            plans.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
