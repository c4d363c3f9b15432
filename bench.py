"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tidewatch.plans import catalogue  # noqa: E402

HEADLINE = ["flagship", "rolling_median", "rolling_median_residual", "weighted_average", "correlate_all_pairs", "correlate_spearman", "trend_filter", "midas_velocity", "mad_scale", "trimmed_skew", "kalman_smooth", "kalman_forward", "run_grid_medians", "point_in_polygon", "neighbour_std"]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS):  # the first run compiles; the median of three is kept
            start = time.time()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        times[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
