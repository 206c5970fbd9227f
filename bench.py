"""Runs the headline queries and prints one JSON line: seconds for each (median of three after a warm-up)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "a1_analytics_summary", "a4_costs_by_provider", "a12_popular_categories", "a18_cost_report", "a27_suspicious_addresses", "a30_usage_rollup", "j11_product_counts", "j13_overlapping_boxes",
    "j14_new_only", "w5_last_twenty", "d1_split_candidates", "d5_best_on_page", "v1_v12_validate", "route_products", "s1_page", "t1_daily_counts", "snk4_product_rows",
)


def main() -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    os.environ["PYTHONPATH"] = here + os.pathsep + os.environ.get("PYTHONPATH", "")
    from pyspark.sql import SparkSession

    from offerlake.plans import catalog

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run, took = catalog.QUERIES[name][0], []
        for _ in range(4):
            began = time.time()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        seconds[name] = round(statistics.median(took[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "seconds of all headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
