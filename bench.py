"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs over its whole tables and its result is fully computed (noop sink).
One small query runs first, so that JVM and Python workers are up.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "point_normalize",
    "cell_histogram",
    "partition_plan",
    "partition_coverage",
    "local_knn_status",
    "exact_knn",
    "l2_knn",
    "customer_nof",
    "part_nof",
    "event_nof",
    "order_nof",
    "geojson_vertices",
    "csv_normalize",
]


def main():
    from outskirt.catalog import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("outskirt-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name, folder):
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        run("customer_nof", small)
    names = sys.argv[1:] or HEADLINE
    times = {name: run(name, sf) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
