"""Wall time of the headline queries. Prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: cores (8).
Every query is planned and run once to warm up and then `REPEATS` times into a sink that
keeps nothing; the smallest time counts.  Profiles and intermediate writes are included.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workloads.queries import QUERIES  # noqa: E402

REPEATS = 2
HEADLINE = [
    "scan_filter_project",
    "rolling_all",
    "rolling_all_crowded",
    "rolling_orders_30d",
    "pit_basic",
    "pit_delay",
    "pit_two_sets",
    "pit_two_keys",
    "backfill_window",
    "incremental_equals_full",
    "read_through",
    "training_matrix",
    "classification_metrics",
    "rf_score",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        took = []
        for _ in range(1 + REPEATS):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(min(took[1:]), 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": Path(sf).name.removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
