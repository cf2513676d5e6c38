"""Time the headline queries; prints one JSON line.

Each query runs once to load classes and compile its code and once on the clock,
over its whole tables, into a sink that consumes every row.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline queries)
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from wardlens.catalog.queries import QUERIES

HEADLINE = (
    "q01_valid_active",
    "q03_slot_activity",
    "q04_organisms",
    "q07_ward_table",
    "q08_enriched",
    "q12_patients_per_ward",
    "q13_isolation_map",
    "q14_cleaning_list",
    "q15_indicators",
    "q20_moving_average_7",
    "q22_loess",
    "q23_covid_cases",
    "q25_covid_daily_state",
    "q26_history_upsert",
    "q30_snapshot_merge",
    "q31_bed_movements",
    "q32_retention_purge",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wardlens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    times = {}
    for name in names:
        run(spark, name, folder)
        times[name] = round(run(spark, name, folder), 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    scale = os.path.basename(folder).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total warm seconds of the headline queries",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
