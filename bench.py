"""Times every report and prints one line of JSON.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1) and BENCH_CPUS the
number of cores (default: all). The observations are first ingested into the
combined Parquet table, which is timed as `ingest`; the reports read that table.
Results go to Spark's noop sink, so every row is computed and none is collected.
The best of BENCH_RUNS runs counts (default 3).
"""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from frostline.plans.ingest import combine
from frostline.sources.files import read_observations
from frostline.sources.shared import shared_path
from registry.observations import observations
from registry.queries import REPORTS


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        # windows are costly per byte, so small partitions are worth a task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(only: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(cpus)
    times: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        took = time.perf_counter() - start
        times[name] = round(min(took, times.get(name, took)), 3)

    for _ in range(runs):
        path = shared_path(spark, "observations")
        timed("ingest", lambda: combine(observations(spark, sf_dir), path))
        table = read_observations(spark, path)
        for name, report in REPORTS.items():
            if not only or name in only:
                timed(
                    name,
                    lambda: report(table).write.format("noop").mode("overwrite").save(),
                )
    rows = table.count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "all_reports_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "rows": rows,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
