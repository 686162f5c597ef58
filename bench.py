"""Time the headline queries; prints one JSON line.

Every query is written to the ``noop`` sink, so that no column is pruned away. The first run of
each query warms up the JVM and is not counted.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from troughline.plans.study_queries import QUERIES  # noqa: E402
from troughline.sources.storage import clear_stages  # noqa: E402

HEADLINE = (
    "pta_by_crcl",
    "exposure_profile",
    "exposure_long_history",
    "median_profile",
    "ci_family",
    "dose_interval",
    "trapezoid_series",
    "map_estimate",
    "target_auc_dose",
    "full_profile",
    "pta_by_method",
    "policy_report",
    "as_of_dose",
    "window_auc24",
    "regimen_versions",
    "map_grid_history",
)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # staged tables: the folder that the cluster names, or beside the repository, where one machine runs it all
    shared = os.environ.get("BENCH_SHARED_DIR", os.path.join(os.path.dirname(os.path.abspath(__file__)), "spark-warehouse", "bench"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", shared)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    seconds = {}
    for name in HEADLINE:
        for target in (small if os.path.isdir(small) else folder, folder):
            begun = time.perf_counter()
            QUERIES[name](spark, target).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begun, 3)
            clear_stages(spark)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
