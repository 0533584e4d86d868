"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.  Every query
is executed in full (all columns of all rows go to the no-op sink); of a query
below ``REPEAT_BELOW`` seconds the least of three runs counts.  The yardstick is
a fixed Spark job over no table of ours: times of different machines or days
compare after division by it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "weather_panel", "feature_recipe", "lag_features", "rolling_features", "event_lags", "descriptive_stats",
    "raw_extreme_thresholds", "histogram", "monthly_profile", "extremes_by_month", "quality_score",
    "raw_pearson_matrix", "raw_spearman_matrix", "seasonal_correlations", "lagged_correlations", "vif",
    "moment_tests", "rank_tests", "acf", "ljung_box", "kpss", "adf", "site_periodograms", "wavelet_spectrum",
    "seasonal_decomposition", "ridge_search", "roc_auc", "two_stage_evaluation", "linear_two_stage", "seasonal_ar_forecast",
]


#: Seconds below which a query runs three times.
REPEAT_BELOW = 4.0


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def yardstick(spark):
    """Hashes, a shuffle and an aggregate over generated rows."""
    rows = spark.range(20_000_000).selectExpr("id", "xxhash64(id) % 1000003 AS k", "sqrt(id) AS x")
    return rows.groupBy("k").agg({"x": "avg", "id": "max"})


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pluvia-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pluvia.plans.catalog import QUERIES

    only = sys.argv[1:] or HEADLINE
    QUERIES["weather_panel"](spark, sf_dir).count()  # start the JVM's code cache
    measure = round(min(timed(lambda: yardstick(spark)) for _ in range(3)), 3)
    times = {}
    for name in only:
        taken = [timed(lambda: QUERIES[name](spark, sf_dir))]  # noqa: B023  (called at once)
        if taken[0] < REPEAT_BELOW:
            taken += [timed(lambda: QUERIES[name](spark, sf_dir)) for _ in range(2)]  # noqa: B023
        times[name] = round(min(taken), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"), "cpus": int(cpus), "yardstick": measure,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
