"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all),
BENCH_REPEAT (default 1; the best run counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "spine_daily_counts",
    "cci_visit",
    "rollup_year",
    "features_core",
    "feature_table",
    "rules_tracking",
    "threshold_curve",
    "winsor_scale",
    "gmm_score_fixed",
    "gmm_fit",
    "cluster_profiles",
    "cohens_d",
    "medoids",
    "ari",
    "spearman_by_cluster",
    "ols_interaction",
    "rank_biserial",
    "cohort_compare",
]


#: Run untimed before the others, so that early queries do not pay for the compiler alone.
WARM_UP = ["archetype_distribution", "feature_table", "spearman_by_cluster"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from spanweave.plans.all_queries import QUERIES

    for name in WARM_UP:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        best = None
        for _ in range(repeat):  # the same number for all, so that figures can be compared
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline query time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
