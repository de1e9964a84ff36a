"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_QUERIES a
comma-separated list of queries (``all`` for every registered one).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tallyrank.catalog.queries import REGISTRY

HEADLINE = (
    "recommend_all", "recommend_one", "cascade_topk", "lookup_join", "item_features", "impute_mean",
    "entity_ratio", "location_ratio", "song_score", "topic_score", "keyword_score_negated", "match_odds",
    "conditional_share", "group_nunique", "describe", "metric_summary", "histogram", "fixed_bins",
    "backfill", "strided_sample", "topk", "time_series", "scan_csv", "knn_regress", "adaboost_r2",
    "models_group_mean", "cv_group_mean", "stack_group_mean",
)


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if wanted == "all" else wanted.split(",") if wanted else list(HEADLINE)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tallyrank-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one run on the smallest tables starts the JVM's compilers; it is not counted
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        run(spark, "recommend_all", warm)
    seconds = {}
    for name in names:
        seconds[name] = round(run(spark, name, sf_dir), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
