"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from textanomaly.plans import experiments
from textanomaly.queries import QUERIES
from textanomaly.queries.shared import vector_corpus, vector_hierarchy
from textanomaly.session import get_session

HEADLINES = [
    "clean_text",
    "pool_mean",
    "pool_mean_joined",
    "prepare_corpus",
    "cap_per_label",
    "contaminate_independent",
    "contaminate_contextual",
    "standardize_features",
    "knn",
    "neighbour_sum",
    "lambda_grid",
    "sub_ensemble",
    "predict",
    "roc_auc",
    "ranking_overall",
    "ensemble_curve",
    "fit_large",
    "score_models",
    "benchmark",
]


def benchmark_runs(spark, folder):
    """Ten runs over every inlier class with the full settings of all six models."""
    corpus = vector_corpus(spark, folder)
    return experiments.benchmark(
        corpus, vector_hierarchy(corpus), "contextual", 0.1, "given", runs=10, min_size=15, seed=7
    )


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = {name: QUERIES[name] for name in HEADLINES}
    queries["benchmark_ten_runs"] = benchmark_runs
    times = {}
    for name, query in queries.items():
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = folder.rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
                "cores": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
