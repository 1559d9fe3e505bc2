"""Wall seconds of the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from deskwise.plans.queries import QUERIES

NAMES = ("r1_vector_topk", "r5_rank_fusion", "g1_overview", "g3_timeseries_day", "j1_qa_facts", "p2_status_counts", "i19_sentence_chunks", "e7_per_query_metrics", "g12_bootstrap", "w1_dialog_context")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["p2_status_counts"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the JVM's and Python's parts
    seconds = {}
    for name in NAMES:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_wall", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
