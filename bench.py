"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores, BENCH_REPEAT the runs per
query, of which the best counts. Every result row is computed; none is sent to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "quality_by_grade", "overall_grades", "metrics_summary", "metrics_summarize", "trend_summary", "trend_drops",
    "ab_welch", "pool_merge_dedup", "dedup_by_input", "duplicate_audit", "gate_filler", "gate_repetition", "gate_report",
    "ifeval_scores", "example_validation", "classified_prompts", "knn_bigram", "knn_words", "knn_embeddings",
    "bucket_report", "latency_percentiles", "pairwise_variability", "failure_streaks", "cache_compaction",
    "sequential_split", "json_recovery", "framework_detections", "stream_windows",
]


def main() -> None:
    from quillspark.plans.registry import QUERIES
    from quillspark.session import build_session, scratch

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/documents.parquet").count()
    times: dict[str, float] = {}
    for name in chosen:
        best = None
        for _ in range(repeat):
            start = time.perf_counter()
            with scratch(spark):
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    line = {
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
