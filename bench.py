"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Each query runs BENCH_RUNS times into a sink that discards rows; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from askgrid import session
from askgrid.workload import all_queries

HEADLINE = (
    "retrieve_fuse_cite",
    "a4_a5_a6_admitted",
    "a8_segment_paragraphs",
    "a9_segment_markdown",
    "a12_a13_a14_chunk_documents",
    "a13_window_tokens",
    "a16_embed",
    "b2_assign_versions",
    "b3_apply_attempts",
    "c4_scoped_topk",
    "c5_topk_cosine",
    "c6_topk_ivf",
    "d6_limit_candidates",
    "d9_d10_rerank_or_fallback",
    "d13_build_prompts",
    "e3_parse_intents",
    "e4_select_route",
    "f3_recent_memory",
    "f8_fold_live_runs",
    "f11_stage_stats",
    "g6_retrieval_metrics",
    "g9_latency_stats",
    "g13_intent_accuracy",
    "g15_replay_thresholds",
    "g18_stage_gates",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    only = os.environ.get("BENCH_ONLY")
    names = [n for n in HEADLINE if not only or n in only.split(",")]
    took: dict[str, float] = {}
    # One untimed run, so that starting the JVM does not count for the first query.
    registered["c8_fan_out"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus),
        "runs": runs,
    }))


if __name__ == "__main__":
    main()
