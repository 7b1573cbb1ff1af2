"""Time the headline queries: one warm-up run, then the median of the timed runs."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cliptide.catalog import QUERIES  # noqa: E402
from cliptide.session import get_session  # noqa: E402

HEADLINE = [
    "evidence_select",
    "mmr_prefix",
    "node_aggregate",
    "graph_select",
    "calibrated_depth",
    "depth_entropy_hazard",
    "tfidf_rank",
    "bm25_rank",
    "hybrid_rank",
    "interval_overlap_join",
    "interval_iou",
    "merge_turns",
    "lookback_join",
    "scene_windows",
    "accuracy_rollup",
    "roc_eer",
    "token_f1",
    "characters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {times[name]} (first {taken[0]:.2f})", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
