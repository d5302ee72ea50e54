"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed in full through the ``noop`` sink (every row computed,
nothing collected to the driver); the reported time is the best of
``$BENCH_REPS`` runs after one warm-up of the flagship query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "corpus_build",
    "txt_sanitize",
    "txt_encode_fixed",
    "split_holdout",
    "episode_support_query",
    "multitask_step_schedule",
    "agg_prototypes",
    "job_evaluate_split",
    "agg_accuracy_batch_mean",
    "grad_cosine_groups",
    "agg_grad_accumulate",
    "job_interference_report",
    "win_rolling_mean",
    "win_running_best",
    "src_lines_positional",
    "job_joint_multitask",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    reps = int(os.environ.get("BENCH_REPS", "2"))
    names = sys.argv[1:] or HEADLINE
    from taskweave.registry import QUERIES
    from taskweave.session import build_session
    spark = build_session(app_name="taskweave-bench")
    QUERIES["corpus_build"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        best = None
        for _ in range(reps):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None,
                      "cpus": os.environ.get("BENCH_CPUS", "8"), "reps": reps}))
    spark.stop()


if __name__ == "__main__":
    main()
