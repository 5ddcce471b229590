"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is fully executed through the ``noop`` sink (no result is pulled
to the driver): one warm-up run (JIT, code generation, file listing), then the
median of $BENCH_RUNS (default 3) timed runs.  Prints one JSON line:
{"metric", "value" (sum of the per-query medians), "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chronoframe.config import build_session  # noqa: E402
from chronoframe.plans.driver_queries import QUERIES  # noqa: E402

HEADLINE = [
    "session_summary",
    "derived_log",
    "play_period",
    "sample_rate",
    "session_span",
    "pointer_track",
    "fill_down",
    "animation_frames",
    "animation_frames_v2",
    "spawn_points",
    "merge_logs",
    "linear_curve",
    "smooth_curve",
    "mixed_model_select",
]
# the shuffle-heaviest queries, reported apart from the headline total
MORE = [
    "pointer_frames_v2",
    "dense_frames",
    "overlay_anti",
    "csv_session_summary",
    "csv_split_rows",
    "sorted_log",
    "random_intercept_test",
]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = sys.argv[1:]
    names, more = (chosen, []) if chosen else (HEADLINE, MORE)
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(app_name="chronoframe-bench")
    times = {}
    for name in [*names, *more]:
        run(spark, name, sf_dir)  # warm-up
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times[n] for n in names), 3),
                "unit": "sec",
                "queries": {n: times[n] for n in names},
                "more_queries": {n: times[n] for n in more},
                "sf": float(m.group(1)) if m else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
