"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once to warm up and three times measured, to the last row
(``noop`` sink); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from daybook.plans.registry import QUERIES  # noqa: E402
from daybook.session import build_session  # noqa: E402

HEADLINE = (
    "event_raw", "dwd_todo_event_detail", "dwd_task_lifecycle", "dwd_user_active_detail",
    "dws_user_active_1d", "dws_user_behavior_summary", "dws_task_summary_1d",
    "dws_event_type_summary_1d", "dws_hour_active_summary", "dws_channel_region_summary",
    "dws_new_old_user_summary", "dws_user_retain_summary", "dws_user_feature_usage_summary",
    "wau_mau", "activity_kpis", "cohort_retention_matrix", "channel_quality",
    "completion_kpis", "priority_stats", "duration_histogram", "duration_box", "task_funnel",
    "completion_by_feature", "segment_feature_summary", "sessionize", "event_transitions",
    "duplicate_sessions", "run_metrics",
)
RUNS = 3


def seconds(spark, query, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        seconds(spark, QUERIES[name], folder)
        runs = [seconds(spark, QUERIES[name], folder) for _ in range(RUNS)]
        times[name] = round(statistics.median(runs), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
