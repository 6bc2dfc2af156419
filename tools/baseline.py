"""Time the SQL of the headline queries in an in-process DuckDB, as bench.py does."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from bench import HEADLINE, RUNS  # noqa: E402
from compare import connect  # noqa: E402
from daybook.plans.check_sql import statement  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    con = connect(folder)
    con.execute(f"SET threads = {os.environ.get('BENCH_CPUS', '8')}")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {statement(name)}")
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"value": round(sum(times.values()), 4), "queries": times}))


if __name__ == "__main__":
    main()
