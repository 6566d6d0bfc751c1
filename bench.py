"""Time every registered query; prints one JSON line.

Environment: BENCH_SF_DIR (folder of parquet tables), BENCH_CPUS (local cores),
BENCH_ONLY (comma-separated query names).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roomtide.catalog.queries import QUERIES  # noqa: E402
from roomtide.session import local_session, scratch  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session(cpus, app="roomtide-bench")
    QUERIES["hvac_zone_stats"](spark, folder).write.format("noop").mode("overwrite").save()  # warm up the JVM
    times: dict[str, float] = {}
    for name in only or QUERIES:
        start = time.perf_counter()
        with scratch(spark):
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of the registered queries",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
