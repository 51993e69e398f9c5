"""Time every registered query and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores;
BENCH_QUERIES, a comma-separated list, limits the run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shelfmark.plans.workload import QUERIES  # noqa: E402
from shelfmark.session import local_session, staging  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)
    spark = local_session(cores, partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's and the scan's one-off work outside the timings
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_name").count().collect()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in chosen:
        start = time.perf_counter()
        try:
            with staging(spark):
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                times[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # one failing query must not hide the others
            failed[name] = str(error)[:200]
        print(name, times.get(name, "failed"), file=sys.stderr, flush=True)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if failed:
        result["failed"] = failed
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
