"""Times every registered query once the cleaned table is stored.

Prints one JSON line. ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the
cores. Each query is run ``BENCH_RUNS`` times (default 2) and its best time
counts; the time covers building the plan and fetching the result. Queries that
return readings are drained into Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from airq.plans import registry
from airq.session import local_session
from airq.sources import tables

# Queries that return readings instead of a small result.
DRAINED = {"clean_readings", "read_readings", "state_slice", "filter_readings"}


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus)

    def run(name, query):
        df = query(spark, sf_dir)
        if name in DRAINED:
            df.write.format("noop").mode("overwrite").save()
        else:
            df.collect()

    # Loading comes first, as it would in a session; the JVM is cold here.
    times = {"store_readings": seconds(lambda: tables.readings(spark, sf_dir))}
    for name, query in registry.queries().items():
        times[name] = min(seconds(lambda: run(name, query)) for _ in range(runs))
    times = {name: round(t, 3) for name, t in times.items()}
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
