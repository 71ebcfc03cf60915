"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from seriesloom.plans.catalogue import QUERIES
from seriesloom.plans.engine import Engine
from seriesloom.plans.session import local_session
from seriesloom.sources.points import synthetic

POINTS = 1_000_000


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    run(QUERIES["q01_series_query"](spark, sf))  # compiles and warms what all share
    times: dict[str, float] = {}
    for name, f in QUERIES.items():
        began = time.perf_counter()
        run(f(spark, sf))
        times[name] = round(time.perf_counter() - began, 3)
    base = tempfile.mkdtemp(prefix="seriesloom-bench-")
    try:
        engine = Engine(spark, f"file://{base}/store")
        points = synthetic(spark, POINTS)
        began = time.perf_counter()
        engine.append(points, flush=False)
        times["append_1m_points"] = round(time.perf_counter() - began, 3)  # durable and readable
        began = time.perf_counter()
        engine.flush()
        times["flush_1m_points"] = round(time.perf_counter() - began, 3)
        began = time.perf_counter()
        run(engine.query("cpu.load", {"region": "us-east-1"}, 0, POINTS // 2))
        times["query_1m_points"] = round(time.perf_counter() - began, 3)
    finally:
        shutil.rmtree(base, ignore_errors=True)
    rate = round(POINTS / times["append_1m_points"])
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf), "append_points_per_sec": rate}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
