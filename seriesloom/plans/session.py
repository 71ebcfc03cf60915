"""Session defaults for local runs; on a cluster the submitter's settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, **extra: str) -> SparkSession:
    """A local session with AQE, UTC and as many shuffle partitions as threads."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
    } | extra
    return SparkSession.builder.master(f"local[{n}]").config(map=conf).getOrCreate()
