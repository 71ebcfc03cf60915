"""Scratch tables: what is written, and that it is whole."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from seriesloom.plans.scratch import Scratch


def test_tables_are_parts_alone(spark):
    """Each further file is a process that the executor has to start."""
    df = spark.range(0, 1000, 1, 4).withColumn("text", F.repeat(F.col("id").cast("string"), 3))
    with Scratch(spark, "test") as scratch:
        kept = scratch.keep(df)
        names = os.listdir(kept._scratch_path.removeprefix("file:").replace("//", "/"))
        assert len(names) == 4 and all(n.startswith("part-") and n.endswith(".zstd.parquet") for n in names)
        assert sorted(kept.collect()) == sorted(df.collect())
        scratch.drop(kept)
        assert not os.path.exists(kept._scratch_path.removeprefix("file:"))
