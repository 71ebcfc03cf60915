"""Streams of points into a store, exactly once.

The checkpoint's offset log replays a batch that failed under the same id; the store's manifest remembers the last id of each
stream and skips what it has. Together a batch is committed once. Batch ids mean something only within their checkpoint, so the
manifest keeps the checkpoint's own id (of its metadata file) with the name: another checkpoint under a known name is an error. Late points are never dropped: ingest has no event-time watermark.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seriesloom.plans.engine import Engine
from seriesloom.plans.manifest import Files
from seriesloom.sources.points import POINT


def file_source(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of points as they arrive; ``files_per_batch`` bounds a batch and so holds back a fast producer."""
    return spark.readStream.schema(POINT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def rate_source(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """Synthetic points at a steady rate."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(
        F.lit("load.rate").alias("metric_name"),
        F.create_map(F.lit("host"), F.concat(F.lit("node-"), (F.col("value") % 16).cast("string"))).alias("tags"),
        (F.unix_micros("timestamp") * 1000 + F.col("value") % 1000).alias("timestamp_ns"),
        F.col("value").cast("double").alias("value"),
    )


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Structured Streaming gave a checkpoint when it was first used."""
    return json.loads(Files(spark, checkpoint).read(f"{checkpoint}/metadata"))["id"]


def ingest(points: DataFrame, engine: Engine, checkpoint: str, name: str = "ingest", every: str | None = None) -> StreamingQuery:
    """Starts ingest of a streaming DataFrame; without ``every`` it takes what is there and ends."""
    spark = points.sparkSession

    def commit(batch: DataFrame, batch_id: int) -> None:
        engine.append(batch, stream=name, batch=batch_id, checkpoint=checkpoint_id(spark, checkpoint))

    writer = points.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
