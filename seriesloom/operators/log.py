"""The write log as rows: batches with sequences, replay above a watermark, and segments that may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.plans.scratch import Scratch


def numbered(batches: DataFrame, by: str = "batch") -> DataFrame:
    """One row for each batch with its sequence, from 1, in order of ``by`` (null first). A batch without points has sequence 0.

    Batches are dealt by ranges of ``by`` and numbered within each; only the ranges' counts are summed in one task.
    """
    sums = batches.groupBy(by).agg(F.sum(F.col("points")).alias("points"))
    ranged = sums.repartitionByRange(F.col(by)).select(F.col(by), "points", F.spark_partition_id().alias("__range"))
    ranged = Scratch(batches.sparkSession, "log").keep(ranged)  # a range keeps its number whatever runs again
    full = (F.col("points") > 0).cast("long")
    counts = ranged.groupBy("__range").agg(F.coalesce(F.sum(full), F.lit(0)).alias("__full"))  # a row for each partition
    ahead = F.sum("__full").over(Window.orderBy("__range")) - F.col("__full")
    before = counts.select("__range", ahead.alias("__before"))
    sequence = F.col("__before") + F.sum(full).over(Window.partitionBy("__range").orderBy(by))
    dealt = ranged.join(F.broadcast(before), "__range")
    return dealt.select(by, "points", F.when(F.col("points") > 0, sequence).otherwise(0).cast("long").alias("sequence"))


def replayed(log: DataFrame, watermark: Column | int) -> DataFrame:
    """Rows that a snapshot at this watermark lacks."""
    return log.where(F.col("commit_seq") > watermark)


def collectable(segments: DataFrame, watermark: Column | int) -> DataFrame:
    """Completed segments whose last sequence is covered."""
    return segments.where(F.col("max_seq") <= watermark)
