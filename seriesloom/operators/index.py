"""Registry, inverted index, statistics of chunks, and pruning with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.predicates import ValuePredicate


def registry(points: DataFrame) -> DataFrame:
    """One row for each series. The key determines metric and tags, so this is a distinct by hashing, partly done before the shuffle."""
    return points.select("series_key", "metric_name", F.sort_array(F.map_entries("tags")).alias("tags")).distinct().withColumn("tags", F.map_from_entries("tags"))


def postings(series: DataFrame) -> DataFrame:
    """(tag_key, tag_value, series_key), distinct, from anything with tags and series_key."""
    return series.select(F.explode("tags").alias("tag_key", "tag_value"), "series_key").distinct()


def series_with(index: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Keys of the series whose postings hold all of these tags: one aggregation over the postings that any of them names."""
    wanted = F.lit(False)
    for k, v in sorted(tags.items()):
        wanted = wanted | ((F.col("tag_key") == k) & (F.col("tag_value") == v))
    return index.where(wanted).groupBy("series_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(tags)).select("series_key")


def number(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def chunk_stats(points: DataFrame, by: list[str]) -> DataFrame:
    """Time span, rows, and least and most value of each group. NaN counts only where there is nothing else."""
    v = F.col("value")
    least, most = F.min(number(v)), F.max(number(v))
    only_nan = F.when(F.count(v) > 0, F.lit(float("nan")))
    return points.groupBy(*by).agg(
        F.min("timestamp_ns").alias("time_start_ns"),
        F.max("timestamp_ns").alias("time_end_ns"),
        F.count(F.lit(1)).alias("entry_count"),
        F.coalesce(least, only_nan).alias("min_value"),
        F.coalesce(most, only_nan).alias("max_value"),
    )


def file_bounds(stats: DataFrame) -> DataFrame:
    """Statistics of whole chunks from those of their series."""
    return stats.groupBy("chunk_id").agg(
        F.min("time_start_ns").alias("time_start_ns"),
        F.max("time_end_ns").alias("time_end_ns"),
        F.sum("entry_count").cast("long").alias("entry_count"),
        F.countDistinct("series_key").alias("series_count"),
    )


def prune(stats: DataFrame, start: int | None = None, end: int | None = None, predicate: ValuePredicate | None = None) -> DataFrame:
    """Entries that may hold rows of the range and predicate; what has no value statistics stays."""
    hit = F.lit(True)
    if end is not None:
        hit = hit & (F.col("time_start_ns") <= end)
    if start is not None:
        hit = hit & (F.col("time_end_ns") >= start)
    if predicate:
        hit = hit & predicate.chunk(F.col("min_value"), F.col("max_value"))
    return stats.where(hit)


def deregister(stats: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entries without those of the given chunks."""
    return stats.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
