"""Selecting points, the last write of each timestamp, and accounting of buffered points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.predicates import ValuePredicate, has_tags, within


def select_points(
    points: DataFrame, metric: str, tags: dict[str, str] | None = None, start: int | None = None, end: int | None = None, predicate: ValuePredicate | None = None
) -> DataFrame:
    """Rows of a metric whose tags hold ``tags``, in an inclusive time range; an unknown metric gives no rows."""
    hit = (F.col("metric_name") == metric) & within(F.col("timestamp_ns"), start, end)
    if tags:
        hit = hit & has_tags(F.col("tags"), tags)
    if predicate:
        hit = hit & predicate.row(F.col("value"))
    return points.where(hit)


def last_write(points: DataFrame, arrival: Column | str = "arrival", keep: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """One row for each series and timestamp: that which arrived last, with columns ``keep``. Partly aggregated before the shuffle.

    Arrival orders by several columns, so the aggregate's state is one struct, (arrival, value). What the key determines (series_id,
    metric_name) goes into ``by`` and so not into the state.
    """
    order = F.col(arrival) if isinstance(arrival, str) else arrival
    keep = keep or []
    by_order = F.struct(order.alias("__order"), F.col("value"))
    latest = (F.max_by(F.struct("value", *keep), by_order) if keep else F.max(by_order)).alias("__last")
    out = points.groupBy("series_key", *(by or []), "timestamp_ns").agg(latest)
    return out.select("series_key", *(by or []), "timestamp_ns", "__last.*").drop("__order")


def concatenated(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """All rows of both layers, rewritten timestamps included."""
    return hot.unionByName(cold, allowMissingColumns=True)


def buffer_size(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(entries, bytes) of buffered points: 32 bytes for each distinct point, and for each series its names and 8 bytes."""
    by = by or []
    one = points.groupBy(*by, "series_key", "metric_name", F.map_entries("tags").alias("pairs"), "timestamp_ns").agg(F.lit(1).alias("one"))
    series = one.groupBy(*by, "series_key", "metric_name", "pairs").agg(F.count(F.lit(1)).alias("n"))
    names = F.aggregate("pairs", F.lit(0), lambda a, e: a + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    size = 32 * F.col("n") + F.octet_length("metric_name") + names + 8
    return series.groupBy(*by).agg(F.sum("n").alias("entries"), F.sum(size).cast("long").alias("bytes"))


def due_for_flush(sizes: DataFrame, threshold: int, shards: int) -> DataFrame:
    """Shards whose share of the threshold is reached."""
    return sizes.where(F.col("bytes") >= threshold // shards)
