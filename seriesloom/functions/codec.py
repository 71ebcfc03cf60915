"""Delta coding of timestamps, over rows and over arrays. Storage itself is Parquet's delta encoding (see ``PARQUET_OPTIONS``)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Delta-coded timestamps, a bloom filter on the series key (which needs a column without dictionary), page checksums.
PARQUET_OPTIONS = {
    "compression": "lz4_raw",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary#timestamp_ns": "false",
    "parquet.enable.dictionary#series_key": "false",
    "parquet.bloom.filter.enabled#series_key": "true",
    "parquet.page.write-checksum.enabled": "true",
}
#: Reads check every page against its checksum; a damaged one is an error.
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}


def delta(ts: Column, series: str, order: str) -> Column:
    """The first timestamp of a series, then differences. Overflow of 64 bits is an error."""
    w = Window.partitionBy(series).orderBy(order)
    return F.coalesce(ts - F.lag(ts).over(w), ts)


def undelta(d: Column, series: str, order: str) -> Column:
    w = Window.partitionBy(series).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(d).over(w)


def delta_array(values: Column) -> Column:
    """``[x0, x1 - x0, ...]``; an empty array stays empty."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def undelta_array(deltas: Column) -> Column:
    start = F.array().cast("array<bigint>")
    step = lambda acc, d: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + d))
    return F.aggregate(deltas, start, step)
