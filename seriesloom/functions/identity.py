"""Series identity: canonical keys, 64-bit ids and shards, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sorted_tags(tags: Column) -> Column:
    """The tag map with its keys in byte order."""
    return F.map_from_entries(F.sort_array(F.map_entries(tags)))


def series_key(metric: Column, tags: Column) -> Column:
    """``metric,k1=v1,k2=v2`` with keys in byte order; a metric without tags is its own key."""
    pairs = F.transform(F.sort_array(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws(",", metric, pairs)


def key_of(metric: Column, tags: dict[str, Column]) -> Column:
    """The same key where the tags' names are known beforehand: a plain concatenation, without a map for each row."""
    pairs = [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in sorted(tags.items(), key=lambda t: t[0].encode())]
    return F.concat_ws(",", metric, *pairs)


def key_has(key: Column, wanted: dict[str, str]) -> Column:
    """Whether a key's tags hold all of these pairs. Names and values hold no comma, so each pair is a whole part of the key."""
    out = F.lit(True)
    for k, v in sorted(wanted.items()):
        out = out & (F.lit(False) if "," in f"{k}{v}" or "=" in k else F.concat(key, F.lit(",")).contains(f",{k}={v},"))
    return out


def key_metric(key: Column) -> Column:
    return F.substring_index(key, ",", 1)


def key_tags(key: Column) -> Column:
    """The tags of a key; a part without ``=`` is an error."""
    rest = F.substring(key, F.length(key_metric(key)) + 2, F.length(key))
    parts = F.when(F.length(key) > F.length(key_metric(key)), F.split(rest, ",")).otherwise(F.array().cast("array<string>"))
    split = lambda p: F.struct(
        F.substring_index(p, "=", 1).alias("key"), F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p)).alias("value")
    )
    checked = F.transform(parts, lambda p: F.when(~p.contains("="), F.raise_error(F.concat(F.lit("tag without '=': "), p)).cast("string")).otherwise(p))
    return F.map_from_entries(F.transform(checked, split))


def series_id(key: Column) -> Column:
    """XXH64 of the key's bytes with seed 0, as a signed long.

    The JVM's own expression takes the seed; sessions without a local JVM use :func:`with_series_id`.
    """
    from pyspark.sql.classic.column import Column as JvmColumn
    from pyspark.sql.classic.column import _to_seq

    sc = SparkSession.active().sparkContext
    utils = sc._jvm.org.apache.spark.sql.classic.ExpressionUtils
    hashed = sc._jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(_to_seq(sc, [utils.expression(key._jc)]), 0)
    return JvmColumn(utils.column(hashed))


def with_series_id(df: DataFrame) -> DataFrame:
    """Adds series_id by hashing distinct keys in Arrow batches: the portable form of :func:`series_id`."""
    import xxhash

    @F.pandas_udf("bigint")
    def hashed(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in keys:
            yield k.map(lambda s: (h := xxhash.xxh64_intdigest(s.encode(), seed=0)) - (1 << 64 if h >> 63 else 0)).astype("int64")

    ids = df.select("series_key").distinct().withColumn("series_id", hashed("series_key"))
    return df.join(ids, "series_key")


def unsigned(id_: Column) -> Column:
    """An id as it is shown, DECIMAL(20, 0)."""
    d = id_.cast("decimal(20,0)")
    return F.when(id_ < 0, (d + F.lit("18446744073709551616").cast("decimal(20,0)"))).otherwise(d).cast("decimal(20,0)")


def shard(id_: Column, shards: int) -> Column:
    """The low bits of the id; ``shards`` is a power of two."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    return id_.bitwiseAND(shards - 1)
