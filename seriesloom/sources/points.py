"""Points from tables: each adapter gives (metric_name, tags, timestamp_ns, value) and what orders their arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.identity import key_of

POINT = T.StructType([
    T.StructField("metric_name", T.StringType(), False),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType(), False), False),
    T.StructField("timestamp_ns", T.LongType(), False),
    T.StructField("value", T.DoubleType(), False),
])


def to_ns(ts: Column) -> Column:
    """Nanoseconds of a timestamp without zone, read as UTC (the session's time zone must be UTC)."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def tag_map(**tags: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in sorted(tags)]), F.array(*[tags[k].cast("string") for k in sorted(tags)]))


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem.extendedprice`` by line status and return flag; timestamps repeat, so the last write matters."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("value"))
    metric, tags = F.lit("lineitem.extendedprice"), {"linestatus": F.col("l_linestatus"), "returnflag": F.col("l_returnflag")}
    return li.select(
        metric.alias("metric_name"), tag_map(**tags).alias("tags"), to_ns(F.col("l_shipdate")).alias("timestamp_ns"),
        F.col("l_extendedprice").alias("value"), order.alias("arrival"), key_of(metric, tags).alias("series_key"),
    )


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events.<type>`` by user, in order of event_id."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    metric, tags = F.concat(F.lit("events."), "event_type"), {"user_id": F.col("user_id")}
    return ev.select(
        metric.alias("metric_name"), tag_map(**tags).alias("tags"), to_ns(F.col("ts")).alias("timestamp_ns"), "value",
        F.col("event_id").alias("arrival"), key_of(metric, tags).alias("series_key"),
    )


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders.totalprice`` by priority and status, in order of the order key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    metric, tags = F.lit("orders.totalprice"), {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")}
    return o.select(
        metric.alias("metric_name"), tag_map(**tags).alias("tags"), to_ns(F.col("o_orderdate")).alias("timestamp_ns"),
        F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("arrival"), key_of(metric, tags).alias("series_key"),
    )


#: The load generator's vocabulary.
METRICS = ["cpu.load", "mem.used_bytes", "disk.io_bytes", "net.rx_bytes", "gc.pause_ms"]
REGIONS = ["us-east-1", "eu-west-1", "ap-southeast-1"]
SERVICES = ["api", "cache", "queue", "storage", "auth"]

#: Least points of a generated partition, if there are several.
PART_POINTS = 50_000


def synthetic(spark: SparkSession, points: int, series: int = 100_000, start_ns: int = 0, seed: int = 42) -> DataFrame:
    """Load-generator points: ``series`` label sets over the vocabulary, times from ``start_ns`` on, values in [0, 100)."""
    s = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(series))
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (F.pmod(by, F.lit(len(words))) + 1).cast("int"))
    parts = max(1, min(spark.sparkContext.defaultParallelism, points // PART_POINTS))
    rows = spark.range(0, points, 1, parts).withColumn("s", s)
    return rows.select(
        pick(METRICS, F.col("s")).alias("metric_name"),
        tag_map(host=F.concat(F.lit("host-"), F.col("s").cast("string")), region=pick(REGIONS, F.floor(F.col("s") / 5)), service=pick(SERVICES, F.floor(F.col("s") / 15))).alias("tags"),
        (F.lit(start_ns) + F.col("id")).alias("timestamp_ns"),
        (F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1_000_000)) / 10_000.0).alias("value"),
    )
