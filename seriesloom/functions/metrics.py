"""Aggregates for measurements: nearest-rank percentiles, cumulative histograms, rates, counters and gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.plans.scratch import Scratch

#: Bucket bounds of the engine's histograms, in seconds, and of chunk counts.
APPEND_BUCKETS = [0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1]
FLUSH_BUCKETS = [0.01, 0.05, 0.1, 0.5, 1.0, 5.0]
QUERY_BUCKETS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0]
CHUNK_BUCKETS = [0.0, 1.0, 5.0, 10.0, 50.0, 100.0, 500.0]
#: Ranks by which the sketch may be off, as a share of the rows, the margins left on either side, and the ranks that a margin must span besides.
ACCURACY, MARGINS, RANKS = 10_000, (0.0005, 0.005, 0.05), 3
#: Groups up to which their brackets are broadcast.
BROADCAST_GROUPS = 100_000


def nearest_rank(df: DataFrame, group: str, value: str, percentiles: list[float]) -> DataFrame:
    """(group, p, result): the value at index floor((n - 1) * p) of the sorted values, exactly.

    A quantile sketch brackets each result first, so that only the distinct values between the brackets are sorted, whatever the
    size of the group. Its ranks count from p * n, so a bracket takes the least margin that spans some ranks besides the
    sketch's error; groups too small for any are sorted whole.
    """
    probes = [x for p in percentiles for m in MARGINS for x in (max(0.0, p - m), min(1.0, p + m))]
    frame = df.select(F.col(group).alias("g"), F.col(value).alias("v")).where("v is not null")
    ends = frame.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", probes, ACCURACY).alias("at"), F.min("v").alias("least"), F.max("v").alias("most"))

    def end(whole: str, first: int) -> Column:
        at = F.col(whole)
        for k, m in reversed(list(enumerate(MARGINS))):
            at = F.when(F.col("n") * (m - 1 / ACCURACY) >= RANKS, F.get("at", F.lit(first + 2 * k))).otherwise(at)
        return at

    step = 2 * len(MARGINS)
    each = range(len(percentiles))
    lo, hi = [end("least", step * i).alias(f"lo{i}") for i in each], [end("most", step * i + 1).alias(f"hi{i}") for i in each]
    scratch = Scratch(df.sparkSession, "percentiles")
    brackets = scratch.keep(ends.select(F.col("g").alias("k"), "n", *lo, *hi))
    hit = frame.join(F.broadcast(brackets) if brackets.count() <= BROADCAST_GROUPS else brackets, F.col("g") == F.col("k")).drop("k")
    # rows below a bracket are only counted, before the shuffle; what lies in one is shuffled as distinct values with their counts
    below = hit.groupBy("g").agg(F.min("n").alias("n"), *[F.sum((F.col("v") < F.col(f"lo{i}")).cast("long")).alias(f"below{i}") for i in each])
    probed = [F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), F.floor((F.col("n") - 1) * F.lit(float(p))).alias("rank"), F.col(f"below{i}").alias("below")) for i, p in enumerate(percentiles)]
    inside = F.filter(F.array(*[F.when((F.col("v") >= F.col(f"lo{i}")) & (F.col("v") <= F.col(f"hi{i}")), F.lit(i)) for i in each]), lambda i: i.isNotNull())
    counts = hit.select("g", "v", F.explode(inside).alias("i")).groupBy("g", "i", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("g", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("c").over(w)).join(below.select("g", F.inline(F.array(*probed))), ["g", "i"])
    found = upto.where(F.col("below") + F.col("upto") > F.col("rank")).groupBy("g", "p").agg(F.min("v").alias("result"))
    return found.withColumnRenamed("g", group)


def histogram(df: DataFrame, group: str, value: str, bounds: list[float]) -> DataFrame:
    """(group, le, n): rows at or below each bound; one aggregation, no join."""
    sums = [F.sum(F.when((F.col(value) <= b) & ~F.isnan(value), 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").cast("long").alias("n")) for i, b in enumerate(bounds)])
    return df.groupBy(group).agg(*sums).select(group, F.inline(pairs))


def rate(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count / seconds).otherwise(F.lit(0.0))


def counters(events: DataFrame, label: str) -> DataFrame:
    """(label, total): how often each label was counted."""
    return events.groupBy(label).agg(F.count(F.lit(1)).alias("total"))


def gauges(events: DataFrame, label: str, order: str, value: str) -> DataFrame:
    """(label, last): each label's last value."""
    return events.groupBy(label).agg(F.max_by(value, order).alias("last"))
