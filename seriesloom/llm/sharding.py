"""Sharding by sampled splitters, in DataFrame operations alone.

Records are ordered by a key and a tie-breaker. Size-weighted samples of keys give quantile
boundaries; records fall into the ranges between them; ranges that turn out overfull (a key that
holds a third of all rows, or an unlucky sample) are subdivided at samples of (key, tie). Each piece is
then sorted by one task, and exact byte offsets, carried over a small table of piece totals, deal the
records into contiguous shards of near equal bytes.

The number of ranges is no limit on rows: pieces spill like any sort. There are 1024, and beyond 2**30 records one for each
2**20 of them up to ``MOST_RANGES``. Samples are Poisson draws with a stated expected number, 16 a range, so what reaches the driver is bounded
whatever the input.

Defined results: null text has no bytes and the crc of the empty string; a very long text is one record like others, and a shard that
holds it may be as much larger; a null tie sorts first; records that agree in key, tie and size are interchangeable; columns of ``records``
pass through ``assign``, but for its own names shard and slot and those that begin with two underscores; an empty table gives no shards.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import text_of
from seriesloom.plans.scratch import Scratch
from seriesloom.plans.sql import CRC_TABLE, crc32

#: Points of the pseudo-random draw.
UNIT = 1 << 30
MOST_RANGES = 1 << 14


def _draws(weight: Column, total: int, samples: int, *of: str) -> Column:
    """How many times a record is drawn, so that ``samples`` are expected in all: by a hash, so reruns agree."""
    share = weight.cast("double") * samples / max(total, 1)
    luck = F.pmod(F.xxhash64(*of, F.lit("draw")), F.lit(UNIT)) / F.lit(float(UNIT))
    return F.floor(share + luck).cast("int")


def _quantiles(values: list, n: int) -> list:
    """At most n - 1 distinct boundaries that cut the sorted samples into n equal parts."""
    cuts = [values[len(values) * i // n] for i in range(1, n)] if values else []
    return [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]


def _array(values: list[int]) -> Column:
    return F.lit(values) if values else F.array().cast("array<bigint>")


def _table(spark: SparkSession, rows: list[dict], row: str) -> DataFrame:
    """A bounded table of literals."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{row}>>")))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """The number of boundaries up to ``key``, found through a two-level table of them."""
    if not cuts:
        return F.lit(0)
    fan = max(1, int(len(cuts) ** 0.5))
    leaves = [cuts[i : i + fan] for i in range(0, len(cuts), fan)]
    top = F.size(F.filter(_array([x[0] for x in leaves]), lambda c: c <= key))
    table = F.array(*[_array(x) for x in leaves])
    leaf = F.try_element_at(table, F.greatest(top, F.lit(1)))
    return F.when(top == 0, 0).otherwise((top - 1) * fan + F.size(F.filter(leaf, lambda c: c <= key)))


def assign(records: DataFrame, shards: int, scratch: Scratch, ranges: int | None = None, oversample: int = 16) -> DataFrame:
    """Adds shard (0 to shards - 1, contiguous in key order, near equal in bytes) and slot (gapless from 0 in it).

    ``records`` has key BIGINT and size BIGINT (not null), tie BIGINT, and any columns that shall stay. ``ranges`` bounds the first
    boundaries; a piece holds about 1/ranges of the bytes.
    """
    spark = records.sparkSession
    kept = scratch.keep(records.drop("shard", "slot"))
    total, count = kept.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(1, min(ranges or min(MOST_RANGES, max(1024, count >> 20)), count // 16 + 1))
    samples = ranges * oversample

    drawn = kept.select("key", _draws(F.col("size"), total, samples, "key", "tie").alias("n")).where("n > 0")
    keys = drawn.select(F.explode(F.array_repeat("key", F.col("n"))).alias("key")).collect()
    ranged = kept.withColumn("__range", _range_of(F.col("key"), _quantiles(sorted(r["key"] for r in keys), ranges)))

    full = ranged.groupBy("__range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 2 * total // ranges).collect()
    if full:
        want = {r["__range"]: 2 + r["bytes"] * ranges // max(total, 1) for r in full}
        inside = ranged.where(F.col("__range").isin(list(want)))
        of_full = sum(r["bytes"] for r in full)
        drawn = inside.select(
            "__range", "key", F.coalesce("tie", F.lit(-(1 << 63))).alias("tie"), _draws(F.col("size"), of_full, sum(want.values()) * oversample, "tie", "key", "size").alias("n")
        ).where("n > 0")
        points: dict[int, list] = {r: [] for r in want}
        for r in drawn.collect():
            points[r["__range"]] += [(r["key"], r["tie"])] * r["n"]
        cuts = [{"__range": r, "cuts": [{"key": k, "tie": t} for k, t in _quantiles(sorted(p), want[r])]} for r, p in points.items()]
        table = _table(spark, cuts, "__range: int, cuts: array<struct<key: bigint, tie: bigint>>")
        here = F.struct(F.col("key"), F.coalesce("tie", F.lit(-(1 << 63))).alias("tie"))
        ranged = ranged.join(F.broadcast(table), "__range", "left").withColumn(
            "__part", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c <= here)))
        ).drop("cuts")
    else:
        ranged = ranged.withColumn("__part", F.lit(0))

    placed = _deal(scratch.keep(ranged), total, shards, scratch)
    return placed


def _deal(pieces: DataFrame, total: int, shards: int, scratch: Scratch) -> DataFrame:
    """Shard and slot from exact offsets: of the piece, from the table of piece totals, and within it."""
    piece = ["__range", "__part"]
    before = rank = 0
    offsets = []
    for r in sorted(pieces.groupBy(*piece).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()):
        offsets.append({"__range": r["__range"], "__part": r["__part"], "before": before, "rank": rank})
        before, rank = before + r["bytes"], rank + r["rows"]
    offsets = _table(pieces.sparkSession, offsets, "__range: int, __part: int, before: bigint, rank: bigint")
    w = Window.partitionBy(*piece).orderBy("key", "tie", "size")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    dealt = (
        pieces.withColumns({"__within": F.coalesce(F.sum("size").over(upto), F.lit(0)), "__row": F.row_number().over(w) - 1})
        .join(F.broadcast(offsets), piece)
        .withColumns({
            "shard": F.least(F.lit(shards - 1), F.floor((F.col("before") + F.col("__within")).cast("decimal(38,0)") * shards / max(total, 1))).cast("int"),
            "__at": F.col("rank") + F.col("__row"),
        })
    )
    dealt = scratch.keep(dealt.drop(*piece, "before", "rank", "__within", "__row"))
    first = dealt.groupBy("shard").agg(F.min("__at").alias("__first"))  # at most ``shards`` rows
    return dealt.join(F.broadcast(first), "shard").withColumn("slot", F.col("__at") - F.col("__first")).drop("__at", "__first")


def keyed(docs: DataFrame) -> DataFrame:
    """Documents as records: the key is a digest of the text, so that equal texts are neighbours, and doc_id the tie."""
    key = F.conv(F.substring(F.md5(text_of()), 1, 15), 16, 10).cast("long")
    return docs.select(
        "doc_id", F.col("doc_id").alias("tie"), key.alias("key"),
        (F.octet_length(text_of()) + 8).cast("long").alias("size"), F.crc32(text_of()).alias("text_crc32"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = assign(keyed(docs), 24, Scratch(spark, "op8"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


OP8_SQL = f"""
WITH {CRC_TABLE},
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, coalesce(text, '') AS t,
    CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
o AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS HUGEINT) AS before,
    CAST(sum(size) OVER () AS HUGEINT) AS total,
    row_number() OVER (ORDER BY key, doc_id NULLS FIRST, size) AS pos FROM d),
s AS (SELECT *, CAST(least(23, before * 24 // total) AS INTEGER) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST({crc32("s.t", "c.t")} AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  CAST(pos - min(pos) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s, crc_table c
"""
