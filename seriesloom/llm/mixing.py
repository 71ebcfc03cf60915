"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled (by a hash, so reruns agree) and laid end to end; the line of words is
cut into blocks of equal length. Slots 0, 1, 2, ... of the mix get golden-ratio points, in integers; a point falls
into one source's part of the cumulative targets. A slot's rank among its source's slots, modulo the
source's blocks, names the block it takes, so a source that is wanted twice over is read twice over and no
document more often than the cap. The last slot of a source is cut, so that its target is met to the word.

Positions in a source are two-level prefix sums: within hash buckets, and over the buckets' totals. A source
that holds a third of all rows is therefore spread over many tasks. The only thing gathered is one row per source (name, words,
rows), of at most ``most_sources``; a table with more is an error, not a cut, as the schedule is a table of cumulative targets on the driver.

Defined results: null and empty texts have no words and are taken 0 times (``mixed`` keeps them once, as they
weigh nothing); null sources are one source, last; a null doc_id is a document of its own; repeated rows are
separate documents; equal shuffle keys go by doc_id, then by the text's digest; very long texts count whole and are cut between blocks; an
empty table gives an empty mix; extra columns pass through ``mixed``, unless their names begin with two underscores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import once, text_of, word_count
from seriesloom.llm.sharding import _range_of
from seriesloom.plans.scratch import Scratch

#: The period of the points, and the odd number nearest to it over the golden ratio.
PERIOD = 1 << 31
GOLDEN = 1327217885


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    weight: float
    target: float


def water_fill(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> list[Source]:
    """Targets by weight that add up to all sizes, none above ``cap`` times its source's size."""
    named = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(named))]
    total, target, free = sum(s for _, s in named), [0.0] * len(named), set(range(len(named)))
    while free:
        left = total - sum(target[i] for i in range(len(named)) if i not in free)
        share = left / sum(weight[i] for i in free)
        over = {i for i in free if weight[i] * share > cap * named[i][1]}
        for i in over or free:
            target[i] = float(cap * named[i][1]) if over else weight[i] * share
        free = free - over if over else set()
    return [Source(n, s, w, t) for (n, s), w, t in zip(named, weight, target, strict=True)]


class Mix:
    """A schedule over ``docs``: ``lines`` places documents, ``pieces`` cuts them into blocks, ``slots`` takes blocks."""

    def __init__(self, docs: DataFrame, scratch: Scratch, block: int = 256, seed: int = 0, bucket_rows: int = 1000, chunk: int = 65_536, most_sources: int = 100_000, most_bits: int = 24):
        self.spark, self.block = docs.sparkSession, block
        order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(str(seed))))
        rows = scratch.keep(
            docs.select(
                "source", "doc_id", F.md5(text_of()).alias("digest"), word_count(text_of()).alias("size"),
                F.conv(F.substring(order, 1, 15), 16, 10).cast("long").alias("key"),
            )
        )
        totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(most_sources + 1).collect()
        if len(totals) > most_sources:
            raise ValueError(f"more than {most_sources} sources")
        self.sources = water_fill([(r["source"], r["size"]) for r in totals])
        # about ``bucket_rows`` rows a bucket; beyond 2 ** ``most_bits`` buckets, whose totals a source's task adds up, they grow, sort and spill
        bits = min(most_bits, (sum(r["n"] for r in totals) // bucket_rows).bit_length())
        names = {s.name: i for i, s in enumerate(self.sources)}
        known = self.spark.createDataFrame([(k, v) for k, v in names.items()], "name string, s int")
        self.lines = scratch.keep(self._lay_out(rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name"))).drop("name"), bits))
        self.slots = scratch.keep(self._schedule(chunk))

    def _of(self, values: list, kind: str, s: str | Column = "s") -> Column:
        return F.element_at(F.lit(values or [0]).cast(f"array<{kind}>"), (F.col(s) if isinstance(s, str) else s) + 1)

    def of_source(self, what: str, kind: str) -> Column:
        return self._of([getattr(x, what) for x in self.sources], kind)

    def _lay_out(self, rows: DataFrame, bits: int) -> DataFrame:
        """Adds ``at``: the words of the same source before the document."""
        rows = rows.withColumn("bucket", F.shiftrightunsigned("key", 60 - bits) if bits else F.lit(0).cast("long"))
        before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = rows.groupBy("s", "bucket").agg(F.sum("size").alias("words")).select(
            "s", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")
        )
        within = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
        placed = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(buckets, ["s", "bucket"])
        return placed.select("s", "source", "doc_id", "digest", "size", (F.col("base") + F.col("within")).alias("at"))

    def _schedule(self, chunk: int) -> DataFrame:
        """(slot, s, epoch, block, words): what each slot takes; slots past a source's quota go to no one."""
        b = self.block
        quota = [min(int(x.target + 0.5), 3 * x.size) for x in self.sources]
        blocks = [-(-x.size // b) for x in self.sources]
        need = [q // x.size * n + -(-(q % x.size) // b) if x.size else 0 for q, x, n in zip(quota, self.sources, blocks, strict=True)]
        slots, upto, cuts = sum(need), 0, []
        for n in need[:-1]:
            upto += n
            cuts.append(round(PERIOD * upto / max(slots, 1)))
        i = F.col("slot")
        point = F.pmod(F.pmod(i, F.lit(PERIOD)) * GOLDEN, F.lit(PERIOD))
        drawn = self.spark.range(slots).withColumnRenamed("id", "slot").withColumns({"s": _range_of(point, cuts), "chunk": F.floor(i / chunk)})
        earlier = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        counts = drawn.groupBy("s", "chunk").agg(F.count(F.lit(1)).alias("n"))
        base = counts.select("s", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
        ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1).join(base, ["s", "chunk"])
        ranked = ranked.select("slot", "s", (F.col("base") + F.col("r")).alias("rank"))
        got = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}
        short = [(s, got.get(s, 0), n) for s, n in enumerate(need) if got.get(s, 0) < n]  # by the schedule's discrepancy, a few
        late = self.spark.createDataFrame(short, "s int, lo bigint, hi bigint").select("s", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("rank"))
        late = late.select((F.lit(slots) + F.col("s") + F.col("rank") * len(need)).alias("slot"), "s", "rank")
        size, per = self._of([x.size for x in self.sources], "bigint"), self._of(blocks, "bigint")
        epoch, block = F.floor(F.col("rank") / per), F.col("rank") % per
        return (
            ranked.where(F.col("rank") < self._of(need, "bigint")).unionByName(late)
            .select("slot", "s", epoch.alias("epoch"), block.alias("block"))
            .withColumn("words", F.least(F.lit(b), size - F.col("block") * b, self._of(quota, "bigint") - F.col("epoch") * size - F.col("block") * b))
        )

    def pieces(self) -> DataFrame:
        """(s, block, at, start, length, offset): the part of the document at ``at`` that lies in a block."""
        b, at, size = self.block, F.col("at"), F.col("size")
        cut = self.lines.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(at / b), F.floor((at + size - 1) / b))))
        lo, hi = F.greatest(at, F.col("block") * b), F.least(at + size, (F.col("block") + 1) * b)
        return cut.select("s", "block", "at", (lo - at).alias("start"), (hi - lo).alias("length"), (lo - F.col("block") * b).alias("offset"))

    def stream(self) -> DataFrame:
        """The mix in order of ``slot`` and ``offset``: words [start, start + taken) of the document at (s, at)."""
        taken = F.least(F.col("length"), F.col("words") - F.col("offset"))
        return self.pieces().join(self.slots, ["s", "block"]).withColumn("taken", taken).where("taken > 0")

    def taken(self) -> DataFrame:
        """A row for each document with the words that the mix takes of it, and how often it takes its first word."""
        first = F.sum(F.when(F.col("start") == 0, 1).otherwise(0))
        sums = self.stream().groupBy("s", "at").agg(F.sum("taken").alias("taken"), first.alias("starts"))
        full = self.lines.where("size > 0").join(sums, ["s", "at"], "left")
        empty = self.lines.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "starts": F.lit(1).cast("long")})
        return full.fillna(0, ["taken", "starts"]).unionByName(empty)


def mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """Whole documents of the mix: each as often as the schedule takes its first word."""
    keys = ["source", "doc_id", "digest"]
    counts = mix.taken().groupBy(*keys).agg(F.sum("starts").alias("__times"), F.count(F.lit(1)).alias("__copies")).where("__times > 0")
    counts = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), "__times", "__copies")
    own = docs.withColumn("__digest", F.md5(text_of()))
    counts = counts.withColumnRenamed("__digest", "__of")
    same = (F.col("__digest") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source"))
    hit = own.join(counts, same)
    rows = once(hit, "__copies", ["source", "doc_id", "__digest"])
    return rows.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mix = Mix(docs, Scratch(spark, "op2"))
    return mix.taken().select(
        "doc_id", "size", mix.of_source("size", "bigint").alias("source_size"), mix.of_source("target", "double").alias("target"), "taken"
    )


#: The schedule takes blocks 0, 1, 2, ... of a source in turn, so what it takes of a document follows from its place and the quota.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS digest,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':0'), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () - (sum(3 * source_size) OVER w - 3 * source_size))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER w - weight))::DOUBLE AS share
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * (SELECT max(share) FROM l)) AS target FROM l),
q AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS quota FROM t),
p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, digest ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE CAST(quota // source_size * size + greatest(0, least(before + size, quota % source_size) - before) AS BIGINT) END AS taken
FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source
"""
