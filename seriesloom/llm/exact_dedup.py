"""Exact de-duplication against a persistent digest index.

The index is a Parquet table, bucketed and sorted by digest. A batch is reduced to one row per digest
(map-side first, so a group that holds a third of all rows shrinks before the shuffle), the digests
that the index lacks come from a sort-merge anti-join on the buckets, and are appended to it.

Every digest is kept with the id of the batch that brought it. What an earlier run of the same batch put
into the index does not count as known, so a batch that is run again, because its driver was lost
between the append and the end of the work, gives the same result. The number of buckets is stored
beside the index, and opening it with another is an error. An append adds a file to each bucket; beyond ``max_files``
of them the index is merged into a new generation of one sorted file a bucket, as which the anti-join reads it without
sorting it again (more files a bucket are sorted anew, and only their shuffle is saved).

Defined results: null text counts as empty; a null doc_id sorts after all others; rows that agree in
doc_id, text length and digest are copies of one row, of which one is kept; texts of any length are reduced to
their digest by the JVM, in memory for a few times one text; an empty table gives an empty result; extra columns
pass through ``dedup`` unchanged, unless their names begin with two underscores.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import SPACES, once, text_of
from seriesloom.plans.manifest import CommitConflict, Files
from seriesloom.plans.scratch import Scratch, remove, shared_dir

ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def normalised(text: str | Column = "text") -> Column:
    """The text without white space."""
    return F.translate(text_of(text), SPACES, "")


class DigestIndex:
    """Digests seen so far with the row that stands for each: (digest, keep_id, keep_length, batch).

    Generation n lies in ``<path>/g<n>``; ``<path>/generation-<n>.json`` makes it the valid one. One writer at a time.
    """

    SCHEMA = "digest BINARY, keep_id BIGINT, keep_length INT, batch STRING"
    COLUMNS = ("digest", "keep_id", "keep_length", "batch")

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, max_files: int = 8):
        """Opens the index at ``path``, or starts one there with as many ``buckets`` (by default, the shuffle partitions)."""
        self.spark, self.max_files = spark, max_files
        self.path = path or f"{shared_dir(spark)}/seriesloom/digests-{uuid.uuid4().hex}"
        self.files = Files(spark, self.path)
        found = self._generations()
        if not found:
            self._announce(0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
            found = self._generations()
        self.generation = found[-1]
        self.buckets = json.loads(self.files.read(self._pointer(self.generation)))["buckets"]
        if buckets not in (None, self.buckets):
            raise ValueError(f"the index at {self.path} has {self.buckets} buckets, not {buckets}")
        self.table = self._attach(self.generation)

    def _pointer(self, generation: int) -> str:
        return f"{self.path}/generation-{generation}.json"

    def _folder(self, generation: int) -> str:
        return f"{self.path}/g{generation}"

    def _generations(self) -> list[int]:
        names = [n for n in self.files.names(self.path) if n.startswith("generation-") and n.endswith(".json")]
        return sorted(int(n[len("generation-") : -len(".json")]) for n in names)

    def _announce(self, generation: int, buckets: int) -> None:
        try:
            self.files.create(self._pointer(generation), json.dumps({"buckets": buckets}))
        except CommitConflict:
            if generation:
                raise

    def _attach(self, generation: int) -> str:
        table = f"seriesloom_digests_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {table} ({self.SCHEMA}) USING parquet OPTIONS (path '{self._folder(generation)}') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )
        return table

    def _write(self, rows: DataFrame, table: str, generation: int) -> None:
        (
            rows.select(*self.COLUMNS).repartition(self.buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self._folder(generation)).saveAsTable(table)
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def missing(self, digests: DataFrame) -> DataFrame:
        """Rows of ``digests`` (one per digest) that the index lacks."""
        return digests.repartition(self.buckets, "digest").join(self.read().hint("merge"), "digest", "left_anti")

    @contextmanager
    def in_order(self):
        """Plans made in the block use the order in which buckets of one file are stored."""
        was = self.spark.conf.get(ORDERED)
        self.spark.conf.set(ORDERED, str(self.files_a_bucket() <= 1).lower())
        try:
            yield
        finally:
            self.spark.conf.set(ORDERED, was)

    def files_a_bucket(self) -> int:
        """The most files that a bucket may have: those of all, shared among the buckets, rounded up."""
        n = sum(name.endswith(".parquet") for name in self.files.names(self._folder(self.generation)))
        return -(-n // self.buckets)

    def append(self, fresh: DataFrame) -> None:
        """Adds digests, which the index must lack."""
        self._write(fresh, self.table, self.generation)
        if self.files_a_bucket() > self.max_files:
            self.merge()

    def merge(self) -> None:
        """Rewrites the index as one sorted file a bucket: a new generation, valid when it is written."""
        new, old = self.generation + 1, self.generation
        remove(self.spark, self._folder(new))  # left by a merge that did not end
        table = self._attach(new)
        # read as plain files: the planner takes a bucketed scan for dealt already and then cuts it up
        self._write(self.spark.read.schema(self.SCHEMA).parquet(self._folder(old)), table, new)
        self._announce(new, self.buckets)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.table, self.generation = table, new
        remove(self.spark, self._folder(old))
        self.files.delete(self._pointer(old))

    def close(self, delete: bool = False) -> None:
        """Lets go of the index; with ``delete`` it is gone for good."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if delete:
            remove(self.spark, self.path)

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *error) -> None:
        self.close()


def _with_digest(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {"__digest": F.unhex(F.sha2(normalised(), 256)), "__length": F.length(text_of())}
    )


def verdicts(docs: DataFrame, index: DigestIndex, batch: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): each row's digest, and for each digest of the batch the row that stays.

    ``groups`` has keep_id and keep_length from the index (an older batch wins over this one),
    group_size (rows of this batch), copies (rows of this batch equal to the one that stays) and
    fresh (no other batch brought the digest). The batch's digests are in the index afterwards, under its id.
    """
    rows = scratch.keep(
        _with_digest(docs).select("doc_id", F.col("__digest").alias("digest"), F.col("__length").alias("length"))
    )
    same = rows.groupBy("digest", "length", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("length")).alias("l"), F.col("doc_id").isNull().alias("none"), "doc_id", "n"))
    own = scratch.keep(
        same.groupBy("digest").agg(best.alias("b"), F.sum("n").alias("group_size")).select(
            "digest", F.col("b.doc_id").alias("keep_id"), (-F.col("b.l")).alias("keep_length"), "group_size", F.col("b.n").alias("copies")
        )
    )
    with index.in_order():
        fresh = scratch.keep(index.missing(own))
    index.append(fresh.withColumn("batch", F.lit(batch)))
    with index.in_order():
        groups = scratch.keep(own.select("digest", "group_size", "copies").join(index.read(), "digest").withColumn("fresh", F.col("batch") == batch).drop("batch"))
    scratch.drop(own, fresh)
    return rows, groups


def dedup(docs: DataFrame, index: DigestIndex, batch: str, scratch: Scratch) -> DataFrame:
    """``docs`` without rows whose text another batch has, or stays in a better row of this batch.

    ``batch`` names the batch: the same name again means the same rows again, which then give the same result.
    """
    _, groups = verdicts(docs, index, batch, scratch)
    stay = groups.where("fresh").select(
        F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep_id"), F.col("keep_length").alias("__length"), F.col("copies").alias("__copies")
    )
    hit = _with_digest(docs).join(stay, ["__digest", "__length"]).where(F.col("doc_id").eqNullSafe(F.col("__keep_id")))
    return once(hit, "__copies", ["__digest"]).select(*docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with the row that stays for its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, index = Scratch(spark, "op10"), DigestIndex(spark)
    rows, groups = verdicts(docs, index, "documents", scratch)
    index.close(delete=True)
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))
    placed = rows.join(groups, "digest").withColumn("kept", best)
    # of copies of the row that stays the first keeps; how many there are is known, so they need not be read again
    several = F.col("kept") & (F.col("copies") > 1)
    again = groups.where("copies > 1").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    again = again.withColumns({"doc_id": F.col("keep_id"), "kept": F.col("nth") == 1})
    names = ["doc_id", "keep_id", "group_size", "kept", "digest"]
    return placed.where(~several).select(*names).unionByName(again.select(*names)).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""
