"""A store of points: append, flush, query, compact, snapshot, vacuum.

An append writes its batch once, as a segment of the log, and commits it; readers see it from then on. When the log holds enough, a flush
sorts it into a chunk (Parquet, partitioned by metric, range-partitioned and sorted by series and time) with the statistics of its
series beside it. A query resolves tags to series, prunes chunks by those statistics, reads only what is left of them and the log's
segments, and keeps the last write of each timestamp. Tags are part of the series key and are kept once a series, not in the points.

Any number of writers may append, flush and compact one store: every folder has a name of its own, and commits that lose a race are
tried again on what the winner left.
"""

from __future__ import annotations

import os
import threading
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.codec import PARQUET_OPTIONS, VERIFIED
from seriesloom.functions.exposition import Meter
from seriesloom.functions.identity import key_has, key_tags, series_id, series_key, shard
from seriesloom.functions.metrics import APPEND_BUCKETS, CHUNK_BUCKETS, FLUSH_BUCKETS, QUERY_BUCKETS
from seriesloom.functions.predicates import ValuePredicate, has_tags
from seriesloom.operators.compaction import check_ratio, tiers
from seriesloom.operators.index import chunk_stats, file_bounds, postings, prune
from seriesloom.operators.points import concatenated, last_write, select_points
from seriesloom.plans.manifest import Chunk, Manifest, ManifestLog, Segment
from seriesloom.plans.scratch import small_table

POINTS = "series_key STRING, series_id BIGINT, timestamp_ns BIGINT, value DOUBLE, commit_pos BIGINT"
#: A segment's sequence is given by its commit, so its rows have none.
LOGGED = f"{POINTS}, metric_name STRING"
STORED = f"{POINTS}, commit_seq BIGINT, metric_name STRING"
STATS = (
    "chunk_id BIGINT, series_key STRING, series_id BIGINT, metric_name STRING, tags MAP<STRING, STRING>, time_start_ns BIGINT, time_end_ns BIGINT, entry_count BIGINT, min_value DOUBLE, max_value DOUBLE"
)


def names_of(schema: str) -> list[str]:
    return T.StructType.fromDDL(schema).fieldNames()


#: Series up to which a query names their keys in the scan's filter; beyond, it joins.
KEYS_IN_FILTER = 500
#: Bytes that a buffered point counts for.
POINT_BYTES = 32
ARRIVAL = ("commit_seq", "commit_pos", "value")


@dataclass(frozen=True)
class EngineConfig:
    """Settings; ``from_env`` reads SERIESLOOM_<NAME> and falls back to the default on what it can't parse.

    ``flush_threshold_bytes`` (32 a point) or ``max_segments`` in the log lead to a flush. Fixed values: the defaults of the first four.
    """

    base: str = "seriesloom-store"
    num_shards: int = 16
    flush_threshold_bytes: int = 32 << 20
    compaction_threshold: int = 4
    compaction_ratio: float = 1.5
    rows_per_file: int = 5_000_000
    max_segments: int = 256

    def __post_init__(self):
        if self.num_shards < 1 or self.num_shards & (self.num_shards - 1):
            raise ValueError("num_shards must be a power of two")
        check_ratio(self.compaction_ratio)

    @classmethod
    def from_env(cls) -> EngineConfig:
        found = {}
        for f in fields(cls):
            try:
                found[f.name] = type(f.default)(os.environ[f"SERIESLOOM_{f.name.upper()}"])
            except (KeyError, ValueError):
                continue
        return cls(**found)


class UnknownCheckpoint(ValueError):
    """A stream of a known name comes with another checkpoint, whose batch numbers mean other data."""


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig | str):
        self.spark = spark
        self.config = EngineConfig(base=config) if isinstance(config, str) else config
        self.base = self.config.base.rstrip("/")
        self.log = ManifestLog(spark, self.base)
        self.meter = Meter()
        self._flushing = threading.Lock()

    # -- writing ---------------------------------------------------------------------------------------------------

    def append(self, points: DataFrame, stream: str | None = None, batch: int | None = None, checkpoint: str = "", flush: bool | None = None) -> int:
        """Commits a batch durably and returns its sequence; an empty batch commits nothing and returns 0.

        ``points`` has metric_name, tags, timestamp_ns, value, and may have commit_pos, the order within the batch (else a later
        row of equal time wins by value). A batch of a stream that is committed already is skipped, so a rerun adds nothing; a stream's
        name belongs to the checkpoint that it first came with. ``flush`` forces or forbids a flush; by default the log's size decides.
        """
        with self.meter.timed("append", APPEND_BUCKETS):
            if stream is not None and self._committed(self.log.load(), stream, batch, checkpoint):
                return self.log.load().last_commit_seq
            name = f"s{uuid.uuid4().hex}"
            path = f"{self.base}/log/segment={name}"
            rows = self._logged(points, path)
            done = [0]

            def change(m: Manifest) -> Manifest | None:
                streams = m.streams
                if stream is not None:
                    if self._committed(m, stream, batch, checkpoint):
                        done[0] = m.last_commit_seq
                        return None
                    streams = streams | {stream: {"batch": batch, "checkpoint": checkpoint}}
                if rows == 0:
                    return m.next(streams=streams) if streams != m.streams else None
                done[0] = m.last_commit_seq + 1
                return m.next(last_commit_seq=done[0], segments=(*m.segments, Segment(name, path, rows, done[0])), streams=streams)

            committed = self.log.update(change)
            if committed is None or rows == 0:
                self.log.files.delete(path)
            else:
                self.meter.count("points_appended_total", rows)
        if flush or (flush is None and committed is not None and self._due(committed)):
            self.flush()
        return done[0]

    @staticmethod
    def _committed(m: Manifest, stream: str, batch: int, checkpoint: str) -> bool:
        known = m.streams.get(stream)
        if known is None:
            return False
        if known["checkpoint"] != checkpoint:
            raise UnknownCheckpoint(f"stream {stream!r} belongs to checkpoint {known['checkpoint']!r}, not {checkpoint!r}")
        return known["batch"] >= batch

    def _due(self, m: Manifest) -> bool:
        return len(m.segments) > 0 and (sum(s.rows for s in m.segments) * POINT_BYTES >= self.config.flush_threshold_bytes or len(m.segments) >= self.config.max_segments)

    def _logged(self, points: DataFrame, path: str) -> int:
        name, key = F.col("metric_name"), F.col("__key")
        pos = F.col("commit_pos") if "commit_pos" in points.columns else F.lit(0)
        rows = points.withColumn("__key", series_key(name, F.col("tags")))
        # what is not allowed shows in the whole key: as many commas as tags, and no "=" in the tags' names
        bad = (F.coalesce(name, F.lit("")) == "") | name.contains(",")
        odd = (F.length(key) - F.length(F.replace(key, F.lit(","), F.lit(""))) != F.size("tags")) | F.array_join(F.map_keys("tags"), "").contains("=")
        checked = F.when(bad, F.raise_error("a metric needs a name without ','").cast("string")).when(odd, F.raise_error("tags may not hold ',' nor their keys '='").cast("string")).otherwise(key)
        out = rows.select(
            name.alias("metric_name"), checked.alias("series_key"), F.col("timestamp_ns").cast("long").alias("timestamp_ns"),
            F.col("value").cast("double").alias("value"), pos.cast("long").alias("commit_pos"),
        ).withColumn("series_id", series_id(F.col("series_key")))
        write = out.select(*names_of(LOGGED)).write.option("compression", "lz4_raw").option("parquet.page.write-checksum.enabled", "true")
        write.option("maxRecordsPerFile", self.config.rows_per_file).parquet(path)
        return self.spark.read.schema(LOGGED).parquet(path).count()  # from the files' footers

    def flush(self) -> int:
        """Sorts the log's segments into a chunk and returns how many went; 0 if there are none or another thread is at it."""
        if not self._flushing.acquire(blocking=False):
            return 0
        try:
            with self.meter.timed("flush", FLUSH_BUCKETS):
                m = self.log.load()
                if not m.segments:
                    return 0
                gone = {s.name for s in m.segments}
                chunk = self._write(self._scan_log(m.segments), max(s.commit_seq for s in m.segments))

                def change(now: Manifest) -> Manifest | None:
                    if not gone <= {s.name for s in now.segments}:
                        return None  # another writer has flushed them
                    left = tuple(s for s in now.segments if s.name not in gone)
                    return now.next(segments=left, chunks=(*now.chunks, chunk), flushed_seq=max(now.flushed_seq, chunk.commit_seq))

                if self.log.update(change) is None:
                    self._discard(chunk)
                    return 0
                return len(gone)
        finally:
            self._flushing.release()

    def _write(self, rows: DataFrame, seq: int) -> Chunk:
        """Writes a chunk into folders of its own; the statistics are one aggregation over what was written."""
        chunk_id = uuid.uuid4().int >> 66
        path, stats_path = f"{self.base}/points/chunk={chunk_id}", f"{self.base}/stats/chunk={chunk_id}"
        order = ["metric_name", "series_key", "timestamp_ns"]
        laid = rows.select(*names_of(STORED)).repartitionByRange(*order).sortWithinPartitions(*order)
        laid.write.options(**PARQUET_OPTIONS).option("maxRecordsPerFile", self.config.rows_per_file).partitionBy("metric_name").parquet(path)
        stats = chunk_stats(self._read(STORED).parquet(path), ["series_key", "series_id", "metric_name"])
        stats = stats.withColumns({"chunk_id": F.lit(chunk_id).cast("long"), "tags": key_tags(F.col("series_key"))})
        stats.select(*names_of(STATS)).write.parquet(stats_path)
        total = self.spark.read.schema(STATS).parquet(stats_path).agg(F.coalesce(F.sum("entry_count"), F.lit(0))).first()[0]
        return Chunk(chunk_id, path, stats_path, self.log.files.size(path), int(total), seq)

    def _discard(self, chunk: Chunk) -> None:
        self.log.files.delete(chunk.path)
        self.log.files.delete(chunk.stats_path)

    def current_sequence(self) -> int:
        """The sequence of the last committed batch."""
        return self.log.load().last_commit_seq

    # -- reading ---------------------------------------------------------------------------------------------------

    def _read(self, schema: str):
        return self.spark.read.schema(schema).options(**VERIFIED)

    def _scan(self, chunks: list[Chunk] | tuple[Chunk, ...]) -> DataFrame:
        if not chunks:
            return self.spark.createDataFrame([], STORED)
        return self._read(STORED).option("basePath", f"{self.base}/points").parquet(*[c.path for c in chunks]).drop("chunk")

    def _scan_log(self, segments: tuple[Segment, ...]) -> DataFrame:
        """The log's rows with the sequences of their segments."""
        rows = self._read(f"{LOGGED}, segment STRING").option("basePath", f"{self.base}/log").parquet(*[s.path for s in segments])
        if len(segments) == 1:
            rows = rows.withColumn("commit_seq", F.lit(segments[0].commit_seq).cast("long"))
        else:  # one row a segment, at most ``max_segments`` and what came during a flush
            table = small_table(self.spark, [{"segment": s.name, "commit_seq": s.commit_seq} for s in segments], "segment: string, commit_seq: bigint")
            rows = rows.join(F.broadcast(table), "segment")
        return rows.select(*names_of(STORED))

    def stats(self, manifest: Manifest | None = None) -> DataFrame:
        """A row for each live chunk and series; the log has no statistics."""
        paths = [c.stats_path for c in (manifest or self.log.load()).chunks]
        return self.spark.read.schema(STATS).option("basePath", f"{self.base}/stats").parquet(*paths).drop("chunk") if paths else self.spark.createDataFrame([], STATS)

    def series(self, metric: str | None = None, tags: dict[str, str] | None = None) -> DataFrame:
        """The registered series of a metric whose tags hold ``tags``, those of the log included."""
        m = self.log.load()
        names = ["series_key", "series_id", "metric_name"]
        found = self.stats(m).select(*names)
        if m.segments:
            found = found.unionByName(self._scan_log(m.segments).select(*names))
        hit = key_has(F.col("series_key"), tags or {})
        if metric is not None:
            hit = hit & (F.col("metric_name") == metric)
        return found.where(hit).distinct().withColumn("tags", key_tags(F.col("series_key")))

    def postings(self) -> DataFrame:
        return postings(self.series())

    def query(
        self, metric: str, tags: dict[str, str] | None = None, start: int | None = None, end: int | None = None, predicate: ValuePredicate | None = None, dedup: bool = True, with_labels: bool = False
    ) -> DataFrame:
        """(series_id, timestamp_ns, value), with series_key and tags if asked for.

        A value predicate is about what a timestamp holds: it applies after the last write is chosen, and prunes only where all
        writes are wanted (``dedup=False``).
        """
        with self.meter.timed("query", QUERY_BUCKETS):
            m = self.log.load()
            early = None if dedup else predicate
            parts = []
            if chosen := self._pruned(m, metric, tags, start, end, early):
                chunks, entries = chosen
                rows = select_points(self._scan(chunks), metric, None, start, end, early)
                if tags:
                    keys = [r[0] for r in entries.select("series_key").distinct().limit(KEYS_IN_FILTER + 1).collect()]
                    rows = rows.where(F.col("series_key").isin(keys)) if len(keys) <= KEYS_IN_FILTER else rows.join(entries.select("series_key").distinct(), "series_key", "left_semi")
                parts.append(rows)
            if m.segments:
                parts.append(select_points(self._scan_log(m.segments), metric, None, start, end, early).where(key_has(F.col("series_key"), tags or {})))
            rows = concatenated(parts[0], parts[1]) if len(parts) == 2 else parts[0] if parts else self.spark.createDataFrame([], STORED)
            if dedup:
                rows = last_write(rows, F.struct(*ARRIVAL[:2]), by=["series_id"])
                if predicate:
                    rows = rows.where(predicate.row(F.col("value")))
            if with_labels:
                rows = rows.withColumn("tags", key_tags(F.col("series_key")))
            return rows.select("series_id", "timestamp_ns", "value", *(["series_key", "tags"] if with_labels else []))

    def _pruned(self, m: Manifest, metric: str, tags: dict[str, str] | None, start: int | None, end: int | None, predicate: ValuePredicate | None) -> tuple[list[Chunk], DataFrame] | None:
        """The chunks that may hold rows of a query, and their entries; None if none may."""
        if not m.chunks:
            return None
        entries = prune(self.stats(m).where((F.col("metric_name") == metric) & has_tags(F.col("tags"), tags or {})), start, end, predicate)
        hit = {r["chunk_id"] for r in entries.select("chunk_id").distinct().collect()}  # at most as many as the manifest lists
        self.meter.observe("query_chunks_total", len(m.chunks), CHUNK_BUCKETS)
        self.meter.observe("query_chunks_read", len(hit), CHUNK_BUCKETS)
        chunks = [c for c in m.chunks if c.chunk_id in hit]
        return (chunks, entries) if chunks else None

    def query_rows(self, *args, **kwargs):
        """Rows of a query one by one, a partition at a time on the driver."""
        return self.query(*args, **kwargs).toLocalIterator(prefetchPartitions=True)

    def shards(self) -> DataFrame:
        """Series of each shard."""
        s = self.series().withColumn("shard", shard(F.col("series_id"), self.config.num_shards))
        return s.groupBy("shard").agg(F.count(F.lit(1)).alias("series"))

    def chunk_bounds(self) -> DataFrame:
        return file_bounds(self.stats())

    def counts(self) -> dict[str, int]:
        m = self.log.load()
        return {"series": self.series().count(), "series_chunks": self.stats(m).count(), "chunks": len(m.chunks), "segments": len(m.segments)}

    def exposition(self) -> str:
        """Counters, gauges and histograms of this engine as text."""
        m = self.log.load()
        self.meter.gauge("chunks", len(m.chunks))
        self.meter.gauge("log_segments", len(m.segments))
        self.meter.gauge("log_bytes", sum(s.rows for s in m.segments) * POINT_BYTES)
        self.meter.gauge("sequence", m.last_commit_seq)
        return self.meter.text()

    # -- upkeep ----------------------------------------------------------------------------------------------------

    def compact(self) -> dict[str, int]:
        """Merges size tiers, keeping the last write of each timestamp; one manifest version swaps old chunks for new."""
        out = {"chunks_merged": 0, "bytes_freed": 0}
        with self.meter.timed("compaction", FLUSH_BUCKETS):
            for group in tiers([(c.chunk_id, c.size) for c in self.log.load().chunks], self.config.compaction_threshold, self.config.compaction_ratio):
                old = [c for c in self.log.load().chunks if c.chunk_id in group]
                if len(old) < len(group):
                    continue  # another writer has merged some of them
                keep = ["commit_seq", "commit_pos"]
                rows = last_write(self._scan(old), F.struct(*keep), keep, by=["series_id", "metric_name"])
                new = self._write(rows, max(c.commit_seq for c in old))

                def change(m: Manifest, group: list[int] = group, new: Chunk = new) -> Manifest | None:
                    if not set(group) <= {c.chunk_id for c in m.chunks}:
                        return None
                    return m.next(chunks=(*[c for c in m.chunks if c.chunk_id not in group], new))

                if self.log.update(change) is None:
                    self._discard(new)
                    continue
                out["chunks_merged"] += len(old)
                out["bytes_freed"] += max(0, sum(c.size for c in old) - new.size)
        self.meter.count("compacted_chunks_total", out["chunks_merged"])
        return out

    def snapshot(self) -> int:
        """Flushes the log and returns the version that readers see; every commit is durable before."""
        self.flush()
        return self.log.load().version

    def vacuum(self, keep_versions: int = 1, older_than_s: float = 86_400) -> list[str]:
        """Deletes manifests older than the last ``keep_versions``, and the data that none of those left names.

        Segments that a flush covers and chunks that a compaction replaced go this way. Only what has not changed for ``older_than_s``
        goes, so an append, flush or query under way keeps its data.
        """
        versions = self.log.versions()
        kept = [self.log.load(v) for v in versions[-keep_versions:]]
        live = {c.path for m in kept for c in m.chunks} | {c.stats_path for m in kept for c in m.chunks} | {s.path for m in kept for s in m.segments}
        gone = []
        for kind in ("points", "stats", "log"):
            for name in self.log.files.names(f"{self.base}/{kind}"):
                path = f"{self.base}/{kind}/{name}"
                if path not in live and self.log.files.age(path) >= older_than_s:
                    gone.append(f"{kind}/{name}")
                    self.log.files.delete(path)
        for v in versions[:-keep_versions]:
            if self.log.files.age(f"{self.log.dir}/{v}.json") >= older_than_s:
                self.log.files.delete(f"{self.log.dir}/{v}.json")
        return gone


class Upkeep:
    """Flushes, compacts and vacuums an engine every so many seconds on a thread of its own, until it is closed."""

    def __init__(self, engine: Engine, flush_every: float = 60, compact_every: float = 300, vacuum_every: float = 3600):
        self._stop = threading.Event()
        work = [(flush_every, engine.flush), (compact_every, engine.compact), (vacuum_every, engine.vacuum)]
        self.threads = [threading.Thread(target=self._loop, args=(engine, s, f), daemon=True) for s, f in work]
        for t in self.threads:
            t.start()

    def _loop(self, engine: Engine, seconds: float, work) -> None:
        while not self._stop.wait(seconds):
            try:
                work()
            except Exception:  # the next round tries again; the count tells
                engine.meter.count("upkeep_failures_total")

    def close(self) -> None:
        self._stop.set()
        for t in self.threads:
            t.join()
