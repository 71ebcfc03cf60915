import random
import struct
import threading
import time
import zlib

import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from seriesloom.functions import codec, frames, identity, metrics
from seriesloom.functions.predicates import ValuePredicate
from seriesloom.operators import compaction, index, points
from seriesloom.plans.engine import Engine, EngineConfig, Upkeep
from seriesloom.plans.manifest import CommitConflict
from seriesloom.sources.points import synthetic
from seriesloom.streaming.group_commit import GroupCommit
from seriesloom.streaming.ingest import file_source, ingest, rate_source

SCHEMA = "metric_name string, tags map<string,string>, timestamp_ns bigint, value double"
S = 1_000_000_000


def rows(metric, host, times, value=float):
    return [(metric, {"host": host}, t, value(i)) for i, t in enumerate(times)]


def frame(spark, data, **more):
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def engine(spark, tmp_path):
    """Every append is flushed into a chunk."""
    return Engine(spark, EngineConfig(base=f"file://{tmp_path}/store", compaction_threshold=2, compaction_ratio=10, flush_threshold_bytes=0))


@pytest.fixture
def buffered(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/buffered")


def got(df):
    return sorted((r["timestamp_ns"], r["value"]) for r in df.collect())


def test_round_trip_and_ids(spark, engine):
    assert engine.append(frame(spark, rows("cpu.load", "web1", [S, 2 * S, 3 * S]))) == 1
    out = engine.query("cpu.load", with_labels=True).collect()
    assert len(out) == 3 and {r["series_key"] for r in out} == {"cpu.load,host=web1"} and out[0]["tags"] == {"host": "web1"}
    want = xxhash.xxh64_intdigest(b"cpu.load,host=web1", seed=0)
    assert {r["series_id"] & (2**64 - 1) for r in out} == {want}
    assert engine.query("unknown").count() == 0 and engine.snapshot() == 2  # the append and its flush


def test_ranges_are_inclusive_and_negative_times_work(spark, engine):
    engine.append(frame(spark, rows("m", "a", [-5, 0, 5, *(i * S for i in range(1, 101))])))
    assert [t for t, _ in got(engine.query("m", start=-5, end=0))] == [-5, 0]
    assert engine.query("m", start=25 * S, end=74 * S).count() == 50
    assert engine.query("m", start=5).count() == 101 and engine.query("m", end=0).count() == 2


def test_tags_are_supersets(spark, engine):
    sets = [{"env": "prod", "host": "web1"}, {"env": "prod", "host": "web1", "dc": "x"}, {"env": "prod", "host": "web2"}, {"env": "dev", "host": "web1"}, {}]
    engine.append(frame(spark, [("m", t, 1, 1.0) for t in sets]))
    assert engine.query("m", {"env": "prod", "host": "web1"}).count() == 2
    assert engine.query("m", {"env": "prod", "host": "web3"}).count() == 0
    assert engine.query("m").count() == 5 and engine.query("m", {"dc": "x"}).count() == 1
    keys = index.series_with(engine.postings(), {"env": "prod", "host": "web1"})
    assert keys.count() == 2


def test_last_write_wins_across_chunks_and_compaction_keeps_results(spark, engine):
    engine.append(frame(spark, rows("m", "a", range(10))))
    engine.append(frame(spark, rows("m", "a", range(5, 15), lambda i: 100.0 + i)))
    engine.append(frame(spark, [("m", {"host": "a"}, 7, float("nan"))]))
    before = engine.query("m").collect()
    assert engine.query("m", dedup=False).count() == 21 and len(before) == 15
    assert engine.query("m", predicate=ValuePredicate.gt(100)).count() == 8  # NaN and 100.0 itself are out
    out = engine.compact()
    assert out["chunks_merged"] == 3 and engine.counts()["chunks"] == 1
    assert sorted(map(repr, engine.query("m").collect())) == sorted(map(repr, before))
    assert engine.query("m", dedup=False).count() == 15
    assert engine.compact() == {"chunks_merged": 0, "bytes_freed": 0}
    assert engine.vacuum() == []  # nothing is old enough
    assert len(engine.vacuum(older_than_s=0)) == 9 and engine.query("m").count() == 15  # three segments, three chunks, their statistics


def test_order_within_a_batch(spark, engine):
    data = frame(spark, [("m", {}, 1, 5.0), ("m", {}, 1, 3.0)]).withColumn("commit_pos", F.when(F.col("value") == 3, 2).otherwise(1))
    engine.append(data)
    assert got(engine.query("m")) == [(1, 3.0)]


def test_bad_and_empty_batches(spark, engine):
    assert engine.append(frame(spark, [])) == 0 and engine.snapshot() == 0
    for bad in ([("", {}, 1, 1.0)], [("a,b", {}, 1, 1.0)], [("m", {"k=": "v"}, 1, 1.0)]):
        with pytest.raises(Exception, match="metric needs|tags may"):
            engine.append(frame(spark, bad))
    assert engine.append(frame(spark, [("m", {}, 1, 1.0)])) == 1


def test_commit_conflict(spark, engine):
    engine.append(frame(spark, [("m", {}, 1, 1.0)]))
    m = engine.log.load()
    engine.log.commit(m.next())
    with pytest.raises(CommitConflict):
        engine.log.commit(m.next())


def test_pruning_never_drops_a_row(spark, engine):
    rng = random.Random(4)
    data = [("m", {"host": f"h{rng.randrange(3)}"}, rng.randrange(1000), rng.random() * 100) for _ in range(200)]
    for k in range(4):
        engine.append(frame(spark, data[k::4]))
    assert engine.query("m", {"host": "h1"}, 100, 300, ValuePredicate.between(20, 70), dedup=False).count() == sum(
        t["host"] == "h1" and 100 <= ts <= 300 and 20 <= v <= 70 for _, t, ts, v in data
    )
    assert index.prune(engine.stats(), 5000, None).count() == 0
    assert index.prune(engine.stats(), None, None, ValuePredicate.lt(-1)).count() == 0


def test_stream_ingest_is_exactly_once(spark, engine, tmp_path):
    src, ck = f"{tmp_path}/src", f"{tmp_path}/ck"
    synthetic(spark, 300, 20).repartition(3).write.parquet(src)
    for _ in range(2):
        ingest(file_source(spark, src, 1), engine, ck).awaitTermination()
    assert sum(c.rows for c in engine.log.load().chunks) == 300
    last = engine.log.load().streams["ingest"]
    engine.append(synthetic(spark, 50, 5), stream="ingest", **last)  # a replayed batch
    assert sum(c.rows for c in engine.log.load().chunks) == 300


def test_a_second_stream_is_never_taken_for_the_first(spark, engine, tmp_path):
    for k in "ab":
        synthetic(spark, 100, 20, seed=ord(k)).write.parquet(f"{tmp_path}/{k}")
    ingest(file_source(spark, f"{tmp_path}/a"), engine, f"{tmp_path}/ck-a").awaitTermination()
    with pytest.raises(Exception, match="belongs to checkpoint"):  # the same name from another checkpoint
        ingest(file_source(spark, f"{tmp_path}/b"), engine, f"{tmp_path}/ck-b").awaitTermination()
    ingest(file_source(spark, f"{tmp_path}/b"), engine, f"{tmp_path}/ck-c", name="second").awaitTermination()
    assert sum(c.rows for c in engine.log.load().chunks) == 200


def test_small_appends_coalesce_and_are_readable_before_the_flush(spark, buffered):
    for i in range(5):
        assert buffered.append(frame(spark, [("m", {"host": "a"}, i % 3, float(i)), ("n", {"host": "b=,"[:2]}, i, 1.0)])) == i + 1
    before = got(buffered.query("m", {"host": "a"}))
    assert before == [(0, 3.0), (1, 4.0), (2, 2.0)] and buffered.query("n", {"host": "b="}).count() == 5 and buffered.query("n", {"host": "b"}).count() == 0
    assert buffered.counts() == {"series": 2, "series_chunks": 0, "chunks": 0, "segments": 5}
    assert buffered.flush() == 5 and buffered.flush() == 0
    assert buffered.counts() == {"series": 2, "series_chunks": 2, "chunks": 1, "segments": 0} and got(buffered.query("m", {"host": "a"})) == before
    buffered.append(frame(spark, [("m", {"host": "a"}, 1, -1.0)]))  # log over chunk
    assert got(buffered.query("m", {"host": "a"})) == [(0, 3.0), (1, -1.0), (2, 2.0)]
    assert [r["value"] for r in buffered.query_rows("m", start=1, end=1)] == [-1.0]
    assert buffered.shards().agg(F.sum("series")).first()[0] == 2 and buffered.chunk_bounds().first()["entry_count"] == 10
    assert Engine(spark, buffered.config).query("m").count() == 3  # reopened


def test_flush_threshold_counts_points(spark, tmp_path):
    e = Engine(spark, EngineConfig(base=f"file://{tmp_path}/s", flush_threshold_bytes=160))
    e.append(frame(spark, rows("m", "a", range(4))))
    assert e.counts()["segments"] == 1
    e.append(frame(spark, rows("m", "a", [9])))
    assert e.counts() == {"series": 1, "series_chunks": 1, "chunks": 1, "segments": 0}


def test_writers_that_race_lose_nothing(spark, engine):
    """Two threads append and flush through engines of their own."""
    engines = [Engine(spark, EngineConfig(base=engine.base, flush_threshold_bytes=64)) for _ in range(2)]
    seqs: list[int] = []

    def work(k: int) -> None:
        for i in range(8):
            seqs.append(engines[k].append(frame(spark, [(f"m{k}", {"host": "a"}, i, float(i)), ("both", {}, i, float(k))])))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(seqs) == list(range(1, 17))
    for k in range(2):
        assert got(engine.query(f"m{k}")) == [(i, float(i)) for i in range(8)]
    assert engine.query("both", dedup=False).count() == 16 and engine.query("both").count() == 8


def test_a_losing_writer_changes_nothing(spark, engine):
    stale = engine.log.load()
    assert engine.append(frame(spark, [("m", {}, 1, 1.0)])) == 1
    late = Engine(spark, engine.config)
    real, first = late.log.load, [stale]
    late.log.load = lambda *a: first.pop() if first else real(*a)  # decides on what was there before the other's commit
    assert late.append(frame(spark, [("m", {}, 2, 2.0)])) == 2
    assert got(engine.query("m")) == [(1, 1.0), (2, 2.0)]


def test_group_commit(spark, buffered):
    group = GroupCommit(buffered, delay=0.5)
    futures = [group.submit(frame(spark, [("m", {}, 7, float(i)), ("m", {}, 100 + i, 0.0)])) for i in range(4)]
    assert group.drain() == buffered.current_sequence() and all(f.done() for f in futures)
    assert len({f.result() for f in futures}) == buffered.current_sequence() <= 2
    assert got(buffered.query("m", end=7)) == [(7, 3.0)] and buffered.query("m").count() == 5
    bad = group.submit(frame(spark, [("", {}, 1, 1.0)]))
    with pytest.raises(Exception, match="metric needs"):
        bad.result()
    assert group.append(frame(spark, [("m", {}, 8, 1.0)])) == group.current_sequence()
    group.close()


def test_damaged_pages_are_errors(spark, engine, tmp_path):
    engine.append(frame(spark, rows("m", "a", range(2000), lambda i: i * 0.37)))
    [path] = [p for p in (tmp_path / "store/points").rglob("part-*.parquet")]
    for crc in (tmp_path / "store/points").rglob(".*.crc"):
        crc.unlink()  # only the pages' own checksums are left
    data = bytearray(path.read_bytes())
    column = pq.ParquetFile(path).metadata.row_group(0)
    at = next(column.column(i).data_page_offset for i in range(column.num_columns) if column.column(i).path_in_schema == "value")
    data[at + 200] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
        engine.query("m").collect()


def test_exposition(spark, engine):
    engine.append(frame(spark, rows("m", "a", range(3))))
    engine.query("m").collect()
    engine.compact()
    text = engine.exposition()
    for line in ("seriesloom_points_appended_total 3", 'seriesloom_append_total{status="ok"} 1', "seriesloom_query_seconds_count 1", "seriesloom_flush_seconds_count 1", "seriesloom_chunks 1", 'seriesloom_query_chunks_read_bucket{le="1"} 1'):
        assert line in text, (line, text)


def test_upkeep(spark, buffered):
    buffered.append(frame(spark, [("m", {}, 1, 1.0)]))
    upkeep = Upkeep(buffered, flush_every=0.2, compact_every=1000, vacuum_every=1000)
    for _ in range(100):
        if buffered.counts()["segments"] == 0:
            break
        time.sleep(0.1)
    upkeep.close()
    assert buffered.counts()["chunks"] == 1


def test_rate_source(spark, buffered, tmp_path):
    q = ingest(rate_source(spark, 50), buffered, f"{tmp_path}/ck", every="1 second")
    for _ in range(60):
        if buffered.current_sequence():
            break
        time.sleep(0.5)
    q.stop()
    assert buffered.query("load.rate").count() > 0


def test_frames(spark):
    payloads = [b"", b"one", b"x" * 300]
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "i int, p binary")
    made = [bytes(r["f"]) for r in df.orderBy("i").select(frames.frame(F.col("p")).alias("f")).collect()]
    assert made == [struct.pack("<II", len(p), zlib.crc32(p)) + p for p in payloads]
    log = b"".join(made)
    flipped = bytearray(log)
    flipped[9] ^= 1
    logs = {"whole": log, "torn": log[:-1], "flipped": bytes(flipped), "tail": log + b"abc", "none": b""}
    read = frames.read_frames(spark.createDataFrame([(k, bytearray(v)) for k, v in logs.items()], "name string, log binary")).collect()
    out = {k: [bytes(r["payload"]) if not r["torn"] else None for r in sorted((r for r in read if r["name"] == k), key=lambda r: r["pos"])] for k in logs}
    assert out == {"whole": payloads, "torn": [*payloads[:2], None], "flipped": [b"", None], "tail": [*payloads, None], "none": []}


def test_scan_filters_are_pushed_down(spark, engine):
    engine.append(frame(spark, rows("m", "a", range(100))))
    plan = engine.query("m", {"host": "a"}, 1, 5)._jdf.queryExecution().toString()
    assert "series_key" in plan.split("PushedFilters")[1] and "GreaterThanOrEqual(timestamp_ns,1)" in plan and "PartitionFilters: [isnotnull(metric_name" in plan


def test_identity(spark):
    df = spark.createDataFrame([("m", {"b": "2=x", "a": "1"}), ("alone", {})], "m string, t map<string,string>").withColumn("series_key", identity.series_key(F.col("m"), F.col("t")))
    df = df.withColumns({"mm": identity.key_metric(F.col("series_key")), "tt": identity.key_tags(F.col("series_key")), "id": identity.series_id(F.col("series_key"))})
    out = {r["series_key"]: r for r in df.collect()}
    assert set(out) == {"m,a=1,b=2=x", "alone"} and out["m,a=1,b=2=x"]["tt"] == {"a": "1", "b": "2=x"} and out["alone"]["tt"] == {}
    portable = identity.with_series_id(df.select("series_key"))
    assert {(r["series_key"], r["series_id"]) for r in portable.collect()} == {(k, r["id"]) for k, r in out.items()}
    shown = df.select(identity.unsigned(F.col("id")).alias("u"), "series_key", identity.shard(F.col("id"), 16).alias("s")).collect()
    assert all(int(r["u"]) == xxhash.xxh64_intdigest(r["series_key"].encode()) and r["s"] == int(r["u"]) & 15 for r in shown)
    with pytest.raises(Exception, match="tag without"):
        spark.createDataFrame([("m,bad",)], "k string").select(identity.key_tags(F.col("k"))).collect()


def test_codec_arrays(spark):
    df = spark.createDataFrame([([1000, 1001, 1003, 2000, 5000],), ([],), ([7],)], "x array<bigint>").withColumn("d", codec.delta_array(F.col("x")))
    assert [r["d"] for r in df.collect()] == [[1000, 1, 2, 997, 3000], [], [7]]
    assert all(r["x"] == r["y"] for r in df.withColumn("y", codec.undelta_array(F.col("d"))).collect())


def test_tiers(spark):
    sizes = [100, 140, 151, 200, 400, 410, 1000, 0]
    want = [[100, 140], [151, 200], [400, 410]]
    assert compaction.tiers([(s, s) for s in sizes], 2, 1.5) == want
    df = spark.createDataFrame([(sizes,)], "s array<int>")
    assert df.select(compaction.tier_column(F.col("s"), 2, 1.5)).first()[0] == want
    with pytest.raises(ValueError):
        compaction.tiers([], 2, 0.9)


def test_buffer_size(spark):
    df = spark.createDataFrame([("example", {"host": "node-0"}, t, 1.0) for t in (1, 2, 3, 4, 5, 5)], SCHEMA).withColumn("series_key", identity.series_key(F.col("metric_name"), F.col("tags")))
    assert points.buffer_size(df).first().asDict() == {"entries": 5, "bytes": 185}


def test_nearest_rank(spark):
    rng = random.Random(9)
    data = [(g, rng.choice([1.5, rng.gauss(0, 5)])) for g in "ab" for _ in range(3000)] + [("c", 4.0)]
    df = spark.createDataFrame(data, "g string, v double")
    for r in metrics.nearest_rank(df, "g", "v", [0.0, 0.5, 0.95, 0.99, 1.0]).collect():
        own = sorted(v for g, v in data if g == r["g"])
        assert r["result"] == own[int((len(own) - 1) * r["p"])]


def test_nearest_rank_of_groups_of_any_size(spark):
    sizes = spark.createDataFrame([(n,) for n in [*range(1, 801), *range(801, 3001, 20), *range(7000, 9000, 250)]], "g bigint").repartition(8)
    df = sizes.select("g", F.explode(F.sequence(F.lit(1).cast("bigint"), "g")).alias("v")).select("g", F.col("v").cast("double"))
    percentiles = [0.0, 0.5, 0.9, 0.95, 0.99, 1.0]
    got = {(r["g"], r["p"]): r["result"] for r in metrics.nearest_rank(df, "g", "v", percentiles).collect()}
    assert got == {(r["g"], p): int((r["g"] - 1) * p) + 1 for r in sizes.collect() for p in percentiles}


def test_config(monkeypatch):
    monkeypatch.setenv("SERIESLOOM_NUM_SHARDS", "8")
    monkeypatch.setenv("SERIESLOOM_COMPACTION_RATIO", "odd")
    c = EngineConfig.from_env()
    assert c.num_shards == 8 and c.compaction_ratio == 1.5
    with pytest.raises(ValueError):
        EngineConfig(num_shards=6)
