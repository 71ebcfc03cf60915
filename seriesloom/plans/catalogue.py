"""Queries over the driver's tables, one for each operator, with their SQL counterparts.

Points come from three adapters: line items (six series, many rewritten timestamps), events (one metric a type, one series a user)
and orders (one series for each priority and status).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions import codec, frames, identity, metrics
from seriesloom.functions.predicates import ValuePredicate
from seriesloom.operators import compaction, index, log
from seriesloom.operators import points as ops
from seriesloom.plans.engine import Engine, EngineConfig
from seriesloom.plans.scratch import Scratch
from seriesloom.plans.sql import CRC_TABLE, crc32, xxh64
from seriesloom.sources.points import from_events, from_lineitem, from_orders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LI_METRIC, EV_METRIC, OR_METRIC = "lineitem.extendedprice", "events.click", "orders.totalprice"
Y1996, Y1997 = 820454400000000000, 852076800000000000
#: Line items of a chunk, by order key.
CHUNK_ORDERS = 1000
POINT = ["series_key", "timestamp_ns", "value"]

LI = """li AS (SELECT 'lineitem.extendedprice,linestatus=' || l_linestatus || ',returnflag=' || l_returnflag AS series_key, l_linestatus, l_returnflag,
  epoch_us(l_shipdate) * 1000 AS timestamp_ns, l_extendedprice AS value, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey // 1000 AS chunk_id FROM lineitem)"""
LWW = """lww AS (SELECT series_key, l_linestatus, l_returnflag, timestamp_ns, arg_max(value, (l_orderkey, l_linenumber, l_partkey, l_suppkey, value)) AS value FROM li GROUP BY ALL)"""
EV = """ev AS (SELECT 'events.' || event_type AS metric_name, CAST(user_id AS VARCHAR) AS user_id, 'events.' || event_type || ',user_id=' || user_id AS series_key,
  epoch_us(ts) * 1000 AS timestamp_ns, value, event_id FROM events)"""
OD = """od AS (SELECT 'orders.totalprice,priority=' || o_orderpriority || ',status=' || o_orderstatus AS series_key, o_orderpriority AS priority, o_orderstatus AS status,
  epoch_us(o_orderdate) * 1000 AS timestamp_ns, o_totalprice AS value, o_orderkey FROM orders)"""
STATS = "st AS (SELECT series_key, chunk_id, min(timestamp_ns) AS time_start_ns, max(timestamp_ns) AS time_end_ns, count(*) AS entry_count, min(value) AS min_value, max(value) AS max_value FROM li GROUP BY ALL)"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    return from_lineitem(spark, d).withColumn("chunk_id", F.floor(F.col("arrival.l_orderkey") / CHUNK_ORDERS))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return index.chunk_stats(_chunked(spark, d), ["series_key", "chunk_id"])


@query("q01_series_query", f"WITH {LI}, {LWW} SELECT series_key, timestamp_ns, value FROM lww WHERE l_linestatus = 'F' AND l_returnflag = 'A' AND timestamp_ns BETWEEN {Y1996} AND {Y1997}")
def q01(spark, d):
    hit = ops.select_points(from_lineitem(spark, d), LI_METRIC, {"linestatus": "F", "returnflag": "A"}, Y1996, Y1997)
    return ops.last_write(hit).select(*POINT)


@query("q02_metric", f"WITH {EV} SELECT series_key, timestamp_ns, value FROM ev WHERE metric_name = '{EV_METRIC}'")
def q02(spark, d):
    return ops.select_points(from_events(spark, d), EV_METRIC).select(*POINT)


@query("q03_single_tag", f"WITH {EV} SELECT series_key, timestamp_ns, value FROM ev WHERE metric_name = '{EV_METRIC}' AND user_id = '7'")
def q03(spark, d):
    return ops.select_points(from_events(spark, d), EV_METRIC, {"user_id": "7"}).select(*POINT)


@query("q04_unknown_metric", f"WITH {EV} SELECT series_key, timestamp_ns, value FROM ev WHERE metric_name = 'no.such.metric'")
def q04(spark, d):
    return ops.select_points(from_events(spark, d), "no.such.metric").select(*POINT)


BOUNDS = "b AS (SELECT min(timestamp_ns) AS lo, max(timestamp_ns) AS hi FROM ev WHERE event_id IN (100, 600))"


def _bounds(spark, d):
    at = from_events(spark, d).where("arrival in (100, 600)").agg(F.min("timestamp_ns"), F.max("timestamp_ns")).first()
    return at[0], at[1]


@query("q05_inclusive_range", f"WITH {EV}, {BOUNDS} SELECT series_key, timestamp_ns, value FROM ev, b WHERE timestamp_ns BETWEEN lo AND hi AND metric_name = '{EV_METRIC}'")
def q05(spark, d):
    return ops.select_points(from_events(spark, d), EV_METRIC, None, *_bounds(spark, d)).select(*POINT)


@query("q06_open_start", f"WITH {EV}, {BOUNDS} SELECT series_key, timestamp_ns, value FROM ev, b WHERE timestamp_ns <= hi AND metric_name = '{EV_METRIC}'")
def q06(spark, d):
    return ops.select_points(from_events(spark, d), EV_METRIC, None, None, _bounds(spark, d)[1]).select(*POINT)


@query("q07_open_end", f"WITH {EV}, {BOUNDS} SELECT series_key, timestamp_ns, value FROM ev, b WHERE timestamp_ns >= lo AND metric_name = '{EV_METRIC}'")
def q07(spark, d):
    return ops.select_points(from_events(spark, d), EV_METRIC, None, _bounds(spark, d)[0], None).select(*POINT)


@query("q08_value_gt", f"WITH {LI} SELECT series_key, timestamp_ns, value FROM li WHERE value > 50000 AND NOT isnan(value)")
def q08(spark, d):
    return ops.select_points(from_lineitem(spark, d), LI_METRIC, predicate=ValuePredicate.gt(50000)).select(*POINT)


@query("q09_value_lt", f"WITH {EV} SELECT series_key, timestamp_ns, value FROM ev WHERE value < 10 AND NOT isnan(value) AND metric_name = '{EV_METRIC}'")
def q09(spark, d):
    return ops.select_points(from_events(spark, d), EV_METRIC, predicate=ValuePredicate.lt(10)).select(*POINT)


@query("q10_value_between", f"WITH {LI} SELECT series_key, timestamp_ns, value FROM li WHERE value BETWEEN 20000 AND 30000 AND NOT isnan(value)")
def q10(spark, d):
    return ops.select_points(from_lineitem(spark, d), LI_METRIC, predicate=ValuePredicate.between(20000, 30000)).select(*POINT)


@query("q11_last_write_wins", f"WITH {LI}, {LWW} SELECT series_key, timestamp_ns, value FROM lww")
def q11(spark, d):
    return ops.last_write(from_lineitem(spark, d))


@query("q12_hot_and_cold", f"WITH {EV} SELECT series_key, timestamp_ns, value FROM ev WHERE metric_name = '{EV_METRIC}' UNION ALL SELECT series_key, timestamp_ns, value + 1 FROM ev WHERE metric_name = '{EV_METRIC}' AND event_id % 4 = 0")
def q12(spark, d):
    """A store's chunk and, over it, a log that rewrites a quarter of its timestamps: all writes of both."""
    engine, ev = Engine(spark, Scratch(spark, "store").path), from_events(spark, d)
    engine.append(ev, flush=True)
    engine.append(ev.where("arrival % 4 = 0").withColumn("value", F.col("value") + 1), flush=False)
    return engine.query(EV_METRIC, dedup=False, with_labels=True).select(*POINT)


@query("q13_registry", f"WITH {LI}, {EV} SELECT DISTINCT series_key, 'lineitem.extendedprice' AS metric_name FROM li UNION SELECT DISTINCT series_key, metric_name FROM ev")
def q13(spark, d):
    both = from_lineitem(spark, d).drop("arrival").unionByName(from_events(spark, d).drop("arrival"))
    return index.registry(both).select("series_key", "metric_name")


@query("q14_postings", f"WITH {LI} SELECT tag_key, tag_value, count(DISTINCT series_key) AS series FROM (SELECT 'linestatus' AS tag_key, l_linestatus AS tag_value, series_key FROM li UNION ALL SELECT 'returnflag', l_returnflag, series_key FROM li) GROUP BY ALL")
def q14(spark, d):
    return index.postings(index.registry(from_lineitem(spark, d))).groupBy("tag_key", "tag_value").agg(F.count(F.lit(1)).alias("series"))


@query("q15_tag_intersection", f"WITH {OD} SELECT series_key, count(*) AS n, sum(value) AS total FROM od WHERE priority = '1-URGENT' AND status = 'F' GROUP BY 1")
def q15(spark, d):
    points = from_orders(spark, d)
    keys = index.series_with(index.postings(index.registry(points)), {"priority": "1-URGENT", "status": "F"})
    return points.join(keys, "series_key", "left_semi").groupBy("series_key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("q16_chunk_stats", f"WITH {LI}, {STATS} SELECT * FROM st")
def q16(spark, d):
    return _stats(spark, d)


@query("q17_time_pruning", f"WITH {LI}, {STATS} SELECT series_key, chunk_id FROM st WHERE time_start_ns <= {Y1996} + 86400000000000 * 30 AND time_end_ns >= {Y1996}")
def q17(spark, d):
    return index.prune(_stats(spark, d), Y1996, Y1996 + 86400000000000 * 30).select("series_key", "chunk_id")


@query("q18_stats_pruning_gt", f"WITH {LI}, {STATS} SELECT series_key, chunk_id FROM st WHERE max_value > 55000")
def q18(spark, d):
    return index.prune(_stats(spark, d), predicate=ValuePredicate.gt(55000)).select("series_key", "chunk_id")


@query("q19_stats_pruning_between", f"WITH {LI}, {STATS} SELECT series_key, chunk_id FROM st WHERE min_value <= 1500 AND max_value >= 1000")
def q19(spark, d):
    return index.prune(_stats(spark, d), predicate=ValuePredicate.between(1000, 1500)).select("series_key", "chunk_id")


@query("q20_prune_then_read", f"WITH {LI} SELECT series_key, timestamp_ns, value FROM li WHERE timestamp_ns BETWEEN {Y1996} AND {Y1997} AND value > 50000 AND NOT isnan(value)")
def q20(spark, d):
    p = ValuePredicate.gt(50000)
    entries = index.prune(_stats(spark, d), Y1996, Y1997, p).select("series_key", "chunk_id")
    hit = _chunked(spark, d).join(entries, ["series_key", "chunk_id"], "left_semi")
    return ops.select_points(hit, LI_METRIC, None, Y1996, Y1997, p).select(*POINT)


@query("q21_delta_encode", f"WITH {LI}, t AS (SELECT DISTINCT series_key, timestamp_ns FROM li) SELECT series_key, timestamp_ns, coalesce(timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY series_key ORDER BY timestamp_ns), timestamp_ns) AS delta FROM t")
def q21(spark, d):
    t = from_lineitem(spark, d).select("series_key", "timestamp_ns").distinct()
    return t.withColumn("delta", codec.delta(F.col("timestamp_ns"), "series_key", "timestamp_ns"))


@query("q22_delta_decode", f"WITH {LI} SELECT DISTINCT series_key, timestamp_ns AS decoded FROM li")
def q22(spark, d):
    return q21(spark, d).select("series_key", codec.undelta(F.col("delta"), "series_key", "timestamp_ns").alias("decoded"))


EV_KEYS = "SELECT DISTINCT series_key FROM ev"


@query("q23_shards", f"WITH {EV}, k AS ({EV_KEYS}) SELECT CAST(h % 16 AS BIGINT) AS shard, count(*) AS series FROM {xxh64('k', 'series_key')} GROUP BY 1")
def q23(spark, d):
    ids = index.registry(from_events(spark, d)).withColumn("shard", identity.shard(identity.series_id(F.col("series_key")), 16))
    return ids.groupBy("shard").agg(F.count(F.lit(1)).alias("series"))


@query("q24_series_ids", f"WITH {EV}, k AS ({EV_KEYS}) SELECT series_key, CAST(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN CAST(h AS HUGEINT) - 18446744073709551616 ELSE CAST(h AS HUGEINT) END AS BIGINT) AS series_id, CAST(h AS DECIMAL(20, 0)) AS shown FROM {xxh64('k', 'series_key')}")
def q24(spark, d):
    id_ = identity.series_id(F.col("series_key"))
    return index.registry(from_events(spark, d)).select("series_key", id_.alias("series_id"), identity.unsigned(id_).alias("shown"))


@query("q25_size_tiers", f"""WITH RECURSIVE {LI}, s AS (SELECT chunk_id, count(*) * 100 + chunk_id AS size FROM li GROUP BY 1), o AS (SELECT size, row_number() OVER (ORDER BY size) AS n FROM s),
g AS (SELECT n, size, size AS least, 1 AS grp FROM o WHERE n = 1 UNION ALL
  SELECT o.n, o.size, CASE WHEN o.size <= 1.01 * g.least THEN g.least ELSE o.size END, CASE WHEN o.size <= 1.01 * g.least THEN g.grp ELSE g.grp + 1 END FROM g JOIN o ON o.n = g.n + 1)
SELECT min(size) AS least, max(size) AS most, count(*) AS chunks FROM g GROUP BY grp HAVING count(*) >= 2""")
def q25(spark, d):
    sizes = _chunked(spark, d).groupBy("chunk_id").agg((F.count(F.lit(1)) * 100 + F.col("chunk_id")).alias("size"))
    groups = sizes.agg(F.collect_list("size").alias("sizes")).select(F.explode(compaction.tier_column(F.col("sizes"), 2, 1.01)).alias("g"))
    return groups.select(F.array_min("g").alias("least"), F.array_max("g").alias("most"), F.size("g").cast("long").alias("chunks"))


@query("q26_merge", f"WITH {LI}, {LWW} SELECT series_key, timestamp_ns, value FROM lww")
def q26(spark, d):
    chunks = _chunked(spark, d).where("chunk_id % 2 = 0").unionByName(_chunked(spark, d).where("chunk_id % 2 = 1"))
    return ops.last_write(chunks).sortWithinPartitions("series_key", "timestamp_ns")


@query("q27_percentiles", f"WITH {LI}, v AS (SELECT series_key, list_sort(list(value)) AS vs, count(*) AS n FROM li GROUP BY 1) SELECT series_key, CAST(p AS DOUBLE) AS p, vs[CAST(floor((n - 1) * CAST(p AS DOUBLE)) AS BIGINT) + 1] AS result FROM v, (VALUES (0.5), (0.9), (0.95), (0.99)) AS t(p)")
def q27(spark, d):
    return metrics.nearest_rank(from_lineitem(spark, d), "series_key", "value", [0.5, 0.9, 0.95, 0.99])


HOUR = 3_600_000_000_000


@query("q28_throughput", f"WITH {EV} SELECT metric_name, timestamp_ns // {HOUR} AS hour, count(*) AS points, count(*) / 3600.0::DOUBLE AS per_second FROM ev GROUP BY ALL")
def q28(spark, d):
    hour = F.expr(f"timestamp_ns div {HOUR}").alias("hour")
    out = from_events(spark, d).groupBy("metric_name", hour).agg(F.count(F.lit(1)).alias("points"))
    return out.withColumn("per_second", metrics.rate(F.col("points"), F.lit(3600.0)))


LE = [10.0, 25.0, 50.0, 100.0, 250.0, 500.0]


@query("q29_histogram", f"WITH {EV} SELECT metric_name, le, CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS BIGINT) AS n FROM ev, (SELECT unnest({LE}) AS le) GROUP BY ALL")
def q29(spark, d):
    return metrics.histogram(from_events(spark, d), "metric_name", "value", LE)


@query("q30_batch_sequences", f"WITH {EV}, b AS (SELECT event_id // 250 AS batch, sum(CASE WHEN (event_id // 250) % 5 = 3 THEN 0 ELSE 1 END) AS points FROM ev GROUP BY 1) SELECT batch, CAST(points AS BIGINT) AS points, CAST(CASE WHEN points > 0 THEN sum(CASE WHEN points > 0 THEN 1 ELSE 0 END) OVER (ORDER BY batch) ELSE 0 END AS BIGINT) AS sequence FROM b")
def q30(spark, d):
    batch = F.floor(F.col("arrival") / 250)
    return log.numbered(from_events(spark, d).select(batch.alias("batch"), F.when(batch % 5 == 3, 0).otherwise(1).alias("points")))


@query("q31_replay", f"WITH {LI} SELECT series_key, timestamp_ns, arg_max(value, (l_orderkey, l_linenumber, l_partkey, l_suppkey, value)) AS value FROM li WHERE chunk_id > 5 GROUP BY ALL")
def q31(spark, d):
    return ops.last_write(log.replayed(_chunked(spark, d).withColumn("commit_seq", F.col("chunk_id")), 5))


@query("q32_collectable_segments", f"WITH {EV} SELECT event_id // 1000 AS segment, max(event_id) AS max_seq FROM ev GROUP BY 1 HAVING max(event_id) <= 4999")
def q32(spark, d):
    ev = from_events(spark, d)
    segments = ev.groupBy(F.floor(F.col("arrival") / 1000).alias("segment")).agg(F.max("arrival").alias("max_seq"))
    return log.collectable(segments, 4999)


SIZE = "SELECT series_key, metric_name, user_id, count(DISTINCT timestamp_ns) AS n FROM ev GROUP BY ALL"


@query("q33_buffer_size", f"WITH {EV}, s AS ({SIZE}) SELECT CAST(sum(n) AS BIGINT) AS entries, CAST(sum(32 * n + strlen(metric_name) + 7 + strlen(user_id) + 8) AS BIGINT) AS bytes FROM s")
def q33(spark, d):
    return ops.buffer_size(from_events(spark, d))


@query("q34_due_for_flush", f"WITH {EV}, s AS ({SIZE}), z AS (SELECT CAST(user_id AS BIGINT) % 16 AS shard, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(32 * n + strlen(metric_name) + 7 + strlen(user_id) + 8) AS BIGINT) AS bytes FROM s GROUP BY 1) SELECT * FROM z WHERE bytes >= 21000")
def q34(spark, d):
    ev = from_events(spark, d).withColumn("shard", F.element_at("tags", F.lit("user_id")).cast("long") % 16)
    return ops.due_for_flush(ops.buffer_size(ev, ["shard"]), 21000 * 16, 16)


@query("q35_key_crc32", f"WITH {EV}, k AS ({EV_KEYS}), {CRC_TABLE} SELECT series_key, CAST({crc32('series_key', 't')} AS BIGINT) AS crc FROM k, crc_table")
def q35(spark, d):
    return index.registry(from_events(spark, d)).select("series_key", F.crc32("series_key").alias("crc"))


@query("q36_stored_series", f"WITH {EV} SELECT series_key, timestamp_ns, value FROM ev WHERE metric_name = '{EV_METRIC}' AND user_id IN ('7')")
def q36(spark, d):
    """Through a written store: bloom filters, row-group statistics and the manifest prune, and nothing is missed."""
    engine = Engine(spark, Scratch(spark, "store").path)
    engine.append(from_events(spark, d).withColumn("commit_pos", F.col("arrival")), flush=True)
    return engine.query(EV_METRIC, {"user_id": "7"}, with_labels=True).select(*POINT)


@query("q37_chunk_bounds", f"WITH {LI} SELECT chunk_id, min(timestamp_ns) AS time_start_ns, max(timestamp_ns) AS time_end_ns, count(*) AS entry_count, count(DISTINCT series_key) AS series_count FROM li GROUP BY 1")
def q37(spark, d):
    return index.file_bounds(_stats(spark, d))


@query("q38_key_encode", f"WITH {EV}, {OD} SELECT DISTINCT series_key FROM ev UNION SELECT DISTINCT series_key FROM od")
def q38(spark, d):
    both = from_events(spark, d).select("metric_name", "tags").unionByName(from_orders(spark, d).select("metric_name", "tags"))
    return both.select(identity.series_key(F.col("metric_name"), F.col("tags")).alias("series_key")).distinct()


@query("q39_key_decode", f"WITH {OD} SELECT DISTINCT series_key, 'orders.totalprice' AS metric_name, priority, status FROM od")
def q39(spark, d):
    keys = from_orders(spark, d).select("series_key").distinct()
    tags = identity.key_tags(F.col("series_key"))
    return keys.select("series_key", identity.key_metric(F.col("series_key")).alias("metric_name"), F.element_at(tags, F.lit("priority")).alias("priority"), F.element_at(tags, F.lit("status")).alias("status"))


@query("q40_compacted_store", f"WITH {LI}, {LWW} SELECT series_key, timestamp_ns, value FROM lww WHERE timestamp_ns >= {Y1996}")
def q40(spark, d):
    """Two commits, the later of which rewrites timestamps, merged by compaction and read back."""
    engine = Engine(spark, EngineConfig(base=Scratch(spark, "store").path, compaction_threshold=2, compaction_ratio=1e6))
    li = from_lineitem(spark, d)
    # one row for each timestamp and half: the arrival struct itself decides within a half
    low, high = li.where("arrival.l_orderkey < 7000"), li.where("arrival.l_orderkey >= 7000")
    for half in (low, high):
        engine.append(ops.last_write(half, keep=["metric_name", "tags"]), flush=True)
    engine.compact()
    return engine.query(LI_METRIC, start=Y1996, with_labels=True).select(*POINT)


@query("q41_last_values", f"WITH {EV} SELECT series_key, arg_max(value, event_id) AS last FROM ev GROUP BY 1")
def q41(spark, d):
    return metrics.gauges(from_events(spark, d), "series_key", "arrival", "value")


@query("q42_counters", f"WITH {EV} SELECT metric_name, count(*) AS total FROM ev GROUP BY 1")
def q42(spark, d):
    return metrics.counters(from_events(spark, d), "metric_name")


@query("q43_deregister", f"WITH {LI}, {STATS} SELECT series_key, chunk_id, entry_count FROM st WHERE chunk_id NOT IN (1, 3)")
def q43(spark, d):
    st = _stats(spark, d)
    return index.deregister(st, st.where("chunk_id in (1, 3)").select("chunk_id").distinct()).select("series_key", "chunk_id", "entry_count")


@query("q44_compaction_totals", f"WITH {LI}, s AS (SELECT chunk_id % 3 AS grp, count(DISTINCT chunk_id) AS chunks, count(*) * 24 AS old_bytes, count(DISTINCT (series_key, timestamp_ns)) * 24 AS new_bytes FROM li GROUP BY 1) SELECT CAST(sum(chunks) AS BIGINT) AS chunks_merged, CAST(sum(greatest(0, old_bytes - new_bytes)) AS BIGINT) AS bytes_freed FROM s")
def q44(spark, d):
    one = _chunked(spark, d).groupBy((F.col("chunk_id") % 3).alias("grp"), "chunk_id", "series_key", "timestamp_ns").agg(F.count(F.lit(1)).alias("c"))
    merged = one.groupBy("grp").agg(F.countDistinct("chunk_id").alias("chunks"), (F.sum("c") * 24).alias("old_bytes"), (F.countDistinct("series_key", "timestamp_ns") * 24).alias("new_bytes"))
    return compaction.freed(merged)


@query("q45_labelled_result", f"WITH {OD} SELECT series_key, timestamp_ns, value, priority FROM od WHERE status = 'O'")
def q45(spark, d):
    """Results joined with the registry to give the labels of their series."""
    points = from_orders(spark, d)
    labels = index.registry(points).select("series_key", F.element_at("tags", F.lit("priority")).alias("priority"))
    return ops.select_points(points, OR_METRIC, {"status": "O"}).select(*POINT).join(labels, "series_key")


@query("q46_stats_pruning_lt", f"WITH {LI}, {STATS} SELECT series_key, chunk_id FROM st WHERE min_value < 1200")
def q46(spark, d):
    return index.prune(_stats(spark, d), predicate=ValuePredicate.lt(1200)).select("series_key", "chunk_id")


@query("q47_missing_stats", f"WITH {LI}, {STATS} SELECT series_key, chunk_id FROM st WHERE chunk_id % 2 = 0 OR max_value > 55000")
def q47(spark, d):
    """Statistics joined from the left, half of them missing: what has none is kept."""
    st = _stats(spark, d)
    have = st.where("chunk_id % 2 = 1").select("series_key", "chunk_id", "min_value", "max_value")
    entries = st.drop("min_value", "max_value").join(have, ["series_key", "chunk_id"], "left")
    return index.prune(entries, predicate=ValuePredicate.gt(55000)).select("series_key", "chunk_id")


@query("q48_tiers_of_nonzero", f"""WITH RECURSIVE {LI}, s AS (SELECT CASE WHEN chunk_id % 5 = 0 THEN 0 ELSE count(*) * 100 + chunk_id END AS size FROM li GROUP BY chunk_id), o AS (SELECT size, row_number() OVER (ORDER BY size) AS n FROM s WHERE size > 0),
g AS (SELECT n, size, size AS least, 1 AS grp FROM o WHERE n = 1 UNION ALL
  SELECT o.n, o.size, CASE WHEN o.size <= 1.01 * g.least THEN g.least ELSE o.size END, CASE WHEN o.size <= 1.01 * g.least THEN g.grp ELSE g.grp + 1 END FROM g JOIN o ON o.n = g.n + 1)
SELECT min(size) AS least, max(size) AS most, count(*) AS chunks FROM g GROUP BY grp HAVING count(*) >= 2""")
def q48(spark, d):
    """Size tiers where every fifth chunk is empty."""
    size = F.when(F.col("chunk_id") % 5 == 0, 0).otherwise(F.count(F.lit(1)) * 100 + F.col("chunk_id"))
    sizes = _chunked(spark, d).groupBy("chunk_id").agg(size.alias("size"))
    groups = sizes.agg(F.collect_list("size").alias("sizes")).select(F.explode(compaction.tier_column(F.col("sizes"), 2, 1.01)).alias("g"))
    return groups.select(F.array_min("g").alias("least"), F.array_max("g").alias("most"), F.size("g").cast("long").alias("chunks"))


NAN_VALUE = "CASE WHEN event_id % 3 = 0 THEN 'nan'::DOUBLE ELSE value END"


@query("q49_values_with_nan", f"WITH {EV}, n AS (SELECT series_key, timestamp_ns, {NAN_VALUE} AS value FROM ev) SELECT series_key, timestamp_ns, value FROM n WHERE value > 10 AND NOT isnan(value)")
def q49(spark, d):
    """NaN satisfies no predicate, though it sorts above every number."""
    ev = from_events(spark, d).withColumn("value", F.when(F.col("arrival") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return ev.where(ValuePredicate.gt(10).row(F.col("value"))).select(*POINT)


@query("q50_interleaved_store", f"WITH {EV} SELECT series_key, timestamp_ns, arg_max(v, (k, v)) AS value FROM (SELECT series_key, timestamp_ns, k, value + k AS v FROM ev, (VALUES (0), (1), (2)) t(k) WHERE event_id % (k + 1) = 0) GROUP BY ALL")
def q50(spark, d):
    """Three writers with engines of their own on one store, the second behind a flush and a compaction of the others."""
    base = Scratch(spark, "store").path
    writers = [Engine(spark, EngineConfig(base=base, compaction_threshold=2, compaction_ratio=1e6)) for _ in range(3)]
    ev = from_events(spark, d)
    for k, w in enumerate(writers):
        w.append(ev.where(F.col("arrival") % (k + 1) == 0).withColumn("value", F.col("value") + k), flush=k < 2)
    writers[0].compact()
    metrics_ = [r[0] for r in writers[0].series().select("metric_name").distinct().collect()]  # the event types
    out = [writers[2].query(m, with_labels=True).select(*POINT) for m in sorted(metrics_)]
    return reduce(DataFrame.unionByName, out)


@query("q51_log_frames", f"WITH {EV}, k AS ({EV_KEYS}), {CRC_TABLE}, c AS (SELECT series_key, lpad(printf('%x', CAST(strlen(series_key) AS BIGINT)), 8, '0') AS n, lpad(printf('%x', CAST({crc32('series_key', 't')} AS BIGINT)), 8, '0') AS c FROM k, crc_table) SELECT series_key, upper(n[7:8] || n[5:6] || n[3:4] || n[1:2] || c[7:8] || c[5:6] || c[3:4] || c[1:2]) || hex(encode(series_key)) AS frame FROM c")
def q51(spark, d):
    return index.registry(from_events(spark, d)).select("series_key", F.hex(frames.frame(F.encode("series_key", "UTF-8"))).alias("frame"))


@query("q52_sorted_store", f"WITH {LI} SELECT series_key, count(*) AS n, CAST(0 AS BIGINT) AS out_of_order FROM li GROUP BY 1")
def q52(spark, d):
    """Rows of a chunk's files that stand before an earlier key or time of the same file: none."""
    engine = Engine(spark, Scratch(spark, "store").path)
    engine.append(from_lineitem(spark, d).withColumn("commit_pos", F.col("arrival.l_orderkey")), flush=True)
    [chunk] = engine.log.load().chunks
    rows = spark.read.parquet(chunk.path).select("series_key", "timestamp_ns", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    before = F.lag(F.struct("series_key", "timestamp_ns")).over(Window.partitionBy("file").orderBy("at"))
    late = F.coalesce(before > F.struct("series_key", "timestamp_ns"), F.lit(False))
    return rows.withColumn("late", late).groupBy("series_key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("late").cast("long")).alias("out_of_order"))


# Beyond the model: time buckets over any of these series.


@query("x01_downsample", f"WITH {EV} SELECT series_key, timestamp_ns // {24 * HOUR} AS day, count(*) AS n, min(value) AS least, max(value) AS most, avg(value) AS mean FROM ev GROUP BY ALL")
def x01(spark, d):
    day = F.expr(f"timestamp_ns div {24 * HOUR}").alias("day")
    v = F.col("value")
    return from_events(spark, d).groupBy("series_key", day).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"))


@query("x02_top_series", f"WITH {EV} SELECT series_key, sum(value) AS total FROM ev GROUP BY 1 ORDER BY total DESC, series_key LIMIT 10")
def x02(spark, d):
    return from_events(spark, d).groupBy("series_key").agg(F.sum("value").alias("total")).orderBy(F.desc("total"), "series_key").limit(10)
