import zlib

import oracle
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import sharding
from seriesloom.plans.scratch import Scratch


def place(spark, rows, shards=4, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sharding.assign(sharding.keyed(df), shards, Scratch(spark, "t"), **more).collect()


def test_same_as_sql(spark):
    oracle.assert_same(spark, sharding.op8, sharding.OP8_SQL)


def test_clashing_columns_ties_and_long_texts(spark):
    rows = [(i, ("t" * (i % 5 + 1)) if i else "w\u00e9 " * 2_000_000) for i in range(200)] + [(7, "ttt"), (7, "ttt"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    clash = {c: F.lit("clash") for c in ("shard", "slot", "law", "range")}
    got = sharding.assign(sharding.keyed(df).withColumns(clash), 4, Scratch(spark, "t")).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"clash"} and all(isinstance(r["shard"], int) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        text = rows[r["doc_id"]][1] if r["doc_id"] is not None else ""
        assert r["text_crc32"] == zlib.crc32(text.encode()) and r["size"] == len(text.encode()) + 8
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("hot", [0, 400])
def test_sizes_are_near_equal_and_slots_gapless(spark, hot):
    rows = [(i, f"text {i} " * (i % 7 + 1)) for i in range(600)] + [(1000 + i, "one hot text of many copies") for i in range(hot)]
    got = place(spark, rows, ranges=64)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == [0, 1, 2, 3] and len(got) == len(rows)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)


def test_odd_inputs(spark):
    assert place(spark, []) == []
    got = place(spark, [(None, None), (None, None), (3, ""), (3, ""), (4, "x" * 100_000)])
    assert len(got) == 5 and sorted(r["size"] for r in got) == [8, 8, 8, 8, 100_008]
