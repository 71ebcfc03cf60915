import re
from collections import Counter

import oracle
import pytest

from seriesloom.llm import mixing
from seriesloom.plans.scratch import Scratch

COLUMNS = "doc_id bigint, text string, source string, extra int, size int"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_water_fill_caps_and_reshares():
    got = mixing.water_fill([("b", 100), ("a", 10), (None, 1000), ("c", 300)])
    assert [(s.name, s.weight) for s in got] == [("a", 5), ("b", 2), ("c", 1), (None, 5)]
    assert got[0].target == 30 and sum(s.target for s in got) == pytest.approx(1410)
    assert all(s.target <= 3 * s.size for s in got)
    free = [s.target / s.weight for s in got if s.target < 3 * s.size]
    assert max(free) == pytest.approx(min(free))
    assert mixing.water_fill([]) == [] and mixing.water_fill([("a", 0)])[0].target == 0


def test_taken_meets_targets(spark):
    rows = [(i, words(1 + i * 37 % 400), f"s{i % 4}" if i % 9 else None, i, i) for i in range(300)] + [(900, None, "s0", 1, 1), (None, "a b", "s1", 1, 1), (5, "x", "s1", 1, 1), (5, "x", "s1", 1, 1)]
    mix = mixing.Mix(docs_of(spark, rows), Scratch(spark, "t"), block=16, bucket_rows=20, chunk=64)
    got = mix.taken().collect()
    assert len(got) == len(rows)
    by = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]] += r["taken"]
    for s in mix.sources:
        assert abs(by[s.name] - s.target) <= 1
    # the stream holds each slot's words once, and slots alternate between sources
    stream = mix.stream().orderBy("slot", "offset").collect()
    assert sum(r["taken"] for r in stream) == sum(by.values())
    again = mixing.Mix(docs_of(spark, rows), Scratch(spark, "t"), block=16, bucket_rows=7, chunk=13).taken()
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got))


def test_prefixes_of_the_schedule_keep_to_the_weights(spark):
    rows = [(i, words(100, f"{i}-"), "abc"[i % 3], 0, 0) for i in range(300)]
    mix = mixing.Mix(docs_of(spark, rows), Scratch(spark, "t"), block=20)
    slots = [r["s"] for r in mix.slots.orderBy("slot").collect()]
    share = [s.target / 30_000 for s in mix.sources]
    for n in (50, 100, 400, 1000):
        seen = Counter(slots[:n])
        assert all(abs(seen[k] - n * p) <= 6 for k, p in enumerate(share))


def test_mixed_keeps_columns_and_repeats_documents(spark):
    rows = [(i, words(50, f"{i}-"), "a" if i < 4 else "b", i, 7) for i in range(40)] + [(90, None, "a", 1, 1), (None, "q r s", "b", 2, 2), (None, "q r s", "b", 2, 2)]
    docs = docs_of(spark, rows)
    mix = mixing.Mix(docs, Scratch(spark, "t"), block=16)
    got = mixing.mixed(docs, mix)
    assert got.columns == docs.columns
    times = Counter(r["doc_id"] for r in got.collect())
    assert all(times[i] == 3 for i in range(4)) and times[90] == 1
    assert times[None] == sum(r["starts"] for r in mix.taken().where("doc_id is null").collect())


def test_empty_table(spark):
    docs = docs_of(spark, [])
    mix = mixing.Mix(docs, Scratch(spark, "t"))
    assert mix.taken().count() == 0 and mixing.mixed(docs, mix).count() == 0


def test_sizes_of_the_whole_table(spark):
    got = {r["doc_id"]: r for r in mixing.op2(spark, oracle.SF).collect()}
    _, rows = oracle.duck("SELECT doc_id, text FROM documents")
    assert len(got) == len(rows)
    assert all(got[i]["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows)


def test_same_as_sql(spark):
    oracle.assert_same(spark, mixing.op2, mixing.OP2_SQL)


def test_long_texts_and_too_many_sources(spark):
    rows = [(1, "a", "word " * 1_000_000), (2, "a", "two words"), (3, "b", "x " * 10), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = {r["doc_id"]: r for r in mixing.Mix(docs, Scratch(spark, "t")).taken().collect()}
    assert got[1]["size"] == 1_000_000 and got[3]["taken"] == 30 and got[4]["taken"] == 0
    assert got[1]["taken"] + got[2]["taken"] == 1_000_012 - 30
    with pytest.raises(ValueError, match="more than 2 sources"):
        mixing.Mix(docs, Scratch(spark, "t"), most_sources=2)
