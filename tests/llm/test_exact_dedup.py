import hashlib

import oracle
import pytest

from seriesloom.llm import exact_dedup as ed
from seriesloom.plans.scratch import Scratch

COLUMNS = "doc_id bigint, text string, digest int, keep_id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], COLUMNS)


def test_same_as_sql(spark):
    oracle.assert_same(spark, ed.op10, ed.OP10_SQL)


def test_longest_then_smallest_stays(spark):
    rows = [(5, "a b"), (3, "ab"), (4, " a\tb "), (9, "\x0ba b \n"), (7, None), (6, ""), (8, " "), (None, "ab"), (2, "a b"), (1, "é"), (1, "é")]
    docs, index = docs_of(spark, rows), ed.DigestIndex(spark, buckets=3)
    got = ed.dedup(docs, index, "b", Scratch(spark, "t"))
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, "é"), (2, "a b"), (8, " "), (9, "\x0ba b \n")]
    index.close(delete=True)


def test_later_batches_meet_the_index(spark, tmp_path):
    index = ed.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    first = ed.dedup(docs_of(spark, [(1, "one"), (2, "two")]), index, "first", Scratch(spark, "t")).count()
    index.close()
    again = ed.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    rows, groups = ed.verdicts(docs_of(spark, [(0, "t w o"), (3, "three")]), again, "second", Scratch(spark, "t"))
    found = {r["digest"].hex(): (r["keep_id"], r["fresh"]) for r in groups.collect()}
    assert first == 2 and rows.count() == 2
    assert found == {hashlib.sha256(b"two").hexdigest(): (2, False), hashlib.sha256(b"three").hexdigest(): (3, True)}
    assert again.read().count() == 3
    plan = again.missing(groups.select("digest"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    again.close()


def test_hot_group_and_empty_table(spark):
    rows = [(i, "hot " * (i % 3 + 1)) for i in range(300)] + [(1000 + i, f"own {i}") for i in range(50)]
    index = ed.DigestIndex(spark, buckets=2)
    got = ed.dedup(docs_of(spark, rows), index, "b", Scratch(spark, "t"))
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2, *range(1000, 1050)]
    assert ed.dedup(docs_of(spark, []), index, "none", Scratch(spark, "t")).count() == 0
    index.close(delete=True)


class Lost(Exception):
    pass


def test_a_batch_run_again_loses_nothing(spark, tmp_path, monkeypatch):
    batch = docs_of(spark, [(1, "one"), (2, "two"), (3, "t wo"), (4, "old")])
    index = ed.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    assert ed.dedup(docs_of(spark, [(0, "o l d")]), index, "earlier", Scratch(spark, "t")).count() == 1
    append = ed.DigestIndex.append

    def lost(self, fresh):
        append(self, fresh)
        raise Lost  # the driver goes between the append and the result

    monkeypatch.setattr(ed.DigestIndex, "append", lost)
    with pytest.raises(Lost):
        ed.dedup(batch, index, "b1", Scratch(spark, "t"))
    monkeypatch.undo()
    index.close()
    for _ in range(2):
        with ed.DigestIndex(spark, f"file://{tmp_path}/index") as again:
            assert again.buckets == 4
            got = ed.dedup(batch, again, "b1", Scratch(spark, "t"))
            assert sorted(r["doc_id"] for r in got.collect()) == [1, 3] and again.read().count() == 3
    with ed.DigestIndex(spark, f"file://{tmp_path}/index") as again:
        assert ed.dedup(batch, again, "b2", Scratch(spark, "t")).count() == 0


def test_another_number_of_buckets_is_refused(spark, tmp_path):
    with ed.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4) as index:
        ed.dedup(docs_of(spark, [(i, f"text {i}") for i in range(50)]), index, "a", Scratch(spark, "t"))
    with pytest.raises(ValueError, match="has 4 buckets, not 7"):
        ed.DigestIndex(spark, f"file://{tmp_path}/index", buckets=7)
    with ed.DigestIndex(spark, f"file://{tmp_path}/index") as index:  # whatever the session's partitions are
        assert ed.dedup(docs_of(spark, [(i, f"text {i}") for i in range(60)]), index, "b", Scratch(spark, "t")).count() == 10


def test_merging_keeps_the_index_and_its_order_is_used(spark, tmp_path):
    index = ed.DigestIndex(spark, f"file://{tmp_path}/index", buckets=2, max_files=3)
    for k in range(5):
        assert ed.dedup(docs_of(spark, [(i, f"text {i}") for i in range(k * 10, k * 10 + 15)]), index, f"b{k}", Scratch(spark, "t")).count() == (15 if k == 0 else 10)
    assert index.generation >= 1 and index.read().count() == 55
    index.merge()
    assert index.files_a_bucket() == 1 and index.read().count() == 55
    keys = Scratch(spark, "t").keep(index.read().select("digest"))
    with index.in_order():
        plan = index.missing(keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1  # the batch's, none of the index
    index.close()
    with ed.DigestIndex(spark, f"file://{tmp_path}/index") as again:
        assert again.read().count() == 55


def test_copies_of_one_row_and_long_texts(spark, tmp_path):
    long = "w\u00e9 " * 1_500_000
    rows = [(1, "x"), (1, "x"), (1, "x"), (2, "x"), (None, " "), (None, " "), (3, long), (4, long + " ")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    oracle.assert_same(spark, ed.op10, ed.OP10_SQL, str(tmp_path))
    got = ed.op10(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0) for r in got if r["kept"]) == [0, 1, 4] and len(got) == 8
