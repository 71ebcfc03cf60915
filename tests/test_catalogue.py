import oracle
import pytest
import xxhash
import zlib

from seriesloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, name):
    oracle.assert_same(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_every_query_has_sql_and_rows(spark):
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_due_shards_are_some_but_not_all(spark):
    assert 0 < catalogue.QUERIES["q34_due_for_flush"](spark, oracle.SF).count() < 16


def test_sql_hashes():
    import duckdb

    from seriesloom.plans import sql

    keys = ["", "a", "abc", "x" * 32, *("é=,|"[i % 4] + "y" * i for i in range(70))]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(k,) for k in keys])
    assert dict(con.sql(f"SELECT k, h FROM {sql.xxh64('t', 'k')}").fetchall()) == {k: xxhash.xxh64_intdigest(k.encode()) for k in keys}
    got = con.sql(f"WITH {sql.CRC_TABLE} SELECT k, {sql.crc32('k', 'c.t')} FROM t, crc_table c").fetchall()
    assert dict(got) == {k: zlib.crc32(k.encode()) for k in keys}


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
