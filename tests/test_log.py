import random

from seriesloom.operators import log


def numbered(rows):
    out, n = [], 0
    for batch in sorted({b for b, _ in rows}, key=lambda b: (b is not None, b)):
        points = sum(p for b, p in rows if b == batch)
        n += points > 0
        out.append((batch, points, n if points > 0 else 0))
    return out


def run(spark, rows):
    got = log.numbered(spark.createDataFrame(rows, "batch bigint, points bigint"))
    return sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r[0]))


def test_sequences_run_on_over_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(700), rng.choice([0, 0, 1, 9])) for _ in range(1500)] + [(None, 2), (None, 1)]
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for parts, coalesce in (("1", "true"), ("4", "true"), ("13", "false")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            assert run(spark, rows) == numbered(rows)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_few_batches(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, 0), (1, 0)]) == [(1, 0, 0), (3, 0, 0)]
    assert run(spark, [(8, 5), (2, 1), (8, 0)]) == [(2, 1, 1), (8, 5, 2)]
