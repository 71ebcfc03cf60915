import time

from seriesloom.plans.engine import Engine
from seriesloom.sources.points import synthetic
from seriesloom.streaming.ingest import file_source, ingest
from seriesloom.streaming.progress import Progress


def test_text():
    p = Progress([1.0, 5.0])
    for rows, s in ((10, 0.5), (0, 1.0), (5, 3.0), (1, 9.0)):
        p.record(rows, s)
    assert "seriesloom_ingest_rows_total 16\n" in p.text()
    assert '{le="1"} 2\n' in p.text() and '{le="5"} 3\n' in p.text() and '{le="+Inf"} 4\n' in p.text()


def test_listens_to_ingest(spark, tmp_path):
    listener = Progress()
    spark.streams.addListener(listener)
    try:
        synthetic(spark, 120, 7).write.parquet(f"{tmp_path}/src")
        ingest(file_source(spark, f"{tmp_path}/src"), Engine(spark, f"file://{tmp_path}/store"), f"{tmp_path}/ck").awaitTermination()
        for _ in range(50):
            if listener.totals["rows"] >= 120:
                break
            time.sleep(0.2)
        assert listener.totals["rows"] >= 120 and listener.totals["started"] == 1
    finally:
        spark.streams.removeListener(listener)
