"""Written intermediate tables: they cut lineage and outlive any one executor.

They go to the shared folder that the cluster names in ``spark.checkpoint.dir``. Only where that is
unset, as in local tests, a folder of our own is chosen.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: How scratch tables are written: without a marker, and on local disks without checksum files. Where Hadoop has no native library, every
#: file and folder there costs a ``chmod`` process, started by an executor that for a moment counts twice in the memory of its processes.
PLAIN = {
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(app)
    if not base:
        if spark.sparkContext.master.startswith("local["):
            base = tempfile.mkdtemp(prefix="seriesloom-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
            base = f"file://{base}"
        else:  # the warehouse is shared by definition
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        _OWN[app] = base
    return base.rstrip("/")


class Scratch:
    """A folder of written tables for one operator call.

    The result of an operator is lazy and may read them, so whoever consumes it closes the scratch, or uses it as a context; what is
    left open goes when the session's driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/seriesloom/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _close_at_exit(spark, self.path)

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """Writes ``df`` as Parquet and returns the written table."""
        self._n += 1
        at = f"{self.path}/{self._n}"
        df.write.options(**PLAIN).option("compression", codec).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of ``keep`` that no later plan reads."""
        for df in tables:
            remove(self.spark, df._scratch_path)

    def close(self) -> None:
        """Deletes all tables; a result that still reads them must have been written before."""
        remove(self.spark, self.path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.close()


_LEFT: dict[str, set[str]] = {}


def _close_at_exit(spark: SparkSession, path: str) -> None:
    """Has the JVM delete ``path`` when the driver ends, by Hadoop's own hook for such folders."""
    app = spark.sparkContext.applicationId
    if path not in _LEFT.setdefault(app, set()):
        _LEFT[app].add(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)  # only what exists can be marked
        fs.deleteOnExit(p)


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver as literals, so that no task reads Python's rows."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While it lasts, Arrow batches to Python hold fewer rows: for long texts and actions inside the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)
