"""What the operators of this subpackage share: table access, shared scratch space, row keys."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from functools import cache

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (a local test session), a temporary folder is used, and only for a local master.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_dir()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@cache
def _run_dir(spark: SparkSession, base: str) -> str:
    """This application's own folder in the shared one; it goes when the driver's Python ends."""
    path = f"{base}/run-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"

    def clean() -> None:
        try:
            _delete(spark, path)
        except (Py4JError, OSError):  # the JVM has gone before
            return

    atexit.register(clean)
    return path


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path for intermediate data."""
    return f"{_run_dir(spark, shared_dir(spark))}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Write to the shared folder as Parquet and read it again: lineage ends here, and lost executors cost no recomputation.

    file_rows: for rows that are large, the most in a file, which is then compressed harder; 0 for no limit.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "table")
    (df.write.option("maxRecordsPerFile", file_rows).option("compression", "zstd") if file_rows else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` wrote and nothing reads any more; other tables, and None, are left alone."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            _delete(df.sparkSession, path)


def give_back() -> None:
    """Return memory that this Python process has freed to the system, as far as its C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


BATCH_ROWS = 1000


def short_batches(df: DataFrame) -> DataFrame:
    """``df``, to be sent to Python: unless the session says otherwise, in batches of BATCH_ROWS rows, as texts can be long.

    Spark reads this setting when the plan runs, which is after the operator has returned, so it stays set.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def fold_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fifth(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 marks the held-out rows. Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` whose sides are both dealt anew, so that adaptive execution can split a hot key.

    ``right`` is usually an aggregate by ``key``. Without the second key column Spark would keep its partitioning,
    and a side that isn't read straight from a shuffle is never split.
    """
    mark = "__deal"
    return left.withColumn(mark, F.xxhash64(key)).join(right.withColumn(mark, F.xxhash64(key)), [key, mark], how).drop(mark)
