"""Small helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import functools
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only when its size and its counted rows stay below these.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a private one is
    made on one machine, as in tests; on a cluster executors would write to disks of their own, so
    there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = _private()
    return where.rstrip("/")


@functools.cache
def _private() -> str:
    return "file://" + tempfile.mkdtemp(prefix="bitloom-")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already; the folder's owner cleans up
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/bitloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def stored(df: DataFrame, name: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Write df to a table in the shared folder and read it back: this cuts lineage, survives
    lost executors and gives the optimizer true sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    for old in drop:
        _delete(spark, old.rpartition("/")[0] if old.endswith(".parquet") else old)
    return out


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done: it does so once their DataFrames
    are collected as garbage, a moment later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its plan has at most BROADCAST_BYTES (of a stored table: its
    files' size) and it has at most `rows` rows, else unchanged (then Spark joins by shuffle and
    splits skewed partitions). The count stops at the bound."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows else df


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
