"""A folder that driver and executors share, for queries that read files or streams of their own."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only on one machine, as in tests, is a folder made where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.gettempdir()


def path(spark: SparkSession, name: str) -> str:
    """A new path in it, deleted when the driver ends."""
    out = f"{shared_dir(spark)}/bitloom-{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def delete() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(out)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session is gone already; the folder's owner cleans up
            pass

    atexit.register(delete)
    return out
