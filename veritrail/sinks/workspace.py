"""A folder for tables that a query writes and reads again: in the folder that all machines share, deleted when the JVM ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a folder of our own in local mode, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{(where or tempfile.mkdtemp(prefix='veritrail-')).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()
