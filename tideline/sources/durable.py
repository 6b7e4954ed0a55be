"""Durable copies of intermediate results, in the folder that the driver and all executors share.

What is written here is deleted when the application ends.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Unset, a local master gets a temporary one; a cluster is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'tideline-shared')}"


def file_system(spark: SparkSession, path: str):
    """The file system of a path and the path, of the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete_at_end(spark: SparkSession, path: str) -> None:
    files, at = file_system(spark, path)
    files.deleteOnExit(at)


def keep(df: DataFrame) -> DataFrame:
    """The rows, written below spark.checkpoint.dir and reread: later plans start from files, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_landed: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, name: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that many queries start from, kept once in an application under a name that tells its inputs, which must not change meanwhile."""
    key = (spark.sparkContext.applicationId, *name)
    if key not in _landed:
        _landed[key] = keep(make())
    return _landed[key]
