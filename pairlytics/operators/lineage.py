"""Intermediate tables: written once to the folder that driver and executors share, read again as often as needed.

A written table cuts the plan, survives lost executors, keeps no memory and holds row counts for the planner. Tables are
deleted by `release`, which callers run once a result is written, or when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, only a local master may go on, with a new folder of its own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder, which `release` deletes."""
    path = f"{shared_dir(spark)}/pairlytics-table-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, computed once, written as Parquet and read back."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(table: DataFrame) -> None:
    """Delete a table that `stored` gave, once all that reads it is written itself."""
    _written.remove(table.stored_at)
    delete(table.sparkSession, table.stored_at)


def release() -> int:
    """Delete all tables written so far, and return their number: for callers that no longer read a result of before."""
    spark, n = SparkSession.getActiveSession(), len(_written)
    if spark is None or spark.sparkContext._jsc is None:
        return 0
    while _written:
        delete(spark, _written.pop())
    return n


atexit.register(release)
