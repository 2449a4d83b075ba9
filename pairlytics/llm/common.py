"""Helpers shared by the training-data operators.

Nothing outside this subpackage imports it. All helpers are plain DataFrame code; the few Python
functions here run inside tasks on Arrow batches.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows (of a few dozen bytes each) up to which a side may be broadcast; above it joins shuffle.
BROADCAST_ROWS = 200_000

SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
DEFAULTS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "false", "spark.sql.execution.arrow.maxBytesPerBatch": "64m"}
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, only a local master may go on, with a new folder of its own (tests); on a cluster no executor
    would see the driver's folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


@contextmanager
def settings_of_jobs(spark: SparkSession):
    """For the queries inside: shuffle files go when a query ends (what it gave is written by then), and Python gets small batches."""
    before = {k: spark.conf.get(k, v) for k, v in DEFAULTS.items()}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairlytics-{uuid.uuid4().hex}"
    with settings_of_jobs(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Paths in a folder of the shared store; none if it doesn't exist."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().toString() for x in fs.listStatus(p)) if fs.exists(p) else []


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables that `stored` gave, once all that reads them is written itself."""
    for t in tables:
        drop_path(t.sparkSession, t.stored_at)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (counted), else df as it is, joined by shuffle.

    df should be cheap to compute twice (stored, or an aggregate of something stored).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character kept. All-ASCII texts take the cheap built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def split_words(c: Column, separators: str = SPACE) -> Column:
    """Array of the maximal runs of characters outside `separators` (a regex class with +); null gives none."""
    return F.coalesce(F.array_remove(F.split(c, separators), F.lit("")), F.array().cast("array<string>"))


def unique_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name = "_" + name
    return name


def split_join(rows: DataFrame, counts: DataFrame, key: str, freq: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to counts (one row per key) on `key`, safe against hot keys.

    `freq` is the column of counts that tells how many of the `total` rows have the key. Keys with more than
    max(1000, total / BROADCAST_ROWS) of them are at most BROADCAST_ROWS in number and are broadcast; the others are
    joined by shuffle, where no key has more rows than that. counts should be stored. Rows whose key is absent stay only
    if how is "left".
    """
    limit = max(1000, total // BROADCAST_ROWS)
    hot = counts.where(F.col(freq) > limit).drop(freq)
    cold = counts.where(F.col(freq) <= limit).drop(freq)
    keys = F.broadcast(hot.select(key))
    big = rows.join(F.broadcast(hot), key)
    rest = rows.join(keys, key, "left_anti").join(cold, key, how)
    return big.unionByName(rest)
