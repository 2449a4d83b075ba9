"""Append-only logs and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running_below


def dedupe_final_wins(log: DataFrame, key: str, final: Column, order: str) -> DataFrame:
    """One row per key: a final record beats others; among equals the last written stays, then the greatest record. Partially aggregated.

    On a stream (update or complete mode) the state is one record per key, so a late final record replaces a provisional one
    and a later provisional one never replaces a final one.
    """
    rec = F.struct(*[F.col(c) for c in log.columns])
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(rec, F.struct(F.coalesce(final, F.lit(False)), F.col(order), rec)).alias("r")).select("r.*")


def last_wins(log: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last written."""
    return dedupe_final_wins(log, key, F.lit(True), order)


def final_ids(log: DataFrame, key: str, final: Column) -> DataFrame:
    """Keys that have a final record."""
    return log.where(final & F.col(key).isNotNull()).select(key).distinct()


def todo(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys of wanted that done lacks."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(done.select(key), key, "left_anti")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the order of their first occurrence."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def settled_dates(events: DataFrame, date: str, final: Column, today: Column) -> DataFrame:
    """(date, n, authoritative): a date is settled if it lies strictly before today and all of its events are final."""
    return events.groupBy(date).agg(F.count("*").alias("n"), F.every(final).alias("all_final")).select(date, "n", ((F.col(date) < today) & F.col("all_final")).alias("authoritative"))


def read_log(spark, path: str, schema: str, key: str, final: Column | None = None) -> DataFrame:
    """Append-only JSON lines: blank and torn lines and those without the key are skipped, final records win, then the later line.

    The order of writing is that of (file name, place in the file); schema must not have a column `line`.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rec = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.struct("file", "block", "at").alias("line")).where(F.col("r").isNotNull())
    out = dedupe_final_wins(rec.select("r.*", "line"), key, final if final is not None else F.lit(True), "line")
    return out.drop("line")


def conflicts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value, and how many they have."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row (n, positives, auc): Mann-Whitney, ties count half; null if a class is empty.

    Counts per score come first; the running sum over them is taken range by range.
    """
    per = scored.groupBy(score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    per = running_below(per, score, "n", "below")
    total = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2))
    return per.agg((F.sum("p") + F.sum("n")).alias("n"), F.sum("p").alias("positives"), F.try_divide(total, (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))
