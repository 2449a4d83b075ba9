"""Executable quality gates: each returns the rows that break a rule, or one row that says whether it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def out_of_range(rows: DataFrame, key: str, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """(key, field, value) of the values outside their field's range; null values pass. One scan for all rules."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for f, (a, b) in rules.items()])
    return rows.select(key, F.explode(each).alias("x")).select(key, "x.field", "x.value", "x.low", "x.high").where("value < low OR value > high").select(key, "field", "value")


def inversions(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows whose value is less than that of the row before, inside each group."""
    return rows.withColumn("before", F.lag(value).over(Window.partitionBy(group).orderBy(order))).where(F.col(value) < F.col("before"))


def permutation(rows: DataFrame, rank: str) -> DataFrame:
    """One row (n, ok): the ranks are 1..n, each once."""
    out = rows.agg(F.count("*").alias("n"), F.min(rank).alias("a"), F.max(rank).alias("z"), F.count_distinct(rank).alias("d"))
    return out.select("n", ((F.col("a") == 1) & (F.col("z") == F.col("n")) & (F.col("d") == F.col("n"))).alias("ok"))


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, digest): the same for the same multiset of rows in any order. Sums of row hashes, so nothing is sorted or gathered."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]).cast("binary")), 1, 12), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest"))


def missing_fields(rows: DataFrame, known: set[str]) -> list[str]:
    """Columns without an entry in the manifest."""
    return sorted(set(rows.columns) - known)


def fresh(rows: DataFrame, stamp: str, now: Column) -> DataFrame:
    """One row (n, unparseable, future) of a text column of times."""
    t = F.try_to_timestamp(F.col(stamp))
    return rows.agg(F.count("*").alias("n"), F.count_if(t.isNull() & F.col(stamp).isNotNull()).alias("unparseable"), F.count_if(t > now).alias("future"))


def validated(decided: DataFrame, predicted: str, actual: str, least: int = 3) -> DataFrame:
    """One row (decided, correct, usable): a matcher is usable if it decided at least `least` cases, all of them right."""
    out = decided.where(F.col(predicted).isNotNull()).agg(F.count("*").alias("decided"), F.count_if(F.col(predicted) == F.col(actual)).alias("correct"))
    return out.withColumn("usable", (F.col("decided") >= least) & (F.col("correct") == F.col("decided")))


def adds_up(rows: DataFrame, p: str) -> DataFrame:
    """One row (ok): the probabilities' sum is 1."""
    return rows.agg((F.abs(F.sum(p) - 1) < 1e-9).alias("ok"))
