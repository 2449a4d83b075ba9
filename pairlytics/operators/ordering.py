"""Ranks and running sums over a whole table without one task that holds it.

A table of more than ONE_TASK_ROWS rows (counted) is dealt into ranges of its order, key included, so that equal values
are split too; the dealt table is written, and each range is ranked by itself above a sum over the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import stored

#: Rows up to which one task ranks a table, and rows of a range beyond.
ONE_TASK_ROWS, RANGE_ROWS = 200_000, 500_000


def _in_order(held: DataFrame, order: list[Column], inside, amount: Column, name: str) -> DataFrame:
    """held with `inside` (a function of a window) over the given order, plus the sum of `amount` over all ranges before."""
    n = held.count()
    if n <= ONE_TASK_ROWS:
        return held.withColumn(name, inside(Window.orderBy(*order)))
    dealt = stored(held.repartitionByRange(-(-n // RANGE_ROWS), *order).withColumn("_r", F.spark_partition_id()))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = dealt.groupBy("_r").agg(amount.alias("_n")).select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = dealt.withColumn("_i", inside(Window.partitionBy("_r").orderBy(*order))).join(F.broadcast(offsets), "_r")
    return out.withColumn(name, F.col("_i") + F.col("_before")).drop("_r", "_i", "_before")


def ranked(rows: DataFrame, by: str, key: str, name: str = "rank") -> DataFrame:
    """rows with 1..N by column `by`, highest first, nulls last, ties by key.

    Values are rounded to 10 places for the order, so that the order of a sum's terms can't decide it.
    """
    held = stored(rows.withColumn("_v", F.round(F.col(by).cast("double"), 10)))
    out = _in_order(held, [F.desc_nulls_last("_v"), F.asc(key)], lambda w: F.row_number().over(w), F.count("*"), name)
    return out.select(*rows.columns, F.col(name).cast("int").alias(name))


def running_below(rows: DataFrame, value: str, amount: str, name: str) -> DataFrame:
    """rows with the sum of `amount` over all rows of a smaller `value` (one row per value)."""
    inside = lambda w: F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _in_order(stored(rows), [F.asc_nulls_first(value)], inside, F.sum(amount), name).select(*rows.columns, name)
