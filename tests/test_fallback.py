"""Prioritised joins: nulls, repeats, empty sources."""

import pytest
from pyspark.sql import SparkSession

from pairlytics.operators import fallback


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def test_override_is_unconditional(spark):
    base = spark.createDataFrame([("a", 1, 2), ("b", 3, 4), (None, 5, 6)], "k string, w int, l int")
    official = spark.createDataFrame([("a", 9, None), ("a", 8, 1), ("c", 1, 1), (None, 0, 0)], "k string, w int, l int")
    got = sorted((r["k"] or "", r["w"], r["l"], r["method"]) for r in fallback.overridden(base, official, "k", ["w", "l"]).collect())
    assert got == [("", 5, 6, "derived"), ("a", 9, None, "official"), ("b", 3, 4, "derived")]
    assert fallback.overridden(base, official.limit(0), "k", ["w", "l"]).where("method = 'official'").isEmpty()


def test_first_source_gives_all_columns(spark):
    base = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    one = spark.createDataFrame([("a", 1, None), ("b", None, 5)], "k string, x int, y int")
    two = spark.createDataFrame([("a", 2, 2), ("b", 3, None), ("c", 4, 4), ("c", 3, 9)], "k string, x int, y int")
    got = sorted(tuple(r) for r in fallback.first_source(base, [("one", one), ("two", two)], "k", ["x", "y"]).select("k", "x", "y", "method").collect())
    assert got == [("a", 1, None, "one"), ("b", 3, None, "two"), ("c", 4, 4, "two"), ("d", None, None, "none")]


def test_transfers(spark):
    pool = spark.createDataFrame([(3, "t", "Ann  B. Lee", 30), (2, "t", "ANN Lee", 20), (1, "t", "Amy Lee", 10), (5, "u", "Ann Lee", 50), (6, "t", None, 1), (7, "t", " . ", 1), (8, None, "Ann Lee", 1)], "pool_id long, team string, name string, points int")
    moved = spark.createDataFrame([(1, "t", "ann lee"), (2, "t", "A. Lee"), (3, "t", "ann b lee"), (4, "u", "Bo Lee"), (5, "t", None), (6, "t", ""), (7, None, "Ann Lee"), (8, "v", "Ann Lee"), (9, "t", "ann lee")], "id long, team string, name string")
    got = {r["id"]: (r["pool_id"], r["points"], r["method"]) for r in fallback.transfers(moved, pool).collect()}
    none = (None, None, "none")
    assert got == {1: (2, 20, "exact"), 2: (1, 10, "surname"), 3: (3, 30, "exact"), 4: none, 5: none, 6: none, 7: none, 8: none, 9: (2, 20, "exact")}
    assert fallback.transfers(moved.limit(0), pool).isEmpty()
