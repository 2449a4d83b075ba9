"""Queries over ratings read lines and orders once."""

import pytest
from pyspark.sql import SparkSession

from pairlytics.queries import evaluation
from pairlytics.sources import pairwise


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


@pytest.mark.parametrize("query", ["composite_rating", "match_auc"])
def test_one_reading(spark, query, monkeypatch):
    real, calls = pairwise.games, []
    monkeypatch.setattr(pairwise, "games", lambda *a: calls.append(a) or real(*a))
    plan = getattr(evaluation, query)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert len(calls) == 1 and "lineitem.parquet" not in plan
