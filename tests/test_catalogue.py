"""Each query of the library against its SQL."""

import duckdb
import pytest
from pyspark.sql import SparkSession

from pairlytics import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("lineitem", "orders", "supplier", "nation", "region", "part", "events", "documents", "labels", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    got = sorted(map(tuple, df.collect()), key=str)
    if name not in catalogue.oracle_sql():
        assert got
        return
    rel = con.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = sorted(rel.select(*[f'"{x}"' for x in df.columns]).fetchall(), key=str)
    assert got == want
