import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Odd texts: null, empty, no letters, ties, repeats, very long.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "12 34 !"), (5, "same words here again"), (6, "same words here again"), (6, "same words here again"),
       (7, "long text of many words " * 3000), (8, "é ü ñ 漢字 emoji 🙂 ▁mark space")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), "x") for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, DOC string")
