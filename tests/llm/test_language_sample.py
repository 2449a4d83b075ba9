"""Documents without text take no place in a language's sample."""

from pyspark.sql import functions as F

from pairlytics.llm import language_id


def test_null_texts_take_no_place(spark):
    none = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("text"))
    some = spark.range(20_000, 20_009).select(F.col("id").alias("doc_id"), F.lit("xx").alias("lang"), F.lit("words to learn").alias("text"))
    assert [lang for lang, _ in language_id.sample(none.union(some))] == ["xx"]
