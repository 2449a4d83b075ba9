"""The corpus pipeline: each stage reads what its predecessor wrote and keeps or changes documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pairlytics.llm import decontaminate, language_id, pii, sentencepiece_codec, simhash
from pairlytics.llm.common import drop_path, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_pii(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(sentencepiece_codec.encode(docs, sentencepiece_codec.model_path()))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", remove_contaminated),
    ("pii", replace_pii),
    ("sentencepiece", encode),
]
#: SQL has neither the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each result is written to the shared folder and read again, and the one before it deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop_path(spark, before)
        before = path
    return docs
