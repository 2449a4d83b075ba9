"""Names that clash, maps, null conversations, id types, and the stages of the pipeline on odd tables."""

import json

import pytest
from pyspark.sql import functions as F

from pairlytics.llm import pii, simhash, substring_dedup, tool_calls


def test_pii_columns_that_clash_and_countries(spark):
    rows = [(1, "call +1 555 010 4477 or +49 30 1234567", "a", 7, 0), (2, None, "b", 8, 0), (3, "again +49 (30) 123 45 67", "c", 9, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_text string, PII_COUNT int, n_chars long")
    out = {r["doc_id"]: r for r in pii.replace_pii(df).collect()}
    assert out[1]["pii_text"] == "a" and out[2]["text"] is None and out[3]["PII_COUNT"] == 9
    one, two = out[1]["text"], out[3]["text"]
    assert one.startswith("call +1 ") and " or +49 " in one and "4477" not in one and two.startswith("again +49 (")
    digits = lambda t: "".join(c for c in t if c.isdigit())
    assert digits(one.split(" or ")[1]) == digits(two) and out[1]["n_chars"] == len(one)


def test_near_duplicates_with_clashing_names_and_maps(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 5, {"a": 1}), (1, text, 5, {"b": 2}), (2, text, 6, None), (3, None, 7, {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, k_id int, least_of_row map<string,int>")
    got = sorted((r["doc_id"], r["k_id"], r["least_of_row"]) for r in simhash.drop_near_duplicates(df).collect())
    assert got == [(1, 5, {"a": 1}), (3, 7, {})]


def test_turns_without_conversation_are_linked_whatever_else_there_is(spark):
    call = lambda i, a: {"id": i, "name": "search", "arguments": a}
    rows = [(None, 0, "assistant", json.dumps({"tool_calls": [call("a", {"query": "x"})]})), (None, 1, "tool", json.dumps({"tool_call_id": "a", "content": "r"}))]
    more = [(5, 0, "assistant", json.dumps({"tool_calls": [call("p", {"query": "${q}"}), call("q", {"query": "y"})]}))]
    kind = "conv_id int, turn long, role string, text string"
    alone, beside = (sorted(map(str, tool_calls.link(spark.createDataFrame(r, kind)).where("conv_id IS NULL").collect())) for r in (rows, rows + more))
    assert alone == beside and len(alone) == 3 and sum("status='linked'" in x and "level=0" in x for x in alone) == 2
    out = tool_calls.link(spark.createDataFrame(rows + more, kind))
    assert out.schema["conv_id"].dataType.simpleString() == "int" and {r["call_id"]: r["level"] for r in out.where("conv_id = 5 AND call_id IS NOT NULL").collect()} == {"p": 1, "q": 0}
    assert tool_calls.link(spark.createDataFrame([], kind)).isEmpty()


def test_ids_of_substring_dedup(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (2, "x " + text), (3, None)], "doc_id int, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.deduplicate(df).collect()} == {1: 0, 2: 20, 3: 0}
    with pytest.raises(TypeError):
        substring_dedup.deduplicate(df.withColumn("doc_id", F.col("doc_id").cast("string")))
