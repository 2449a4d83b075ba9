"""Chat formatting: tool calls linked to their results, ordered, validated, as canonical JSON (DataFrame functions only).

A turn whose text is a JSON object may carry `tool_calls`, an array of {"id", "name", "arguments"} (or with the last
two under "function"; arguments may be an object or its JSON text), or `tool_call_id`, which makes it a result. A
turn of any other text is a plain message. Calls and results are joined by conversation and identifier; a result
without call, a call without result, and an identifier used twice are reported, not dropped.

Arguments may refer to an earlier result as "${id}". Calls are ordered topologically: `level` is the round in
which all a call refers to is placed; calls in a cycle get none. Arguments are checked against `SCHEMAS`: unknown
tools, unknown, missing and wrongly typed arguments.

One row per turn and per linked result, ordered by (conv_id, call_turn, kind, level, call_index, turn); no group is ever gathered, so
one conversation may hold any share of the rows. JSON is canonical: keys sorted, no white space.

Cases: null text is an empty message; turns without conv_id count as one conversation; null turn or role are kept; other columns aren't looked at; texts of any length are parsed whole; text that isn't valid JSON is plain;
`tool_calls` that isn't an array of objects gives no calls, but the whole text and the error `malformed tool_calls`; repeated rows each get a row, and repeated identifiers status `ambiguous`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored, table

#: tool -> argument -> (type as in JSON, required)
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "get_weather": {"city": ("string", True), "days": ("integer", False)},
}
REFERENCE = r"\$\{([A-Za-z0-9_-]+)\}"


def _types(v):
    """JSON type of a variant column."""
    s = F.schema_of_variant(v)
    return F.when(s == "BIGINT", "integer").when(s.startswith("DECIMAL") | (s == "DOUBLE"), "number").when(s == "BOOLEAN", "boolean").when(s == "STRING", "string").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("null")


def parsed(turns: DataFrame) -> DataFrame:
    """uid, conv_id, turn, role, text, json (the text, null unless it is a JSON object with a list of calls or a call's id) and malformed.

    malformed: `tool_calls` is there, but isn't an array of objects or null; then it gives no calls and the text stays as it is.
    """
    looks = F.col("text").rlike(r"(?s)^\s*\{.*\"tool_call(?:s|_id)\"")
    df = turns.select(F.monotonically_increasing_id().alias("uid"), "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("v", F.when(looks, F.try_parse_json("text")))
    kind = lambda path: F.coalesce(_types(F.try_variant_get("v", path, "variant")), F.lit("null"))
    items = F.from_json(F.to_json(F.try_variant_get("v", "$.tool_calls", "variant")), "array<string>")
    df = df.select(*[c for c in df.columns if c != "v"], kind("$").alias("whole"), kind("$.tool_calls").alias("calls"), kind("$.tool_call_id").alias("result"), F.when(looks, items).alias("items"))
    objects = (F.col("calls") == "array") & F.coalesce(F.forall("items", lambda x: F.coalesce(x.startswith("{"), F.lit(False))), F.lit(False))
    given = (F.col("whole") == "object") & ((F.col("calls") != "null") | (F.col("result") != "null"))
    malformed = given & (F.col("calls") != "null") & ~objects
    df = df.withColumn("malformed", malformed).withColumn("json", F.when(given & (~F.col("malformed") | (F.col("result") != "null")), F.col("text")))
    return stored(df.select("uid", "conv_id", "turn", "role", "text", "json", "malformed"))


def calls_of(messages: DataFrame) -> DataFrame:
    """uid, conv_id, call_turn, call_index, call_id, name, arguments (JSON text of the object, null if none)."""
    one = "struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>"
    calls = F.from_json("json", f"struct<tool_calls:array<{one}>>")["tool_calls"]
    df = messages.where("json IS NOT NULL AND NOT malformed").select("uid", "conv_id", F.col("turn").alias("call_turn"), F.posexplode(calls).alias("call_index", "c"))
    return df.select("uid", "conv_id", "call_turn", "call_index", F.col("c.id").alias("call_id"), F.coalesce("c.name", "c.function.name").alias("name"), F.coalesce("c.arguments", "c.function.arguments").alias("arguments"))


def validated(calls: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """calls with `errors`, a sorted array of strings (empty: valid)."""
    spark = calls.sparkSession
    rows = [(t, a, k, r) for t, args in schemas.items() for a, (k, r) in args.items()]
    rules = F.broadcast(spark.createDataFrame(rows, "name string, arg string, kind string, required boolean"))  # given by the caller
    known = F.col("name").isin(list(schemas))
    v = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    df = calls.withColumn("is_object", is_object)
    base = df.select("uid", "call_index", F.explode(F.array_compact(F.array(
        F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown tool "), F.coalesce("name", F.lit("")))), F.when(~F.col("is_object"), F.lit("arguments aren't an object")),
    ))).alias("error"))
    objects = df.where(F.col("is_object") & known).select("uid", "call_index", F.col("name"), v.alias("v"))
    given = objects.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("uid", "call_index", "name", F.col("key").alias("arg"), _types(F.col("value")).alias("got"))
    given = stored(given)
    checked = given.join(rules, ["name", "arg"], "left")
    fits = (F.col("got") == F.col("kind")) | ((F.col("kind") == "number") & (F.col("got") == "integer"))
    wrong = checked.select("uid", "call_index", F.when(F.col("kind").isNull(), F.concat(F.lit("unknown argument "), "arg")).when(~fits, F.concat(F.lit("wrong type of "), "arg")).alias("error")).where("error IS NOT NULL")
    need = objects.select("uid", "call_index", "name").join(rules.where("required"), "name").join(given.select("uid", "call_index", "arg"), ["uid", "call_index", "arg"], "left_anti")
    missing = need.select("uid", "call_index", F.concat(F.lit("missing "), "arg").alias("error"))
    errors = base.unionByName(wrong).unionByName(missing).groupBy("uid", "call_index").agg(F.array_sort(F.collect_set("error")).alias("errors"))
    return calls.join(errors, ["uid", "call_index"], "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def leveled(calls: DataFrame) -> DataFrame:
    """calls with `level`: 0 without references, else one more than the highest that is referred to; null in cycles.

    References to identifiers that no call of the conversation has are ignored. One round per level, until nothing is placed.
    """
    ids = calls.select("conv_id", "call_id").where("call_id IS NOT NULL").distinct()
    refs = calls.select("conv_id", "call_id", F.explode(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1))).alias("to")).distinct()
    refs = stored(refs.join(ids.withColumnRenamed("call_id", "to"), ["conv_id", "to"]))
    if refs.isEmpty():
        return calls.withColumn("level", F.lit(0))
    left = stored(ids.select("conv_id", "call_id").join(refs.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_semi"))
    done = stored(ids.join(left, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)))
    level = 0
    while not left.isEmpty():
        level += 1
        blocked = refs.join(left.withColumnRenamed("call_id", "to"), ["conv_id", "to"], "left_semi").select("conv_id", "call_id").distinct()
        ready = stored(left.join(blocked, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        done = done.unionByName(ready)
        left = stored(left.join(ready, ["conv_id", "call_id"], "left_anti"))
    none = F.when(F.col("call_id").isNull(), F.lit(0)).otherwise(F.col("level")).alias("level")
    return calls.join(done, ["conv_id", "call_id"], "left").select(*calls.columns, none)


def link(turns: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, call_turn, kind (0 message, 1 call, 2 result), level, call_index, turn, role, call_id, status, errors, json."""
    # a key that is never null, so that turns without conversation are linked among themselves
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    out = _linked(turns.select(key.alias("conv_id"), "turn", "role", "text"), schemas)
    given = F.when(F.col("conv_id") != "", F.substr("conv_id", F.lit(2))).cast(turns.schema["conv_id"].dataType)
    return out.withColumn("conv_id", given)


def _linked(turns: DataFrame, schemas: dict) -> DataFrame:
    messages = parsed(turns)
    calls = stored(validated(leveled(calls_of(messages)), schemas))
    said = messages.select("*", F.get_json_object("json", "$.tool_call_id").alias("call_id"), F.get_json_object("json", "$.content").alias("content"))
    results = stored(said.where("call_id IS NOT NULL"))
    n_calls = calls.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_calls"), F.min("call_turn").alias("of_turn"), F.min_by("level", "call_turn").alias("of_level"), F.min_by("call_index", "call_turn").alias("of_index"))
    n_results = results.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"))
    both = stored(n_calls.join(n_results, ["conv_id", "call_id"], "full"))
    status = F.when((F.col("n_calls") > 1) | (F.col("n_results") > 1), "ambiguous").when(F.col("n_calls").isNull(), "no call").when(F.col("n_results").isNull(), "no result").otherwise("linked")
    both = small(both.withColumn("status", status))
    none = F.array().cast("array<string>")
    wrong = F.when(F.col("malformed"), F.array(F.lit("malformed tool_calls"))).otherwise(none)
    body = F.when(F.col("json").isNull() | F.col("malformed"), F.col("text")).otherwise(F.coalesce("content", F.lit("")))
    canonical = lambda *pairs: F.to_json(F.parse_json(F.to_json(F.struct(*pairs), {"ignoreNullFields": "false"})))

    plain = said.where("call_id IS NULL").select(
        "conv_id", F.col("turn").alias("call_turn"), F.lit(0).alias("kind"), F.lit(0).alias("level"), F.lit(0).alias("call_index"), "turn", "role",
        F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("status"), wrong.alias("errors"),
        canonical(body.alias("content"), F.col("role")).alias("json"),
    )
    out = calls.join(both.select("conv_id", "call_id", "status"), ["conv_id", "call_id"], "left")
    args = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.col("arguments"))
    called = out.select(
        "conv_id", "call_turn", F.lit(1).alias("kind"), "level", "call_index", F.col("call_turn").alias("turn"), F.lit("assistant").alias("role"), "call_id",
        F.coalesce("status", F.lit("no result")).alias("status"), "errors", canonical(args.alias("arguments"), F.col("call_id").alias("id"), F.col("name")).alias("json"),
    )
    got = results.join(both, ["conv_id", "call_id"], "left").select(
        "conv_id", F.coalesce("of_turn", "turn").alias("call_turn"), F.lit(2).alias("kind"), F.col("of_level").alias("level"), F.coalesce("of_index", F.lit(0)).alias("call_index"), "turn", "role", "call_id",
        F.coalesce("status", F.lit("no call")).alias("status"), wrong.alias("errors"), canonical(body.alias("content"), F.col("role"), F.col("call_id").alias("tool_call_id")).alias("json"),
    )
    return plain.unionByName(called).unionByName(got)


def op10_tool_calls(spark, sf_dir: str) -> DataFrame:
    out = link(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "call_turn", "kind", "level", "call_index", "turn", "role", "call_id", "status", F.array_join("errors", "; ").alias("errors"), "json")
