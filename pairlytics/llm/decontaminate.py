"""Benchmark decontamination by winnowing (DataFrame functions only).

Words are maximal runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. A benchmark window is
`span` consecutive words of an item; an item with fewer words is one window. Every k-gram of words is hashed
and the minimum of each run of span-k+1 consecutive k-gram hashes is kept, on both sides: two texts that share
`span` words keep the same minimum, so equality of kept hashes finds every shared window. Documents that share
a kept hash are then read again and the hit is extended: their whole windows are compared word for word.
Items too short to have a fingerprint are anchored on one of their words instead and verified in the same way.

Cases: null or empty text has no words, is never hit and never contaminated; an empty benchmark hits nothing;
repeated rows each get the same result; rows that share an id but not the text are judged on their own text;
benchmark rows with a null id count as hits but aren't listed; other columns of the inputs aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small, split_words, stored, table

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SPAN, K = 13, 5


def bench_words(c: Column) -> Column:
    return split_words(ascii_lower(c), SEPARATORS)


def _next(name: str, step: int, make, other: str | None = None) -> Column:
    """Combine each element of array column `name` with the one `step` further on in `other` (null past the end)."""
    return F.transform(F.col(name), lambda x, i: make(x, F.get(F.col(other or name), i + step)))


def kgram_hashes(df: DataFrame, words: str, k: int, out: str) -> DataFrame:
    """df with array column `out`: hash of each k-gram of array column `words`; only the first n-k+1 are whole.

    Lengths are doubled as often as k allows, so it takes about log2(k) passes instead of k.
    """
    df = df.withColumn("_g1", F.transform(F.col(words), lambda x: F.xxhash64(x)))
    have, at = {1: "_g1"}, 1
    while at * 2 <= k:
        df = df.withColumn(f"_g{at * 2}", _next(have[at], at, F.xxhash64))
        at *= 2
        have[at] = f"_g{at}"
    name, done = have[at], at
    for part in sorted((p for p in have if p < at), reverse=True):
        if done + part <= k:
            df = df.withColumn(f"_g{done + part}", _next(name, done, F.xxhash64, have[part]))
            done += part
            name = f"_g{done}"
    keep = [c for c in df.columns if not c.startswith("_g")]
    return df.select(*keep, F.col(name).alias(out))


def winnow(df: DataFrame, words: str, out: str, span: int = SPAN, k: int = K) -> DataFrame:
    """df with array column `out`: the distinct minima of each run of span-k+1 k-gram hashes of `words`.

    Explode it with explode_outer: for explode, Spark infers a filter on the array's size and pushes it below the
    projections here, where each would be evaluated again for every element of the next.
    """
    width = span - k + 1
    df = kgram_hashes(df, words, k, "_m1")
    name, at = "_m1", 1
    while at < width:  # minima over 1, 2, 4, ... and at last `width` neighbours; runs may overlap
        step = min(at, width - at)
        df = df.withColumn(f"_m{at + step}", _next(name, step, F.least))
        at += step
        name = f"_m{at}"
    n = F.greatest(F.size(words) - (span - 1), F.lit(0))
    keep = [c for c in df.columns if not c.startswith("_m")]
    return df.select(*keep, F.array_distinct(F.slice(F.col(name), F.lit(1), n)).alias(out))


def _bench_windows(benchmark: DataFrame, span: int) -> DataFrame:
    """(item_id, words, n, len) of the items that have words; len: words in each of the item's windows."""
    w = benchmark.select(F.col("item_id"), bench_words(F.col("text")).alias("words"))
    return w.select("*", F.size("words").alias("n")).where("n > 0").withColumn("len", F.least(F.col("n"), F.lit(span)))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, percent: int = 5) -> DataFrame:
    """One row per document: doc_id, text_key (hash of its text), n_words, n_hit, n_items, item_ids, contaminated.

    contaminated: some word is hit and at least `percent` of the words are. Reads documents once for all, and
    a second time for those that share a fingerprint with the benchmark. Nothing is dropped or capped.
    """
    items = stored(_bench_windows(benchmark, span))
    prints = winnow(items.where(F.col("n") >= span), "words", "f", span, k).select(F.explode_outer("f").alias("f")).where("f IS NOT NULL").distinct()
    anchors = items.where(F.col("n") < span).select(F.xxhash64(F.sort_array(F.col("words"), asc=False)[0]).alias("f")).distinct()
    has_short = not anchors.isEmpty()
    lens = sorted(r["len"] for r in items.select("len").distinct().limit(span).collect())  # 1..span: at most `span` values
    key = F.xxhash64(F.col("text")).alias("text_key")

    base = docs.select("doc_id", key, bench_words(F.col("text")).alias("words"))
    base = base.withColumn("n_words", F.size("words"))
    kept = winnow(base, "words", "f", span, k)
    if has_short:  # single words are looked up, too
        kept = kept.withColumn("f", F.concat(F.col("f"), F.array_distinct(F.transform("words", lambda x: F.xxhash64(x)))))
        prints = prints.union(anchors).distinct()
    hits = small(stored(prints.select("f", F.lit(1).alias("hit"))))
    rows = kept.select("doc_id", "text_key", "n_words", F.posexplode_outer("f").alias("pos", "f")).join(hits, "f", "left")
    judged = stored(
        rows.groupBy("doc_id", "text_key", "n_words").agg(F.max("hit").alias("hit"), F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("copies"))
    )

    found = judged.where("hit = 1").select("doc_id", "text_key").distinct()
    docs_k = docs.select("doc_id", key, "text")
    same = docs_k["doc_id"].eqNullSafe(F.col("c.doc_id")) & (docs_k["text_key"] == F.col("c.text_key"))
    texts = docs_k.join(small(found).alias("c"), same, "left_semi")
    texts = texts.select("doc_id", "text_key", bench_words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    at = texts.select("doc_id", "text_key", "words", "n", F.explode(F.array(*map(F.lit, lens)) if lens else F.array().cast("array<int>")).alias("len")).where("n >= len")
    at = at.select("doc_id", "text_key", "words", "len", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("len") + 1)).alias("pos"))
    window = F.array_join(F.slice("words", F.col("pos"), F.col("len")), " ")
    at = at.select("doc_id", "text_key", "len", "pos", window.alias("window"))
    of_items = items.select("item_id", "words", "len", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("len") + 1)).alias("pos"))
    of_items = of_items.select("item_id", "len", window.alias("window")).distinct()
    spans = at.join(small(stored(of_items)), ["len", "window"]).groupBy("doc_id", "text_key", "pos", "len").agg(F.collect_set("item_id").alias("ids"))
    per_doc = spans.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct("pos", "len"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")
    )
    start = F.struct(F.lit(1).alias("end"), F.lit(0).alias("hit"))
    covered = F.aggregate(
        "spans",
        start,
        lambda a, x: F.struct(
            F.greatest(a["end"], x["pos"] + x["len"]).alias("end"),
            (a["hit"] + F.greatest(x["pos"] + x["len"] - F.greatest(a["end"], x["pos"]), F.lit(0))).alias("hit"),
        ),
        lambda a: a["hit"],
    )
    per_doc = per_doc.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), covered.alias("n_hit"), F.sort_array(F.col("ids").cast("array<string>")).alias("item_ids"))
    per_doc = small(stored(per_doc))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    out = judged.join(per_doc, judged["doc_id"].eqNullSafe(per_doc["h_id"]) & (judged["text_key"] == per_doc["h_key"]), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    ids = F.coalesce(F.col("item_ids"), F.array().cast("array<string>"))
    return out.select(
        "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
        ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all columns) that aren't contaminated."""
    bad = stored(contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct())
    return docs.join(small(bad), docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_key"]), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


OP6_SQL = r"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS l FROM bw WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, l, array_to_string(w[p:p + l - 1], ' ') AS win FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM bi)),
ls AS (SELECT DISTINCT l FROM bi),
dwin AS (SELECT doc_id, l, p, array_to_string(w[p:p + l - 1], ' ') AS win FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM dw, ls WHERE len(w) >= l)),
hit AS (SELECT d.doc_id, d.l, d.p, b.item_id FROM dwin d JOIN bwin b USING (l, win)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
