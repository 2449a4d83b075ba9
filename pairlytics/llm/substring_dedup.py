"""Substring deduplication with a log-structured fingerprint index.

A window is `SPAN` consecutive words (runs without ASCII white space) of one document. A word is removed if it lies
in a window whose words also start somewhere in a document with a smaller doc_id; all windows are those of the input.

`FingerprintIndex` keeps sorted, immutable Parquet runs of (hash, doc_id): hashes are the minima of k-gram hashes
over each window, so two equal windows have one in common, at a fifth of the cost of a hash per window. A new batch
is merge-joined with every run; documents that share a hash with another one are candidates. Their whole windows
are then compared by two independent 64-bit hashes of all their words (the verification), and the smallest doc_id of
each window decides. The batch becomes a new run; when there are `MAX_RUNS`, they are merged into one (compaction).

Equal texts count once: all but the one of the smallest doc_id are copies, which lose every window at once. Hashes are
pre-aggregated (one row per hash and document), hot windows are joined by a broadcast of bounded size (`split_join`), so
no window or group of copies is gathered in one task. Texts are shuffled once, and only those of candidates while
their ids fit a checked broadcast. Tables are deleted once used. A call without an index makes one for itself.

Cases: null text has no words; under SPAN words nothing is removed; within one document repeats stay; of rows that
repeat a doc_id each is judged alone (neither is smaller); a null doc_id is never smaller and never judged; an empty
table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, drop_stored, list_dir, settings_of_jobs, shared_dir, small, split_join, stored, table

SPAN, K, MAX_RUNS = 13, 5, 4
#: Ids of candidates that may be broadcast to keep other texts out of the shuffle (8 bytes each).
CANDIDATE_ROWS = 500_000
_RNG = np.random.default_rng(13)
_ODD = _RNG.integers(0, 2**63, (2, SPAN + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A hash of each k consecutive word hashes; `which` selects one of two independent families."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = h[:n] * _ODD[which, 0]
    for j in range(1, k):
        g = g + h[j : j + n] * _ODD[which, j]
    g ^= g >> np.uint64(32)
    g *= _ODD[which, SPAN]
    return g ^ (g >> np.uint64(29))


def window_minima(h: np.ndarray, span: int = SPAN, k: int = K) -> np.ndarray:
    """For each window of `span` words, the smallest of its k-gram hashes."""
    m, at, width = gram_hashes(h, k), 1, span - k + 1
    if len(m) < width:
        return np.empty(0, np.uint64)
    while at < width:
        step = min(at, width - at)
        m = np.minimum(m[:-step], m[step:])
        at += step
    return m


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to one row per document and distinct minimum."""
    for batch in batches:
        ids, out, counts = batch.column(0), [], []
        for t in batch.column(1):
            found = np.unique(window_minima(word_hashes((t.as_py() or b"").split())))
            out.append(found)
            counts.append(len(found))
        hashes = np.concatenate(out) if out else np.empty(0, np.uint64)
        take = pa.array(np.repeat(np.arange(len(out)), counts))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), ids.take(take)], names=["h", "doc_id"])


def _shared_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, shared minima) to one row per document and distinct window whose minimum is shared."""
    for batch in batches:
        ids, out, counts = batch.column(0), [[], []], []
        for t, shared in zip(batch.column(1), batch.column(2), strict=True):
            h = word_hashes((t.as_py() or b"").split())
            at = np.flatnonzero(np.isin(window_minima(h).view(np.int64), shared.values.to_numpy()))
            first, again = gram_hashes(h, SPAN, 0)[at], gram_hashes(h, SPAN, 1)[at]
            _, kept = np.unique(first, return_index=True)
            out[0].append(first[kept])
            out[1].append(again[kept])
            counts.append(len(kept))
        a, b = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in out)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), ids.take(pa.array(np.repeat(np.arange(len(counts)), counts)))], names=["w1", "w2", "doc_id"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, windows to remove or null, copy) to (doc_id, n_words, n_removed, kept); a copy loses each window."""
    for batch in batches:
        rows = []
        for t, windows, copy in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
            words = (t.as_py() or b"").split()
            kept = words
            if copy and len(words) >= SPAN:
                kept = []
            elif windows.is_valid:
                at = np.flatnonzero(np.isin(gram_hashes(word_hashes(words), SPAN).view(np.int64), windows.values.to_numpy()))
                edge = np.zeros(len(words) + 1, np.int32)
                edge[at] += 1
                np.subtract.at(edge, at + SPAN, 1)
                kept = [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not c]
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")))
        cols = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)] if rows else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_words", "n_removed", "kept"])


class FingerprintIndex:
    """Sorted immutable runs of (hash, doc_id) under `path`, in a folder that all executors share.

    An index over a folder that already has runs goes on with them. Runs are only ever added whole; a compaction that
    was cut off leaves old and new runs, whose repeated rows change nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, max_runs: int = MAX_RUNS):
        self.spark, self.max_runs = spark, max_runs
        self.path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        self.runs = [x for x in list_dir(spark, self.path) if x.rsplit("/", 1)[-1].startswith("run-") and any(y.endswith("/_SUCCESS") for y in list_dir(spark, x))]

    def _write(self, rows: DataFrame) -> str:
        run = f"{self.path}/run-{uuid.uuid4().hex}"
        with settings_of_jobs(self.spark):
            rows.select("h", "doc_id").sortWithinPartitions("h").write.parquet(run)
        return run

    def read(self, run: str) -> DataFrame:
        return self.spark.read.schema("h long, doc_id long").parquet(run)

    def add(self, hashes: DataFrame) -> list[DataFrame]:
        """Add a batch (h, doc_id) as a new run and return, for it and each older run, the hashes both have."""
        new = self._write(hashes)
        older, self.runs = self.runs, [*self.runs, new]
        batch = self.read(new)
        found = [batch.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h")]
        if older:  # one merge join with all of them: each run's rows move once
            history = self.rows(older).groupBy("h").agg(F.min("doc_id").alias("low"))
            found.append(batch.groupBy("h").agg(F.max("doc_id").alias("high")).hint("merge").join(history, "h").select("h"))
        found = [stored(x) for x in found]
        if len(self.runs) >= self.max_runs:
            self.compact()
        return found

    def compact(self) -> None:
        """Merge all runs into one, which is written to the end before the old ones go."""
        old, self.runs = self.runs, [self._write(self.rows().distinct())]
        for run in old:
            drop_path(self.spark, run)

    def rows(self, runs: list[str] | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.read(run) for run in runs or self.runs])


def _copies(texts: DataFrame) -> DataFrame:
    """(doc_id, k): the rows of texts (doc_id, text, k) whose text a smaller doc_id has, too."""
    reps = stored(texts.where("doc_id IS NOT NULL AND k IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1"))
    total = reps.agg(F.sum("n")).first()[0] or 0
    out = stored(split_join(texts.select("doc_id", "k"), reps, "k", "n", total).where("doc_id > low").select("doc_id", "k").distinct())
    drop_stored(reps)
    return out


def _id(docs: DataFrame) -> Column:
    """doc_id as a long; other types than integers are refused, as documents are ordered and dealt by its value."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id must be of an integer type, not {kind}")
    return F.col("doc_id").cast("long").alias("doc_id")


def deduplicate(docs: DataFrame, batches: int = 2, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document; kept: the words that stay, joined by one space.

    The documents enter the index in `batches` batches of ascending doc_id. An index that earlier calls filled needs
    their documents as `history`: windows are verified on the texts themselves.
    """
    spark = docs.sparkSession
    docs = docs.select(_id(docs), "text")
    as_text = lambda df: df.select(_id(df), F.col("text").cast("binary").alias("text")).withColumn("k", F.unhex(F.md5("text")))
    texts = as_text(docs)
    known = texts if history is None else texts.unionByName(as_text(history))
    copies = _copies(known)
    few = small(copies, CANDIDATE_ROWS)
    span = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    own = index is None
    index, shared = index or FingerprintIndex(spark), []
    none = F.lit(None).cast("array<long>")
    kind = "doc_id long, n_words long, n_removed long, kept string"
    copied = texts.join(few, ["doc_id", "k"], "left_semi").select("doc_id", "text", none.alias("windows"), F.lit(True).alias("copy"))
    single = texts.join(few, ["doc_id", "k"], "left_anti")
    if span["a"] is not None:
        width = (span["b"] - span["a"]) // batches + 1
        for i in range(batches):
            low = span["a"] + i * width
            part = single.where((F.col("doc_id") >= low) & (F.col("doc_id") < low + width)).select("doc_id", "text")
            shared += index.add(part.mapInArrow(_minima, "h long, doc_id long"))
    if not shared:
        return texts.select("doc_id", "text", none.alias("windows"), F.lit(False).alias("copy")).mapInArrow(_remove, kind)
    hashes = stored(reduce(DataFrame.unionByName, shared).distinct())
    per_doc = stored(index.rows().join(hashes, "h").groupBy("doc_id").agg(F.collect_set("h").alias("shared")))
    drop_stored(*shared, hashes)
    if own:
        drop_path(spark, index.path)
    firsts = known.join(few, ["doc_id", "k"], "left_anti").select("doc_id", "text")
    chosen = firsts.join(small(per_doc.select("doc_id"), CANDIDATE_ROWS), "doc_id", "left_semi")
    windows = stored(chosen.join(per_doc, "doc_id").select("doc_id", "text", "shared").mapInArrow(_shared_windows, "w1 long, w2 long, doc_id long"))
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high")
    first = stored(first.select(F.col("w1").alias("w"), F.col("w2").alias("check"), "low", "n"))
    total = first.agg(F.sum("n")).first()[0] or 0
    keyed = first.select(F.struct("w", "check").alias("w"), "low", "n")
    both = split_join(windows.select(F.struct(F.col("w1").alias("w"), F.col("w2").alias("check")).alias("w"), "doc_id"), keyed, "w", "n", total)
    gone = stored(both.where("doc_id > low").groupBy("doc_id").agg(F.collect_list("w.w").alias("windows")))
    drop_stored(windows, first, per_doc)
    ids = small(gone.select("doc_id"), CANDIDATE_ROWS)
    touched = single.join(ids, "doc_id", "left_semi").join(gone, "doc_id").select("doc_id", "text", "windows", F.lit(False).alias("copy"))
    rest = single.join(ids, "doc_id", "left_anti").select("doc_id", "text", none.alias("windows"), F.lit(False).alias("copy"))
    return touched.unionByName(rest).unionByName(copied).mapInArrow(_remove, kind)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
firsts AS (SELECT win, min(doc_id) AS low FROM windows GROUP BY win),
gone AS (SELECT doc_id, unnest(range(p, p + 13)) AS p FROM windows JOIN firsts USING (win) WHERE doc_id > low),
words AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
