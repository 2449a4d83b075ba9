"""Stupid-backoff language-model scores, computed relationally.

Words are runs without ASCII white space, A-Z lower-cased; two start marks precede each text. Counts are those of
the whole corpus less the scored document's own, so a document is judged by the others. A word costs
log10(c(abc)/c(ab)) if that trigram occurs elsewhere, else log10(ALPHA c(bc)/c(b)), else log10(ALPHA^2 c(c)/N), where
an unseen word counts `UNSEEN`. The score of a document is the mean over its words.

Equal texts are one row with a number of copies. Texts are cut into blocks of about `BLOCK_BYTES`, and a block is
exploded into its distinct n-grams (64-bit hashes) with how often each occurs there, so even the commonest n-gram has one
entry per block. The entries are partitioned by hash into buckets of about `BUCKET_ENTRIES`; one row packs what a block
has in a bucket, as moving n-grams row by row costs most of the time. A bucket adds up its count table, joins it to its
entries and gives the counts of the n-grams that several blocks have back to these blocks. A block has the counts of all
its other n-grams itself. Trigrams follow in a second turn. Each block then sums its documents' words. The number of
buckets grows with the corpus; a task holds one bucket, or one block and its counts, at a time. What a bucket can't split
is a single n-gram: 24 bytes for each block that has it, 600 MB for one in every block of 100 TB. Tables are deleted once used.

Cases: a null text or one without words has score null; repeated rows are distinct documents with equal scores (each
counts for the others); with a single document every word is unseen; null doc_id is kept; a text of any length is
scored whole (one over BLOCK_BYTES is a block by itself); columns other than doc_id and text, whatever their names,
aren't looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, split_join, stored, table

ALPHA, UNSEEN = 0.4, 0.5
BLOCK_BYTES, WAVES = 4 << 20, 4
_START = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BUCKET_ENTRIES, ROW_ENTRIES = 1 << 20, 1 << 17
#: A row has the hashes of some n-grams (8 bytes each, ascending) and as many numbers: times in the block, or corpus counts.
GRAMS, COUNTS = "bucket long, block long, h binary, m binary", "block long, h binary, c binary"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * _M1 + b * _M2
    return (x ^ (x >> np.uint64(29))) * _M1


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, copies) to (block, words, text, copies): consecutive texts of a task share a block until it is full."""
    block, held = TaskContext.get().partitionId() << 20, 0
    for batch in batches:
        ids, words = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
        for i, text in enumerate(batch.column(0)):
            content = text.as_buffer().to_pybytes()
            size, words[i] = len(content), len(content.split())
            if held and held + size > BLOCK_BYTES:
                block, held = block + 1, 0
            held += size
            ids[i] = block
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(words), *batch.columns], names=["block", "words", *batch.schema.names])


class Block:
    """The words of a block's texts: for each word its text, and the hashes of the n-grams that end in it."""

    def __init__(self, texts: pa.ChunkedArray, copies: np.ndarray):
        digest, parts = xxhash.xxh3_64_intdigest, []
        for t in texts:
            words = t.as_buffer().to_pybytes().lower().split()
            w = np.empty(len(words) + 2, np.uint64)
            w[:2] = _START
            w[2:] = np.fromiter(map(digest, words), np.uint64, len(words))
            parts.append(w)
        self.n_words = np.array([len(p) - 2 for p in parts])
        p = np.concatenate(parts)
        ends = np.cumsum(self.n_words + 2)
        inner = np.ones(len(p), bool)  # not a text's first mark, not its second
        inner[ends - self.n_words - 2] = False
        context = inner.copy()  # a text's second mark and its words: each is the context or the end of a bigram
        inner[ends - self.n_words - 1] = False
        two = np.empty_like(p)
        two[1:] = _mix(p[:-1], p[1:])
        at = np.flatnonzero(inner)
        self.text = np.repeat(np.arange(len(parts)), self.n_words)
        self.copies = copies
        self.one, self.two, self.three = p[at], two[at], _mix(two[at - 1], p[at])
        self.before_one, self.before_two = p[at - 1], two[at - 1]  # contexts of the bigram and of the trigram
        marks = np.flatnonzero(context)  # counted n-grams: words and second marks, and the bigrams that end there
        self.all_one, self.all_two = p[marks], two[marks]
        self.all_text = np.repeat(np.arange(len(parts)), self.n_words + 1)


def _summed(hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the sums of their times."""
    if (times == 1).all():
        return np.unique(hashes, return_counts=True)
    order = np.argsort(hashes)
    sorted_ = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[first], np.add.reduceat(times[order], first)


def _packed(h: np.ndarray, numbers: np.ndarray, bounds: np.ndarray, ids: dict[str, np.ndarray], name: str) -> Iterator[pa.RecordBatch]:
    """One row for each stretch of h and numbers between two bounds, with its ids."""
    h, numbers = h.astype(np.uint64, copy=False).tobytes(), numbers.astype(np.int64, copy=False).tobytes()
    for i in range(0, len(bounds) - 1, 32):
        cut = list(zip(bounds[i : i + 32].tolist(), bounds[i + 1 : i + 33].tolist(), strict=False))
        packed = [pa.array([x[8 * a : 8 * z] for a, z in cut], pa.binary()) for x in (h, numbers)]
        yield pa.RecordBatch.from_arrays([*[pa.array(v[i : i + len(cut)]) for v in ids.values()], *packed], names=[*ids, "h", name])


def _stretches(changes: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the stretches of n entries that start at changes, none longer than ROW_ENTRIES."""
    return np.union1d(changes, np.append(np.arange(0, n, ROW_ENTRIES), n))


def _unpacked(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _rows(block: int, h: np.ndarray, m: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """The sorted hashes h of a block, by bucket: the upper bits of a hash."""
    if not len(h):
        return
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    bounds = _stretches(np.flatnonzero(np.diff(bucket)) + 1, len(h))
    at = bucket[bounds[:-1]]
    yield from _packed(h, m, bounds, {"bucket": at, "block": np.full(len(at), block, np.int64)}, "m")


def _merged(t: pa.Table) -> pa.Table:
    """A bucket's entries to corpus counts, for the blocks that have them, of the n-grams with more than one entry."""
    hs = _unpacked(t.column("h"), np.uint64)
    kind = pa.schema([("block", pa.int64()), ("h", pa.binary()), ("c", pa.binary())])
    blocks, row = np.unique(t.column("block").to_numpy(), return_inverse=True)
    h = np.concatenate(hs)
    row = np.repeat(row.astype(np.uint16 if len(blocks) <= 1 << 16 else np.int64), [len(x) for x in hs])
    del hs
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    n = np.diff(np.append(first, len(h)))
    total = np.add.reduceat(np.concatenate(_unpacked(t.column("m"), np.int64))[order], first)
    several = np.repeat(n > 1, n)
    h, row, c = h[several], row[order[several]], np.repeat(total[n > 1], n[n > 1])
    if not len(h):
        return kind.empty_table()
    order = np.argsort(row, kind="stable")
    row = row[order]
    bounds = _stretches(np.flatnonzero(row[1:] != row[:-1]) + 1, len(row))
    return pa.Table.from_batches(_packed(h[order], c[order], bounds, {"block": blocks[row[bounds[:-1]]]}, "c"), kind)


def _grams(long_: bool, bits: int):
    """(block, text, copies), a block's rows side by side, to the block's distinct trigrams, or words and bigrams, by bucket."""

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        b = Block(t.column("text"), t.column("copies").to_numpy())
        times = b.copies[b.text if long_ else b.all_text]
        for hashes in [b.three] if long_ else [b.all_one, b.all_two]:
            yield from _rows(t.column("block")[0].as_py(), *_summed(hashes, times), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, z in zip(bounds, bounds[1:], strict=False):
                if a == z:
                    continue
                if held and held[0].column(0)[0].as_py() != blocks[a]:
                    yield from made(held)
                    held = []
                held.append(batch.slice(a, z - a))
        if held:
            yield from made(held)

    return run


class Counts:
    """Counts of hashes outside a block, from the rows that came back to it."""

    def __init__(self, back: pa.Table):
        h = np.concatenate([np.empty(0, np.uint64), *_unpacked(back.column("h"), np.uint64)])
        order = np.argsort(h)
        self.h, self.c = h[order], np.concatenate([np.empty(0, np.int64), *_unpacked(back.column("c"), np.int64)])[order]
        if len(h) and (twice := self.h[1:] == self.h[:-1]).any():  # a block that two tasks read has two rows a hash
            keep = np.concatenate([[True], ~twice])
            self.h, self.c = self.h[keep], self.c[keep]

    def totals(self, h: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Corpus counts of the sorted hashes h: those that came back, else the block's own."""
        if not len(self.h):
            return local
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.c[at], local)


def _rest(hashes: np.ndarray, text: np.ndarray, copies: np.ndarray, counts: Counts) -> np.ndarray:
    """For each place: the corpus count of its hash less those in one copy of its own text."""
    order = np.argsort(hashes, kind="stable")  # equal hashes side by side, each text's together
    h, t = hashes[order], text[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    new_text = new | np.concatenate([[True], t[1:] != t[:-1]])
    first, first_text = np.flatnonzero(new), np.flatnonzero(new_text)
    own = np.diff(np.append(first_text, len(h)))
    local = np.add.reduceat(copies[t], first)
    total = counts.totals(h[first], local)
    rest = np.empty(len(h), np.int64)
    rest[order] = np.repeat(total, np.diff(np.append(first, len(h)))) - np.repeat(own, np.diff(np.append(first_text, len(h))))
    return rest


def _block_scores(total: int):
    def run(texts: pa.Table, back: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"k": pa.array([], pa.binary()), **{c: pa.array([], pa.int64()) for c in ("copies", "n_words", "n_tri", "n_bi", "n_uni")}, "s": pa.array([], pa.float64())})
        b, counts = Block(texts.column("text"), texts.column("copies").to_numpy()), Counts(back)
        one = _rest(b.all_one, b.all_text, b.copies, counts)
        two = _rest(b.all_two, b.all_text, b.copies, counts)
        three = _rest(b.three, b.text, b.copies, counts)
        starts = np.cumsum(b.n_words + 1) - b.n_words - 1
        at = np.ones(len(one), bool)
        at[starts] = False
        at = np.flatnonzero(at)
        c1, c2, before1, before2 = one[at], two[at], one[at - 1], two[at - 1]
        n = np.maximum(1, total - b.n_words)[b.text]
        tri, bi = three > 0, (three <= 0) & (c2 > 0)
        some = lambda x: np.maximum(x, UNSEEN)
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = np.where(tri, np.log10(some(three)) - np.log10(some(before2)), np.where(bi, np.log10(ALPHA * some(c2)) - np.log10(some(before1)), np.log10(ALPHA**2 * some(c1)) - np.log10(n)))
        summed = lambda x: np.bincount(b.text, weights=x, minlength=len(b.n_words))
        n_tri, n_bi = (summed(x.astype(np.float64)).astype(np.int64) for x in (tri, bi))
        return pa.table({"k": texts.column("k"), "copies": texts.column("copies"), "n_words": b.n_words.astype(np.int64), "n_tri": n_tri, "n_bi": n_bi, "n_uni": b.n_words - n_tri - n_bi, "s": summed(cost)})

    return run


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_tri, n_bi, n_uni (words by the level that was used) and score of every document."""
    given = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    worded = given.where(docs["text"].rlike("[^\\x20\\x09-\\x0D]"))
    texts = worded.groupBy("text").agg(F.count("*").alias("copies"))
    texts = texts.mapInArrow(_in_blocks, "block long, words long, text binary, copies long").select("block", "words", "text", "copies", _key(F.col("text")).alias("k"))
    texts = stored(texts, "zstd")
    parts = texts.select("block", "text", "copies")
    total, distinct = (x or 0 for x in texts.agg(F.sum(F.col("copies") * F.col("words")), F.sum("words")).first())
    bits = max(1, (2 * distinct // BUCKET_ENTRIES).bit_length())
    backs = [stored(parts.mapInArrow(_grams(long_, bits), GRAMS).groupBy("bucket").applyInArrow(_merged, COUNTS), "zstd") for long_ in (False, True)]
    back = backs[0].unionByName(backs[1])
    kind = "k binary, copies long, n_words long, n_tri long, n_bi long, n_uni long, s double"
    waves = []
    for i in range(WAVES):
        now = F.pmod(F.xxhash64("block"), F.lit(WAVES)) == i
        both = texts.where(now).groupBy("block").cogroup(back.where(now).groupBy("block"))
        waves.append(stored(both.applyInArrow(_block_scores(int(total)), kind)))
    drop_stored(texts, *backs)
    scores = reduce(DataFrame.unionByName, waves)
    n_rows = scores.agg(F.sum("copies")).first()[0] or 0
    keyed = given.select("doc_id", _key(F.coalesce("text", F.lit(b""))).alias("k"))
    out = split_join(keyed, scores, "k", "copies", n_rows, "left")
    counted = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("n_words", "n_tri", "n_bi", "n_uni")]
    return out.select("doc_id", *counted, F.round(F.col("s") / F.col("n_words"), 5).alias("score"))


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


#: The start mark is the empty string, which is no word.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, ['', ''] || coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
places AS (SELECT doc_id, i, CASE WHEN i > 2 THEN w[i - 2] END AS x, w[i - 1] AS y, w[i] AS z FROM (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM d WHERE len(w) > 2)),
rest AS (SELECT doc_id, i, count(*) OVER (PARTITION BY x, y, z) - count(*) OVER (PARTITION BY doc_id, x, y, z) AS c3,
         count(*) OVER (PARTITION BY y, z) - count(*) OVER (PARTITION BY doc_id, y, z) AS c2, count(*) OVER (PARTITION BY z) - count(*) OVER (PARTITION BY doc_id, z) AS c1 FROM places),
context AS (SELECT *, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS before2, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS before1 FROM rest),
n AS (SELECT doc_id, len(w) - 2 AS n_words, greatest(1, sum(len(w) - 2) OVER () - len(w) + 2) AS others FROM d),
costs AS (SELECT doc_id, c3 > 0 AS tri, c3 <= 0 AND c2 > 0 AS bi,
          CASE WHEN c3 > 0 THEN log10(c3) - log10(before2) WHEN c2 > 0 THEN log10(0.4 * c2) - log10(before1) ELSE log10(0.16 * greatest(c1, 0.5)) - log10(others) END AS cost
          FROM context JOIN n USING (doc_id) WHERE i > 2),
summed AS (SELECT doc_id, count(*) FILTER (tri) AS n_tri, count(*) FILTER (bi) AS n_bi, sum(cost) AS s FROM costs GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n_tri, 0)::BIGINT AS n_tri, coalesce(n_bi, 0)::BIGINT AS n_bi,
       (n_words - coalesce(n_tri, 0) - coalesce(n_bi, 0))::BIGINT AS n_uni, round(s / n_words, 5) AS score
FROM n LEFT JOIN summed USING (doc_id)
"""
