"""Language identification by cross-parsing entropy.

Per language, a suffix automaton is built over a bounded sample of labelled texts. A text is cross-parsed against
each automaton: it is cut, from left to right, into the longest phrases that occur in that language's sample; a
character that no text of the sample has is a phrase by itself. The phrases, each worth log2(sample length) bits, give
bits per character; the language with the fewest wins. The score is the margin to the second best, as a share of it.

Sample, the only bounded part: of each language's labelled training documents with a letter, whole texts in the order
of their ids' hashes, at most `SAMPLE_DOCS` of them and together at most `SAMPLE_CHARS` characters, or `TOTAL_CHARS` over
the number of languages if that is less. Texts longer than a language's share come last, so that one is only taken,
whole, where the language has no other. Every label is learned. Predictions read whole texts and nothing but texts.

All automata are one table of overlapping rows (some four places a character of the sample), broadcast once: its size
is bounded by `TOTAL_CHARS`, but for a language whose only text is longer. Texts are taken some megabytes at a time and parsed side by side: one NumPy step moves every (text,
language) pair one character ahead. When few texts are still running, they are finished one by one.

Cases: a null text, or one without a letter, is `und` with score 0; a tie takes the alphabetically first language
with score 0; without any training text everything is `und`; repeated rows each get a row; an empty table gives no
rows; very long texts are parsed whole; columns other than doc_id, text and lang, whatever their names, aren't looked
at; a null doc_id counts as held out from training.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored, table

SAMPLE_DOCS, SAMPLE_CHARS, TOTAL_CHARS = 200, 60_000, 1_000_000
#: Characters that are parsed at a time, and the number of running (text, language) pairs below which each is parsed by itself.
BATCH_CHARS, FEW = 4 << 20, 64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(language, training text), by language; bounded by the constants above."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    langs = labelled.agg(F.count_distinct("lang")).first()[0]
    share = min(SAMPLE_CHARS, TOTAL_CHARS // max(1, langs))
    ids = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.length("text").alias("size"), F.md5("text").alias("k")).withColumn("long", F.col("size") > share)
    order = Window.partitionBy("lang").orderBy("long", "h", "doc_id", "k")  # Spark limits each task's rows before the exchange
    ids = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_DOCS)
    ids = ids.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ids = ids.where((F.col("upto") <= share) | (F.col("n") == 1)).select("doc_id", "lang", "k").distinct()
    chosen = docs.select("doc_id", "lang", "text", F.md5("text").alias("k")).join(small(stored(ids)), ["doc_id", "lang", "k"], "left_semi")
    by: dict[str, set] = {}
    for r in chosen.select("doc_id", "lang", "text").distinct().toLocalIterator():
        by.setdefault(r["lang"], set()).add((r["doc_id"], r["text"]))
    return [(lang, "\n".join(t for _, t in sorted(by[lang]))) for lang in sorted(by)]


class SuffixAutomaton:
    """States and transitions of the minimal automaton of all substrings of a text of small integers."""

    def __init__(self, text: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class Model:
    """Automata of all languages in one table of overlapping rows.

    A state is the number of the place where its row begins; its transition by class c lies c places on and holds the
    next state and, in the lowest `bits` bits, c itself. No two states begin at the same place, so an entry with class c
    found there is the state's own. Class 0 is any character that no sample has; it has no entries, and neither has
    the row of the state `dead`.
    """

    def __init__(self, texts: list[tuple[str, str]]):
        self.langs = [lang for lang, _ in texts]
        letters = sorted(set().union(*(set(t) for _, t in texts)))
        self.n_classes = len(letters) + 1
        self.bits = self.n_classes.bit_length()  # an empty entry, -1, shows a class that there isn't
        self.classes = np.zeros(0x110000, np.uint16 if len(letters) < 1 << 16 else np.int32)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        source, by, target, roots, at = [], [], [], [], 0
        for _, t in texts:
            states = SuffixAutomaton(self.classes[np.array([ord(c) for c in t])].tolist()).next
            size = [len(x) for x in states]
            source.append(np.repeat(np.arange(len(states)), size) + at)
            by.append(np.fromiter((c for x in states for c in x), np.int64, sum(size)))
            target.append(np.fromiter((s for x in states for s in x.values()), np.int64, sum(size)) + at)
            roots.append(at)
            at += len(states)
        self.phrase_bits = np.log2([max(2, len(t)) for _, t in texts])
        source, by, target = (np.concatenate([np.empty(0, np.int64), *x]) for x in (source, by, target))
        places = 2 * len(by) + 16
        begin = self._begins(source, by, at, places)
        self.dead = places + self.n_classes
        begin[begin < 0] = self.dead  # states without transitions
        self.table = np.full(self.dead + self.n_classes, -1, np.int64)
        self.table[begin[source] + by] = begin[target] << self.bits | by
        self.roots = begin[np.array(roots, np.int64)]

    def _begins(self, source: np.ndarray, by: np.ndarray, states: int, places: int) -> np.ndarray:
        """Where each state's row begins (-1 without transitions); at most half of the places are ever taken.

        Rows of many entries go first. Each turn, all rows still left try a place drawn at random (with a fixed seed);
        those that clash with a placed row, or with another of this turn, try again.
        """
        size = np.bincount(source, minlength=states)
        lo = np.cumsum(size) - size
        begin, taken, used = np.full(states, -1, np.int64), np.zeros(places + self.n_classes, bool), np.zeros(places, bool)
        draw = np.random.default_rng(1)
        most = int(size.max(initial=0))
        while most:
            least = most // 2 + 1
            left = np.flatnonzero((size >= least) & (size <= most))
            while len(left):
                at = draw.integers(0, places, len(left))
                n = size[left]
                row = np.repeat(np.arange(len(left)), n)
                edge = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[left], n)
                slot = at[row] + by[edge]
                bad = used[at]
                _, once, again = np.unique(at, return_index=True, return_counts=True)
                bad |= ~np.isin(np.arange(len(left)), once[again == 1])
                _, back, shared = np.unique(slot, return_inverse=True, return_counts=True)
                bad[row[taken[slot] | (shared[back] > 1)]] = True
                if bad.all() and len(left) > 1:  # a table that is small for its rows: one at a time
                    free = ~used[at]
                    free[row[taken[slot]]] = False
                    bad[np.flatnonzero(free)[:1]] = False
                begin[left[~bad]] = at[~bad]
                used[at[~bad]] = True
                taken[slot[~bad[row]]] = True
                left = left[bad]
            most = least - 1
        return begin

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each text (rows; arrays of classes, which are used up) in each language (columns)."""
        n, langs = len(coded), len(self.langs)
        lengths = np.array([len(c) for c in coded])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        text = np.concatenate([coded[i] for i in order]) if n else np.empty(0, np.int64)
        coded.clear()
        starts = np.cumsum(lengths) - lengths
        state, count = np.full(n * langs, self.dead, np.int64), np.zeros(n * langs, np.int64)
        roots = np.tile(self.roots, n)  # a text's languages lie side by side
        last = int(lengths[0]) if n else 0
        running = np.searchsorted(-lengths, -np.arange(last + 1), side="left")  # texts longer than t
        bits, mask = self.bits, (1 << self.bits) - 1
        t = 0
        while t < last and (k := int(running[t])) * langs > FEW:
            c = np.repeat(text[starts[:k] + t].astype(np.int64), langs)
            m = k * langs
            found = self.table.take(state[:m] + c)
            stuck = np.flatnonzero((found & mask) != c)
            np.right_shift(found, bits, out=state[:m])
            if stuck.size:  # the phrase ends; the next begins with this character
                c = c.take(stuck)
                found = self.table.take(roots.take(stuck) + c)
                state[stuck] = np.where((found & mask) == c, found >> bits, self.dead)
                count[stuck] += 1
            t += 1
        table, dead = memoryview(self.table), self.dead
        for i in range(int(running[t]) if t < last else 0):
            rest = text[starts[i] + t : starts[i] + lengths[i]].tolist()
            for j in range(langs):
                s, ends, root = int(state[i * langs + j]), 0, int(self.roots[j])
                for c in rest:
                    x = table[s + c]
                    if x & mask == c:
                        s = x >> bits
                    else:
                        ends += 1
                        x = table[root + c]
                        s = x >> bits if x & mask == c else dead
                count[i * langs + j] += ends
        out = np.empty((n, langs), np.int64)
        out[order] = count.reshape(n, langs)
        return out

    def predict(self, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
        coded, lettered = [], []
        for t in texts:
            coded.append(self.classes[np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32)])
            lettered.append(bool(t) and (t.isalpha() or any(map(str.isalpha, t))))
        if not self.langs:
            return ["und"] * len(coded), [0.0] * len(coded)
        lengths = np.maximum(1, [len(c) for c in coded])
        cost = self.phrases(coded) * self.phrase_bits / lengths[:, None]
        best = cost.argmin(axis=1)
        low = cost[np.arange(len(cost)), best]
        second = np.partition(cost, 1, axis=1)[:, 1] if len(self.langs) > 1 else 2 * low
        score = np.where(second > 0, 1 - low / np.maximum(second, 1e-300), 0.0)
        found = [(self.langs[b], float(s)) if ok else ("und", 0.0) for b, s, ok in zip(best, score, lettered, strict=True)]
        return [x[0] for x in found], [x[1] for x in found]


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about BATCH_CHARS bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_CHARS, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _predict_batches(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 0):
                langs, scores = model.value.predict(t.as_py() for t in part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names[1:], "lang_pred", "score"])

    return run


def fitted(docs: DataFrame) -> Broadcast:
    """The model of docs' own labelled part, of bounded size, sent to each executor once."""
    return docs.sparkSession.sparkContext.broadcast(Model(sample(docs)))


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns of every document, with lang_pred and score. Learns from docs' own labelled part."""
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("text").alias("text"), *keep).mapInArrow(_predict_batches(fitted(docs)), f"{kept}, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents (all columns) that have a language: those with a letter, where there is anything to learn from."""
    model, text = fitted(docs), docs.columns.index("text")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, text):
                langs, _ = model.value.predict(t.as_py() for t in part.column(text))
                yield part.filter(pa.array([x != "und" for x in langs]))

    return docs.mapInArrow(chosen, docs.schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
