"""Alignment of two tokenizers' tokens of the same texts, as a sweep over the events "a token of A, of B, ends here".

Each side is encoded by itself into events: rows with a document, an offset, the side, and a run of up to RUN tokens
that start there (ids and byte lengths, packed). The union of both sides is repartitioned by document and sorted by
offset inside each partition; the sweep reads it as one stream. It holds only the tokens since the last offset
where tokens of both sides ended, and closes a group at each such offset; a document ends at one as well. All tokens of a group's
two sides are linked.

How many documents hold a linked pair of ids is counted in two steps: the sweep counts inside batches of documents, Spark adds
the batches up. So a pair that every document holds is one row a batch. The counts return to the batches by a join on the pair.

Cases: null and empty texts, and texts whose tokens' bytes aren't those of a space and the text (invalid UTF-8 included),
have no tokens; texts of any length are read whole, and split into runs; repeated rows of one id and text are swept once and
counted and returned each; an empty table gives no rows; columns other than the id and text aren't looked at. Ids may be of any type
that sorts, null included.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settings_of_jobs, stored, table
from .sentencepiece_codec import MARK, Codec

#: Tokens of an event row; tokens of one side that are swept at once; entries (document and pair) of a batch; links expanded at once.
RUN, SWEPT, ENTRIES, EXPANDED = 4096, 1 << 19, 3 << 20, 1 << 21
CACHE_CHUNKS = 200_000
#: Text length from which a run of the same kind of character may be too long for the fast encoder's pattern.
LONG_RUN = 50_000


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE of the tokenizers library. Where its rules are the common ones, a faster encoder with the same ranks does the work."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the public pattern of such vocabularies

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, letters = path, byte_alphabet()
        ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.tokens = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            known = all(c in letters for c in token)
            self.tokens[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.fast = self._fast(spec)

    @cached_property
    def whole(self):
        """The library's own encoder; it takes much memory, so only where it is needed."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def _fast(self, spec: dict):
        import tiktoken

        rules, model = spec.get("pre_tokenizer") or {}, spec["model"]
        common = rules.get("type") == "ByteLevel" and not rules.get("add_prefix_space") and rules.get("use_regex") and not spec.get("normalizer")
        special = {t["id"] for t in spec.get("added_tokens") or [] if t["special"]}
        if not common or len(special) != len(spec.get("added_tokens") or []) or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        ranks = {t: i for i, t in enumerate(self.tokens) if i not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"].get("".join(m)) != 256 + i for i, m in enumerate(merges)) or len(ranks) != 256 + len(merges):
            return None
        return tiktoken.Encoding("from_file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            t = " " + t
            if self.fast is None or (len(t) > LONG_RUN and re.search(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}", t)):
                out.append(np.array(self.whole.encode(t, add_special_tokens=False).ids, np.int32))
            else:
                out.append(np.array(self.fast.encode_ordinary(t), np.int32))
        return out


class Pieces:
    """A sentencepiece model. Where no piece crosses a space, texts are encoded by chunks, and common chunks once."""

    def __init__(self, path: str):
        self.codec = Codec(path)
        model = self.codec.decoder
        n = model.get_piece_size()
        self.tokens = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        codec, cache = self.codec, self.cache
        if not codec.plain:
            return [np.array(x, np.int32) for x in codec.decoder.encode(texts, num_threads=1)]
        cut = [codec.chunks(MARK + t.replace(" ", MARK)) for t in texts]
        new = list({c for chunks in cut for c in chunks if c not in cache})
        found = {c: np.array(x, np.int32).tobytes() for c, x in zip(new, codec.encoder.encode(new, num_threads=1), strict=True)}
        cache.update(list(found.items())[: max(0, CACHE_CHUNKS - len(cache))])
        return [np.frombuffer(b"".join([cache.get(c) or found[c] for c in chunks]), np.int32) for chunks in cut]


_held: dict[tuple, ByteLevel | Pieces] = {}


def encoder(side: int, path: str) -> ByteLevel | Pieces:
    """A side's encoder; a Python worker holds one at a time, as its tasks have one side each."""
    if (side, path) not in _held:
        _held.clear()
        _held[side, path] = (ByteLevel, Pieces)[side](path)
    return _held[side, path]


def _narrow(values: np.ndarray, top: int) -> bytes:
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64)


def events(docs: DataFrame, side: int, path: str) -> DataFrame:
    """(doc_id, text_hash, side, at, n, ids, sizes): runs of a side's tokens, by the offset in bytes of a space and the text; at is -1 where the bytes differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(side, path)
        sizes_of = np.array([len(t) for t in code.tokens], np.int64)
        widest, most = int(sizes_of.max()), len(code.tokens)
        for batch in batches:
            sources = [t.as_py() for t in batch.column(2)]
            texts: list[str | None] = []
            for s in sources:
                try:
                    texts.append(s.decode())
                except UnicodeDecodeError:
                    texts.append(None)
            coded = iter(code.encode([t for t in texts if t is not None]))
            row, rows = [], []
            for i, (s, t) in enumerate(zip(sources, texts, strict=True)):
                ids = next(coded) if t is not None else None
                if ids is None or b"".join(map(code.tokens.__getitem__, ids.tolist())) != b" " + s:
                    row.append(i)
                    rows.append((-1, 0, None, None))
                    continue
                sizes, at = sizes_of[ids], 0
                for k in range(0, len(ids), RUN):
                    x, z = ids[k : k + RUN], sizes[k : k + RUN]
                    row.append(i)
                    rows.append((at, len(x), _narrow(x, most), _narrow(z, widest)))
                    at += int(z.sum())
            keys = batch.select([0, 1]).take(pa.array(row, pa.int32()))
            at, n, ids, sizes = zip(*rows, strict=True) if rows else ((), (), (), ())
            values = [pa.array([side] * len(row), pa.int8()), pa.array(at, pa.int64()), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array(sizes, pa.binary())]
            yield pa.RecordBatch.from_arrays([*keys.columns, *values], names=["doc_id", "text_hash", "side", "at", "n", "ids", "sizes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, text_hash long, side byte, at long, n int, ids binary, sizes binary")


class Stretch:
    """A stretch of the stream that ends where a group does: its tokens by side, group borders, and which documents it holds."""

    def __init__(self, ids: list[np.ndarray], ends: list[np.ndarray], borders: np.ndarray, closes: list[np.ndarray], docs: list[tuple[int, int, int, bool]]):
        self.ids, self.borders = ids, borders
        self.upto = [np.cumsum(c) for c in closes]  # groups closed up to and with each token
        self.group = [u - c for u, c in zip(self.upto, closes, strict=True)]
        self.last = [np.flatnonzero(c) + 1 for c in closes]  # tokens up to each group's end
        self.first = [np.concatenate([[0], x[:-1]]) for x in self.last]
        self.n = [b - a for a, b in zip(self.first, self.last, strict=True)]
        self.closes, self.docs = closes, docs  # docs: (slot, tokens of A and of B up to the end of its part here, whether it ends)


class Sweep:
    """The constant-state machine: tokens come in by document and offset, stretches of closed groups go out."""

    def __init__(self):
        self.open: list[list] = [[], []]  # (ids, sizes) of the tokens not yet handed on
        self.held = [0, 0]
        self.docs: list[tuple[int, int, int, bool]] = []  # documents that have ended among them

    def add(self, side: int, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.open[side].append((ids, sizes))
        self.held[side] += len(ids)

    def end(self, slot: int) -> None:
        self.docs.append((slot, *self.held, True))

    def hand_on(self, slot: int | None = None) -> Stretch | None:
        """All groups closed so far; slot is that of the document that goes on."""
        if not all(self.held):
            return None
        ids, sizes = ([np.concatenate([p[k] for p in self.open[s]]) for s in (0, 1)] for k in (0, 1))
        ends = [np.cumsum(z) for z in sizes]
        marks = np.zeros(max(int(ends[0][-1]), int(ends[1][-1])) + 1, bool)
        marks[ends[0]] = True
        common = ends[1][marks[ends[1]]]
        marks[:] = False
        marks[common] = True
        closes = [marks[e] for e in ends]
        if not len(common):
            return None
        done = [int(np.flatnonzero(c)[-1]) + 1 for c in closes]
        docs = list(self.docs)
        if slot is not None and (not docs or docs[-1][1] < done[0]):
            docs.append((slot, *done, False))
        self.open = [[(ids[s][done[s] :], sizes[s][done[s] :])] for s in (0, 1)]
        self.held = [len(ids[s]) - done[s] for s in (0, 1)]
        self.docs = []
        return Stretch([ids[s][: done[s]] for s in (0, 1)], [ends[s][: done[s]] for s in (0, 1)], common, [closes[s][: done[s]] for s in (0, 1)], docs)


def _stretches(batches: Iterator[pa.RecordBatch], begin) -> Iterator[Stretch | None]:
    """Stretches of sorted events; None after each document that could end a batch. begin(doc_id, copies, valid) gives a document's slot when it is complete or goes on."""
    sweep, key, slot, copies, valid, place = Sweep(), None, None, 0, True, None
    first = True

    def finish():
        nonlocal slot
        if first:
            return
        if slot is None:
            slot = begin(key[0], copies, valid)
        if valid:
            sweep.end(slot)

    for batch in batches:
        ids, hashes = batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist()
        sides, ats, ns = batch["side"].to_pylist(), batch["at"].to_pylist(), batch["n"].to_pylist()
        for i in range(batch.num_rows):
            now = (ids[i], hashes[i])
            if first or now != key:
                finish()
                if max(sweep.held) >= SWEPT:
                    yield sweep.hand_on()
                    yield None
                key, slot, copies, valid, place, start, first = now, None, 0, ats[i] >= 0, None, (ats[i], sides[i]), False
            if (ats[i], sides[i]) == start:
                copies += 1
            if (ats[i], sides[i]) == place or not valid:  # a repeated row's run
                continue
            place = (ats[i], sides[i])
            sweep.add(sides[i], _wide(batch["ids"][i].as_buffer(), ns[i]), _wide(batch["sizes"][i].as_buffer(), ns[i]))
            if min(sweep.held) >= 2 * SWEPT:  # in the midst of a long text
                if slot is None:
                    slot = begin(key[0], copies, valid)
                part = sweep.hand_on(slot)
                if part is not None:
                    yield part
    finish()
    part = sweep.hand_on()
    if part is not None:
        yield part
    yield None


class Document:
    """What is known of a document so far."""

    def __init__(self, doc_id, copies: int):
        self.doc_id, self.copies = doc_id, copies
        self.n_a = self.n_b = self.n_groups = self.n_links = self.size = 0
        self.digest = hashlib.sha256()


def _decimals(n: int) -> np.ndarray:
    """Decimal digits of each number under n, padded by zero bytes."""
    width = len(str(max(n - 1, 0)))
    return np.array([str(i) for i in range(n)], f"S{width}").view(np.uint8).reshape(n, width)


def _written(part: Stretch, digits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The groups as `a1,a2|b1;a3|b2,b3;`, and the end of each group in it."""
    n = [len(x) for x in part.ids]
    out = np.zeros((n[0] + n[1], digits.shape[1] + 1), np.uint8)
    place = [np.arange(n[0]) + part.first[1][part.group[0]], np.arange(n[1]) + part.last[0][part.group[1]]]
    for s, close in ((0, ord("|")), (1, ord(";"))):
        out[place[s], :-1] = digits[part.ids[s]]
        out[place[s], -1] = np.where(part.closes[s], close, ord(","))
    sizes = np.cumsum((out != 0).sum(1))
    return out.tobytes().translate(None, b"\0"), sizes[part.last[0] + part.last[1] - 1]


def _unique(slots: np.ndarray, pairs: np.ndarray, counts: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (slot, pair) in order and the sum of their counts (one each if None)."""
    key = (slots << bits) | pairs
    if counts is None:
        key, n = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.add.reduceat(counts[order], start) if len(key) else counts
        key = key[start]
    return key >> bits, key & ((1 << bits) - 1), n


BATCH = "batch long, doc_ids array<{}>, copies array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, pair_docs array<long>, slots binary, places binary, times binary"


def _links(n_a: int, n_b: int, kind: pa.DataType):
    """Sweep of sorted events to batches of documents with their linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits, bits = _decimals(max(n_a, n_b)), max(n_a * n_b - 1, 1).bit_length()
        task, made = TaskContext.get().partitionId(), 0
        docs: list[Document] = []
        entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def begin(doc_id, copies, valid):
            docs.append(Document(doc_id, copies))
            return len(docs) - 1

        def take(part: Stretch) -> None:
            text, ends = _written(part, digits)
            links = np.cumsum(part.n[0] * part.n[1])
            a0 = b0 = g0 = 0
            slot_of = np.zeros(len(part.ids[0]), np.int64)
            for slot, a1, b1, _ in part.docs:
                d, g1 = docs[slot], int(part.upto[0][a1 - 1])
                said = text[int(ends[g0 - 1]) if g0 else 0 : int(ends[g1 - 1]) - 1]
                d.digest.update(b";" + said if d.n_groups else said)
                d.n_a, d.n_b, d.n_groups = d.n_a + a1 - a0, d.n_b + b1 - b0, d.n_groups + g1 - g0
                d.n_links += int(links[g1 - 1]) - (int(links[g0 - 1]) if g0 else 0)
                slot_of[a0:a1] = slot
                a0, b0, g0 = a1, b1, g1
            a, b = part.ids
            times = part.n[1][part.group[0]]  # links of each token of A
            upto, at = np.cumsum(times), 0
            while at < len(a):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + EXPANDED)))
                t = times[at:to]
                start = np.cumsum(t) - t
                partner = np.arange(int(t.sum())) + np.repeat(part.first[1][part.group[0][at:to]] - start, t)
                entries.append(_unique(np.repeat(slot_of[at:to], t), np.repeat(a[at:to] * n_b, t) + b[partner], None, bits))
                at = to

        def merged() -> None:
            if len(entries) > 1:
                whole = _unique(*(np.concatenate(v) for v in zip(*entries, strict=True)), bits)
                entries[:] = [whole]

        def out() -> pa.RecordBatch:
            nonlocal made
            merged()
            slots, pairs, times = entries[0] if entries else (np.zeros(0, np.int64),) * 3
            copies = np.array([d.copies for d in docs], np.int64)
            known, places = np.unique(pairs, return_inverse=True)
            holders = np.bincount(places, weights=copies[slots], minlength=len(known)).astype(np.int64)
            lists = [[d.doc_id for d in docs], copies, *([getattr(d, k) for d in docs] for k in ("n_a", "n_b", "n_groups", "n_links")), [d.digest.hexdigest() if d.n_groups else "" for d in docs], known, holders]
            types = [kind, *[pa.int64()] * 5, pa.string(), pa.int64(), pa.int64()]
            one = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t)) for v, t in zip(lists, types, strict=True)]
            packed = [pa.array([v.astype("<u4").tobytes()], pa.binary()) for v in (slots, places, times)]
            row = pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), *one, *packed], names=[c.split()[0] for c in BATCH.split(", ")])
            made += 1
            docs.clear()
            entries.clear()
            return row

        n = 0
        for part in _stretches(batches, begin):
            if part is not None:
                take(part)
                if len(entries) > 4:
                    merged()
                n = sum(len(e[0]) for e in entries)
            elif n >= ENTRIES:  # a document has ended
                yield out()
                n = 0
        if docs:
            yield out()

    return run


def _swept(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Both sides' events, in the order in which the sweep reads them."""
    some = docs.where("octet_length(text) > 0")
    both = events(some, 0, a_path).unionByName(events(some, 1, b_path))
    return both.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "at", "side")


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, grp, start, stop, a_ids, b_ids): every group with its bytes in the text (the added space has none), in a row each; repeated rows each give theirs."""
    kind = docs.schema["doc_id"].dataType
    arrow = docs.sparkSession.createDataFrame([], docs.select("doc_id").schema).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[Document] = []

        def begin(doc_id, copies, valid):
            docs.append(Document(doc_id, copies))
            return len(docs) - 1

        for part in _stretches(batches, begin):
            if part is None:
                continue
            stops = part.borders
            starts, g0, shift = np.concatenate([[0], stops[:-1]]), 0, 0
            row, grp, begins, ends = [], [], [], []
            for slot, a1, _, _ in part.docs:
                d, g1 = docs[slot], int(part.upto[0][a1 - 1])
                for _ in range(d.copies):
                    row.append(np.arange(g0, g1))
                    grp.append(d.n_groups + np.arange(g1 - g0))
                    begins.append(np.maximum(starts[g0:g1] - shift + d.size - 1, 0))
                    ends.append(stops[g0:g1] - shift + d.size - 1)
                d.n_groups, d.size, g0, shift = d.n_groups + g1 - g0, d.size + int(stops[g1 - 1]) - shift, g1, int(stops[g1 - 1])
            names = [docs[slot].doc_id for slot, *_ in part.docs for _ in range(docs[slot].copies)]
            at, name = np.concatenate(row), np.repeat(np.arange(len(names)), [len(x) for x in row])
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], part.last[s]]), pa.int32()), pa.array(part.ids[s], pa.int32())).take(pa.array(at)) for s in (0, 1)]
            values = [pa.array(names, arrow).take(pa.array(name)), *(pa.array(np.concatenate(v), pa.int64()) for v in (grp, begins, ends)), *lists]
            yield pa.RecordBatch.from_arrays(values, names=["doc_id", "grp", "start", "stop", "a_ids", "b_ids"])

    return _swept(docs, a_path, b_path).mapInArrow(run, f"doc_id {kind.simpleString()}, grp long, start long, stop long, a_ids array<int>, b_ids array<int>")


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    A linked pair's count is the number of documents that hold it; a link is best if no pair of its A id has a higher count.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    arrow = spark.createDataFrame([], docs.select("doc_id").schema).toArrow().schema.field(0).type
    n_a, n_b = (len(encoder(s, p).tokens) for s, p in ((0, a_path), (1, b_path)))
    batches = stored(_swept(docs, a_path, b_path).mapInArrow(_links(n_a, n_b, arrow), BATCH.format(kind)), "zstd")
    each = batches.select("batch", F.posexplode(F.arrays_zip("pairs", "pair_docs")).alias("at", "p")).select("batch", "at", F.col("p.pairs").alias("pair"), F.col("p.pair_docs").alias("holders"))
    counts = each.groupBy("pair").agg(F.sum("holders").alias("n"))
    # an A id has at most as many pairs as B has ids
    best = F.col("n") == F.max("n").over(Window.partitionBy((F.col("pair") / n_b).cast("long")))
    scored = stored(counts.select("pair", (F.col("n") * 2 + best.cast("int")).alias("value")))
    back = each.select("batch", "at", "pair").join(scored, "pair").select("batch", "at", "value")
    out = "doc_id {}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string".format(kind)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1)
        n = len(row["copies"][0].values)
        value = np.zeros(right.num_rows, np.int64)
        value[right["at"].to_numpy()] = right["value"].to_numpy()
        slots, places, times = (np.frombuffer(row[c][0].as_buffer(), "<u4").astype(np.int64) for c in ("slots", "places", "times"))
        v, upto = value[places], np.searchsorted(slots, np.arange(n + 1))
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[upto])
        lists = {c: row[c][0].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        lists |= {"n_best": pa.array(total(times * (v & 1))), "count_sum": pa.array(total(times * (v >> 1)))}
        rows = pa.array(np.repeat(np.arange(n), row["copies"][0].values.to_numpy()))
        names = [c.split()[0] for c in out.split(", ")]
        return pa.table([lists["doc_ids" if c == "doc_id" else c].take(rows) for c in names], names=names)

    heavy = batches.drop("pairs", "pair_docs").withColumnRenamed("batch", "of_batch")
    with settings_of_jobs(spark):
        done = heavy.groupBy("of_batch").cogroup(back.groupBy("batch")).applyInArrow(finish, out)
    none = docs.where("coalesce(octet_length(text), 0) = 0").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.lit("").alias("groups_sha256"))
    return done.unionByName(none)


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"), *paths())
