"""SentencePiece encoding with offsets, and decoding.

Normalisation reads the model's compiled character map (a double-array trie over UTF-8 bytes): at each place the
longest prefix that the map has is replaced, anything else is copied character by character, and for each byte of
the result the source byte it came from is recorded. The normalised text is cut before each run of the space mark;
when no piece of the vocabulary crosses such a cut, merges can't either, so each chunk is encoded alone and common
chunks come from a bounded cache. Every piece is then projected to its byte span of the original text. Texts that
the map leaves as they are (no map, no space mark of their own) skip the per-character work: there a piece's
source length follows from its own bytes.

A byte-fallback piece that doesn't end its character has an empty span; the last one has the whole character.

Cases: null counts as the empty text, whose only id is the end id; texts of any length are encoded whole; repeated
rows each get a row; an empty table gives no rows; columns other than the id and text aren't looked at. Bytes that
aren't UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
CACHE_CHUNKS, CACHE_CHARS = 60_000, 64
BATCH_BYTES = 1 << 20


class CharacterMap:
    """Longest-prefix replacement by a compiled map: trie size, trie units, then zero-terminated replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.texts = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """(length of the longest key that starts at `at`, its replacement), if there is one."""
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(source)):
            node ^= source[i]
            if node >= len(units) or units[node] & 0x800000FF != source[i]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit & 0x100:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.texts[start : self.texts.index(b"\0", start)])
        return found

    def step(self, source: bytes, at: int) -> tuple[int, bytes]:
        """(source bytes used, what they become); at a character's first byte."""
        if self.units and (found := self.longest(source, at)):
            return found
        lead = source[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, source[at : at + size]


class Normaliser:
    """Text to its normalised bytes and the source place of each of these, and of their end."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.space = MARK.encode() if self.escape else b" "
        self.plain = not self.map.units and self.prefix and not self.squeeze and self.escape

    def __call__(self, source: bytes) -> tuple[bytes, list[int]]:
        at, end = 0, len(source)
        if self.squeeze:
            while at < end and (step := self.map.step(source, at))[1] == b" ":
                at += step[0]
        if at == end:
            return b"", [0]
        out, align = bytearray(), []

        def put(text: bytes, place: int) -> None:
            out.extend(text)
            align.extend([place] * len(text))

        if self.prefix:
            put(self.space, at)
        after_space = self.squeeze
        while at < end:
            used, text = self.map.step(source, at)
            if after_space:
                text = text.lstrip(b" ")
            if text:
                put(text.replace(b" ", self.space), at)
                after_space = self.squeeze and text.endswith(b" ")
            at += used
        if self.squeeze:
            while out.endswith(self.space):
                end = align[-1]
                del out[-len(self.space) :], align[-len(self.space) :]
        return bytes(out), [*align, end]


class Codec:
    """A model's encoder and decoder. One per Python worker; see `of`."""

    _held: dict[str, Codec] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.normalise = Normaliser(model.normalizer_spec)
        pieces = [p.piece for p in model.pieces]
        is_byte = np.array([p.type == 6 for p in model.pieces])
        self.size = np.where(is_byte, 1, [len(p.encode()) for p in pieces]).astype(np.int32)  # bytes of normalised text
        self.marks = np.where(is_byte, 0, [p.count(MARK) for p in pieces]).astype(np.int32)
        self.unknown = np.array([p.type == 2 for p in model.pieces])
        crossing = any(MARK in p.lstrip(MARK) for p in pieces) or any(p.type == 4 for p in model.pieces)
        self.chunks = re.compile(".+" if crossing else f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.DOTALL).findall
        self.plain = self.normalise.plain and not crossing
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.end = self.decoder.eos_id()
        spec = model.normalizer_spec  # from here on, the text given is already normalised
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.anchor = next(i for i, p in enumerate(model.pieces) if p.type == 1 and p.piece.isascii() and p.piece.isalpha())
        self.anchor_text = pieces[self.anchor]
        self.cache: dict[str, tuple[bytes, str]] = {}

    def _encoded(self, chunks: list[str]) -> dict[str, tuple[bytes, str]]:
        """Ids of each chunk (as int32 bytes), and its text as it stands after other text."""
        ids = self.encoder.encode(chunks, num_threads=1)
        texts = self.decoder.decode([[self.anchor, *x] for x in ids], num_threads=1)
        skip = len(self.anchor_text)
        return {c: (np.array(x, np.int32).tobytes(), t[skip:]) for c, x, t in zip(chunks, ids, texts, strict=True)}

    def encode(self, sources: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """(ids, span starts, span ends, decoded text) of each text; the end id comes last, with an empty span."""
        normal, cut, aligned = [], [], []
        for s in sources:
            t = s.decode("utf-8", "replace")
            if self.plain and MARK not in t:
                n, a = MARK + t.replace(" ", MARK) if t else "", None
            else:
                b, a = self.normalise(t.encode())
                n = b.decode()
            normal.append(n)
            aligned.append(a)
            cut.append(self.chunks(n))
        cache = self.cache
        new = list({c for chunks in cut for c in chunks if c not in cache})
        found = self._encoded(new) if new else {}
        room = CACHE_CHUNKS - len(cache)
        if room > 0:
            cache.update([x for x in found.items() if len(x[0]) <= CACHE_CHARS][:room])
        known = {**cache, **found} if len(found) > len(cache) else None
        out = []
        for s, n, a, chunks in zip(sources, normal, aligned, cut, strict=True):
            parts = [cache.get(c) or found[c] for c in chunks] if known is None else [known[c] for c in chunks]
            ids = np.frombuffer(b"".join([p[0] for p in parts]), np.int32)
            text = "".join([p[1] for p in parts])
            if chunks:  # the first chunk's leading mark isn't decoded
                first = self.decoder.decode(np.frombuffer(parts[0][0], np.int32).tolist())
                text = first + text[len(parts[0][1]) :]
            sizes = self.size[ids]
            if self.unknown[ids].any():
                sizes = np.array([1 if p.surface == "" else len(p.surface.encode()) for p in self.encoder.encode(n, out_type="immutable_proto").pieces], np.int32)
            if a is None:
                ends = np.cumsum(sizes - 2 * self.marks[ids]) - 1
                starts = np.maximum(ends - (sizes - 2 * self.marks[ids]), 0)
                starts, ends = self._whole_characters(s, starts, np.maximum(ends, 0), sizes, ids)
            else:
                ends = np.cumsum(sizes)
                place = np.array(a, np.int64)
                starts, ends = place[ends - sizes], place[ends]
            out.append((np.append(ids, np.int32(self.end)), np.append(starts, len(s)), np.append(ends, len(s)), text))
        return out

    @staticmethod
    def _whole_characters(source: bytes, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        """Move ends inside a character (of byte pieces) back to its first byte, as the alignment has them."""
        at = np.frombuffer(source, np.uint8)
        inner = np.append((at & 0xC0) == 0x80, False)
        if not inner.any():
            return starts, ends
        head = np.maximum.accumulate(np.where(inner, 0, np.arange(len(inner))))
        return head[starts], head[ends]

    def decode(self, ids: list[int]) -> str:
        return self.decoder.decode(ids)


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        names = ["ids", "starts", "ends", "decoded"]
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held, first = 0, at
                while at < batch.num_rows and (held < BATCH_BYTES or at == first):
                    held += len(batch.column(0)[at].as_py() or b"")
                    at += 1
                part = batch.slice(first, at - first)
                coded = codec.encode([t.as_py() or b"" for t in part.column(0)])
                offsets = pa.array(np.cumsum([0, *(len(x[0]) for x in coded)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in coded]).astype(np.int32))) for k in range(3)]
                decoded = pa.array([x[3] for x in coded], pa.string())
                del coded  # a part's arrays go before the next part's are made
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *lists, decoded], names=[*part.schema.names[1:], *names])
                del lists, decoded
        pa.default_memory_pool().release_unused()  # a worker lives on for later stages

    return run


def encode(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns of every document, with ids, starts, ends (byte spans of the text) and decoded."""
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    given = docs.select(F.col("text").cast("binary").alias("text"), *keep)
    return given.mapInArrow(_encode_batches(model_path), f"{kept}, ids array<int>, starts array<int>, ends array<int>, decoded string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(coded: DataFrame, *keep: str) -> DataFrame:
    return coded.select(
        *(keep or ("doc_id",)), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), model_path()))
