"""The alignment against a plain restatement with the libraries, long and odd texts included."""

import hashlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest

from pairlytics.llm import token_alignment as A


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = A.paths()
    t, s = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    t.encode_special_tokens = True
    letters = A.byte_alphabet()

    def tokens(text):
        """(ids, byte ends) of both sides, or None."""
        if not text:
            return None
        a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
        at = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        bt = [bytes([int(p[3:-1], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [s.id_to_piece(i)]]
        if b"".join(at) != (" " + text).encode() or b"".join(bt) != (" " + text).encode():
            return None
        return [(i, np.cumsum([len(x) for x in y]).tolist()) for i, y in ((a, at), (b, bt))]

    def groups(text):
        both = tokens(text)
        if both is None:
            return []
        ends, out = sorted(set(both[0][1]) & set(both[1][1])), []
        for lo, hi in zip([0, *ends], ends):
            out.append((lo, hi, *[x[bisect_right(e, lo) : bisect_right(e, hi)] for x, e in both]))
        return out

    return groups


def whole(rows, groups):
    """Expected rows of (doc_id, text)."""
    found = [(i, groups(t)) for i, t in rows]
    links = [[(x, y) for _, _, p, q in g for x in p for y in q] for _, g in found]
    count = Counter(p for ls in links for p in set(ls))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (i, g), ls in zip(found, links):
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for _, _, p, q in g)
        out.append((i, sum(len(p) for *_, p, _ in g), sum(len(q) for *_, q in g), len(g), len(ls), sum(count[p] == top[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "12 34 !"), (5, "same words here again"), (6, "same words here again"), (6, "same words here again"), (6, "other text of the same id"),
       (8, "é ü ñ 漢字 emoji 🙂🙂 tail"), (9, "a ▁mark is not a space"), (10, "<|endoftext|> and </s><s> <unk> <0x41>"), (None, "no id here"), (11, "don't  stop'll \r\n\n\n x"), (12, "\x00 nul \x1c sep   nbsp  "), (13, " leading")]


def test_odd_texts(spark, plain):
    df = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, N_A string").repartition(3)
    got = A.alignments(df, *A.paths())
    assert sorted(map(tuple, got.collect()), key=str) == whole(ODD, plain)
    empty = df.limit(0)
    assert A.alignments(empty, *A.paths()).count() == 0 and A.groups(empty, *A.paths()).count() == 0


def test_given_documents(spark, docs, plain):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, A.alignments(docs, *A.paths()).collect()), key=str) == whole(rows, plain)


def test_long_texts_are_swept_in_parts(spark, docs, plain, monkeypatch):
    monkeypatch.setattr(A, "RUN", 7)
    monkeypatch.setattr(A, "SWEPT", 20)
    monkeypatch.setattr(A, "ENTRIES", 50)
    monkeypatch.setattr(A, "EXPANDED", 5)
    rows = [*ODD, *[tuple(r) for r in docs.select("doc_id", "text").where("length(text) < 3000").limit(40).collect()], (99, "hot words of one text " * 300), (99, "hot words of one text " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, A.alignments(df, *A.paths()).collect()), key=str) == whole(rows, plain)
    got = [(r["doc_id"], r["grp"], r["start"], r["stop"], list(r["a_ids"]), list(r["b_ids"])) for r in A.groups(df, *A.paths()).collect()]
    want = [(i, k, max(lo - 1, 0), hi - 1, p, q) for i, t in rows for k, (lo, hi, p, q) in enumerate(plain(t))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_very_long_runs_take_the_whole_encoder(spark, plain):
    rows = [(1, "a" * 60_000), (2, " " * 60_000 + "b"), (3, "x" + "\n" * 55_000)]
    got = A.alignments(spark.createDataFrame(rows, "doc_id string, text string"), *A.paths())
    assert sorted(map(tuple, got.collect()), key=str) == whole([(str(i), t) for i, t in rows], plain)


def test_invalid_utf8_has_no_tokens(spark):
    df = spark.sql("SELECT 1 AS doc_id, cast(unhex('61ff62') AS string) AS text UNION ALL SELECT 2, 'fine'")
    got = {r["doc_id"]: r["n_a"] for r in A.alignments(df, *A.paths()).collect()}
    assert got == {1: 0, 2: 1}
