"""Operators against brute force, at sf0.001 and on odd texts."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
import xxhash

from pairlytics.llm import decontaminate, language_id, quality, queries, sentencepiece_codec, simhash, substring_dedup

WS = " \t\n\x0b\x0c\r"


def words(t):
    out, w = [], ""
    for c in t or "":
        if c in WS:
            out, w = (out + [w] if w else out), ""
        else:
            w += c
    return out + [w] if w else out


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(params=["docs", "odd"])
def given(request):
    return request.getfixturevalue(request.param)


def test_simhash(given):
    def fp(t):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    rows = [(i, fp(t)) for i, t in texts(given)]
    parent = {f: f for _, f in rows}
    low = {}
    for f in sorted(parent):
        for g in list(parent):
            if g < f and (f ^ g).bit_count() <= 3:
                a, b = f, g
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[a] = b

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, f in rows:
        r = root(f)
        low[r] = min(i, low.get(r, i))
    want = sorted((i, f"{f:016x}", low[root(f)]) for i, f in rows)
    out = simhash.near_duplicates(given)
    got = sorted((r["doc_id"], f"{r['fp'] & 0xFFFFFFFFFFFFFFFF:016x}", r["component_id"]) for r in out.collect())
    assert got == want


def test_substring(given):
    rows = texts(given)
    first = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 12):
            first[" ".join(w[p : p + 13])].add(i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - 12):
            if min(first[" ".join(w[p : p + 13])]) < i:
                gone.update(range(p, p + 13))
        want.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.deduplicate(given).collect()]
    assert sorted(got) == sorted(want)


def test_sentencepiece(given):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in texts(given):
        ids = sp.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    coded = sentencepiece_codec.encode(given, sentencepiece_codec.model_path())
    got = [tuple(r) for r in sentencepiece_codec.digests(coded).collect()]
    assert sorted(got) == sorted(want)


def test_quality_base(given):
    want = []
    for i, t in texts(given):
        t = t or ""
        w = words(t)
        grams = defaultdict(list)
        for p in range(len(w) - 7):
            grams[" ".join(w[p : p + 8])].append(p)
        hit = {q for ps in grams.values() if len(ps) > 1 for p in ps for q in range(p, p + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        bad = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), bad))
    out = quality.judge(given)
    got = [tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    assert sorted(got) == sorted(want)
    assert out.where("kept IS NULL OR (base_failed AND kept)").isEmpty()


def test_language(docs, odd):
    out = language_id.identify(docs, ("doc_id", "lang")).where("lang IS NOT NULL AND crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.9 * len(out)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4))
    assert all(0 <= s <= 1 for _, s in got.values())


def test_decontaminate_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({decontaminate.OP6_SQL})").fetchall())
    got = sorted(tuple(r) for r in decontaminate.op6_decontaminate(spark, sf).collect())
    assert got == want


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert language_id.identify(none).isEmpty() and quality.judge(none).isEmpty()
    assert simhash.near_duplicates(none).isEmpty() and substring_dedup.deduplicate(none).isEmpty()
    assert decontaminate.contamination(none, bench).isEmpty()
    assert decontaminate.contamination(odd, bench).where("contaminated").isEmpty()
    assert set(queries()) >= {"op1_language_id", "op8_simhash"}
