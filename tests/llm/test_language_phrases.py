"""Phrase counts against brute force, every label learned, whole texts, memory of the table."""

import random

from pyspark.sql import functions as F

from pairlytics.llm import language_id


def brute(text, sample):
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        n, at = n + 1, end
    return n


def test_phrases():
    rng = random.Random(3)
    samples = [("aa", "".join(rng.choices("abc \n", k=700))), ("bb", "".join(rng.choices("abdé漢", k=500))), ("cc", "x")]
    texts = ["", "a", "zzz", "zazbz", "x", "xx"] + ["".join(rng.choices("abcdé漢xz", k=rng.randint(1, 90))) for _ in range(120)] + ["".join(rng.choices("abc", k=3000))]
    model = language_id.Model(samples)
    want = [[brute(t, s) for _, s in samples] for t in texts]
    coded = lambda ts: [model.classes[[ord(c) for c in t]] if t else model.classes[:0] for t in ts]
    assert model.phrases(coded(texts)).tolist() == want
    for t, w in zip(texts, want, strict=True):  # one by one, without NumPy's steps
        assert model.phrases(coded([t])).tolist() == [w]


def test_every_label_is_learned_from_whole_texts(spark):
    rows = [(i * 3, f"l{i:03}", f"text of language {i} " * 3) for i in range(150)] + [(1001 + i, "l000", "") for i in range(5)]
    rows += [(5000 + i, "long", "y" * 70_000 + "end of it") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = dict(language_id.sample(df))
    labelled = df.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1) & (F.col("text") != ""))
    assert set(got) == {r["lang"] for r in labelled.select("lang").distinct().collect()} and len(got) > 64
    assert got["long"] == "y" * 70_000 + "end of it"
    assert len(language_id.sample(df.limit(0))) == 0


def test_table_is_sparse():
    rng = random.Random(1)
    wide = [chr(0x4E00 + i) for i in range(5000)]
    model = language_id.Model([("zh", "".join(rng.choices(wide, k=20_000))), ("en", "".join(rng.choices("abcdefgh ", k=20_000)))])
    assert model.table.nbytes < 8 << 20
