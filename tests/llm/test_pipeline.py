"""Each stage of the pipeline on odd tables, and the chain on planted documents."""

import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
KIND = "doc_id long, text string, lang string, source string, n_chars long, K_ID string, pii_text string"
LANGS = {"en": "the water of this house was seen by many old people near that river and then they went home again".split(), "de": "das wasser von diesem haus wurde oft gesehen und viele alte leute gingen dann wieder nach hause zurück".split()}


def text(lang, seed, n=90):
    words = LANGS[lang]
    return " ".join(words[int(hashlib.md5(f"{lang}{seed}{i}".encode()).hexdigest(), 16) % len(words)] + ("" if i % 11 else f" x{seed}y{i}") for i in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    passage = " ".join(f"item{i}" for i in range(40))
    rows = [(i, text(["en", "de"][i % 2], i), ["en", "de"][i % 2], "s", 1, "k", "p") for i in range(40)]
    rows += [(100, rows[4][1], "en", "s", 1, "k", None), (101, rows[4][1] + " end", "en", None, None, None, "q"), (101, rows[4][1] + " end", "en", None, None, None, "q")]
    rows += [(102, None, "en", "s", 0, "k", "p"), (103, "", None, "s", 0, "k", "p"), (104, "12 34 !", "en", "s", 1, "k", "p"), (None, text("de", 77), "de", "s", 1, "k", "p")]
    rows += [(105, text("en", 105) + " " + passage, "en", "s", 1, "k", "p"), (106, text("en", 106) + " mail anna.bell@example.org now", "en", "s", 1, "k", "p"), (107, text("de", 107, 40_000), "de", "s", 1, "k", "p")]
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([("b1", passage), ("b2", None), (None, "")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_take_odd_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        last = i == len(corpus_pipeline.STAGES) - 1
        out = stage(spark, docs, folder)
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        if not last:
            assert [c.lower() for c in out.columns] == [c.lower() for c in docs.columns], name
            assert 0 < out.count() <= docs.count(), name


def test_chain(spark, folder):
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()]
    # rejected: no text or no letters; exact copies but for one; the benchmark's passage
    assert not {102, 103, 104, 105} & set(got)
    assert len({4, 100} & set(got)) == 1 and len(got) == len(set(got))
    assert {None, 106, 107} <= set(got) and set(range(40)) - {4} <= set(got)
