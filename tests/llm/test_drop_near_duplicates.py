"""Which rows stage 2 of the pipeline keeps where ids are null or shared."""

from pairlytics.llm import simhash


def test_ids_null_or_shared(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(1, text("a"), "x"), (2, text("a"), "y"), (2, text("b"), "z"), (None, text("c"), "n"), (None, text("c"), "m"), (None, text("d"), "o"), (None, text("a"), "p"), (3, text("e"), "q"), (3, text("e"), "p"), (4, None, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Source string")
    want = [(1, "a0", "x"), (2, "b0", "z"), (3, "e0", "p"), (4, None, "r"), (None, "c0", "m"), (None, "d0", "o")]
    out = simhash.drop_near_duplicates(df)
    got = [(r["doc_id"], r["text"] and r["text"].split()[0], r["Source"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and out.columns == df.columns
    assert simhash.drop_near_duplicates(df.limit(0)).isEmpty()
