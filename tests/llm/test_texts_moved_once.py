"""Stage 2 of the pipeline moves the texts once, by the same plan at any size."""

from pairlytics.llm import simhash


def test_texts_moved_once(spark, tmp_path, monkeypatch):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(i, text(chr(97 + i % 20)), "x") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/d")
    plans, stored = [], simhash.stored
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(simhash, "stored", lambda df: plans.append(optimized(df)) or stored(df))
    out = simhash.drop_near_duplicates(spark.read.parquet(f"{tmp_path}/d"))
    plans.append(optimized(out))
    joined = [p for p in plans if "Join" in p and any("Relation" in line and "text#" in line for line in p.splitlines())]
    assert len(joined) == 1 and "strategy=broadcast" not in joined[0]
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(20))


def test_rows_alike_move_the_texts_once_too(spark, tmp_path):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(i, text(chr(97 + i)), s) for i in range(20) for s in "xyz"[: 2 if i % 2 else 1]]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/d")
    out = simhash.drop_near_duplicates(spark.read.parquet(f"{tmp_path}/d"))
    assert sorted((r["doc_id"], r["source"]) for r in out.collect()) == [(i, "x") for i in range(20)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("FileScan parquet" in line and "text#" in line for line in plan.splitlines()) == 1
