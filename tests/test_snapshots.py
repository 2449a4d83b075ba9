"""The upsert table: killed and restarted streams, refusals, repairs, stamps and torn pointers."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pairlytics.functions import names
from pairlytics.streaming import snapshots

SCHEMA = "id long, final boolean, at long, name string"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


@pytest.fixture
def store(spark, tmp_path):
    return snapshots.SnapshotTable(spark, f"file://{tmp_path}/t", SCHEMA, "id", "final", "at", 8)


def rows(store, version=None):
    return {r["id"]: (r["final"], r["at"], r["name"]) for r in store.read(version).collect()}


def test_final_wins_late_and_repeated(spark, store):
    a = spark.createDataFrame([(1, True, 5, "x"), (2, None, 5, "y"), (None, True, 1, "z"), (3, False, 1, None)], SCHEMA)
    b = spark.createDataFrame([(1, False, 9, "late"), (2, True, 1, "early final"), (3, False, 2, "later"), (3, False, 2, "latest")], SCHEMA)  # a tie: the greatest record
    assert store.read().isEmpty() and store.merge(a.limit(0))["rows"] == 0
    first = store.merge(a)
    second = store.merge(b)
    assert rows(store) == {1: (True, 5, "x"), 2: (True, 1, "early final"), 3: (False, 2, "latest")}
    assert rows(store, first["version"]) == {1: (True, 5, "x"), 2: (None, 5, "y"), 3: (False, 1, None)}
    for again in (a, b, b.limit(0)):
        assert store.merge(again) == second
    untouched = [k for k in first["buckets"] if k in second["buckets"] and first["buckets"][k]["print"] == second["buckets"][k]["print"]]
    assert all(first["buckets"][k]["path"] == second["buckets"][k]["path"] for k in untouched)


def test_refusal_keeps_the_good(spark, store):
    good = spark.createDataFrame([(i, i % 2 == 0, 1, "n") for i in range(20)], SCHEMA)
    before = store.replace(good)
    for worse in (good.where("id < 19"), good.withColumn("final", F.lit(False)), good.limit(0)):
        with pytest.raises(snapshots.Refused):
            store.replace(worse)
        assert store.pointer() == before and len(rows(store)) == 20
    assert store.replace(good.where("id < 19"), snapshots.at_least(0.9))["rows"] == 19


def test_repair_and_stamp_are_idempotent(spark, store):
    store.merge(spark.createDataFrame([(1, True, 1, "Ann Lee photo"), (2, True, 1, "Ann Lee"), (3, True, 1, None), (4, True, 1, "")], SCHEMA))

    def fix(df):
        clean = df.withColumn("name", names.without_media(F.col("name")))
        return clean.join(clean.groupBy("name").agg(F.min("id").alias("id")), "id", "left_semi")

    once = store.repair(fix, snapshots.at_least(0.5))
    assert once["action"] == "repair" and rows(store) == {1: (True, 1, "Ann Lee"), 3: (True, 1, None), 4: (True, 1, "")}
    assert store.repair(fix) == once
    stamped = store.stamp(checked=True, of=3)
    assert stamped["buckets"] == once["buckets"] and stamped["meta"] == {"checked": True, "of": 3} and store.stamp(of=3) == stamped
    assert [p["action"] for p in store.history()] == ["merge", "repair", "stamp"]


def test_torn_pointer_and_vacuum(spark, store, tmp_path):
    a = store.merge(spark.createDataFrame([(1, True, 1, "a")], SCHEMA))
    (tmp_path / "t/pointers/000000000002.json").write_text('{"version": 2, "bu')
    assert store.pointer() == a
    b = store.merge(spark.createDataFrame([(2, True, 1, "b")], SCHEMA))
    assert b["version"] == 3 and len(rows(store)) == 2
    store.merge(spark.createDataFrame([(1, True, 2, "c")], SCHEMA))
    (tmp_path / "t/data/left_by_a_crash").mkdir()
    assert store.vacuum(1) >= 2 and rows(store) == {1: (True, 2, "c"), 2: (True, 1, "b")} and store.vacuum(1) == 0
    with pytest.raises(ValueError):
        store.read(1)


def test_stream_killed_before_and_after_the_pointer(spark, store, tmp_path, monkeypatch):
    src, publish = tmp_path / "in", snapshots.SnapshotTable._publish
    batches = [[(1, False, 1, "a"), (2, True, 1, "b")], [(1, True, 2, "c"), (2, False, 2, "d"), (3, False, 2, "e")], [(1, False, 3, "f"), (3, False, 3, "g")]]

    def run():
        q = snapshots.upsert(spark.readStream.schema(SCHEMA).json(str(src / "*")), store, f"file://{tmp_path}/cp")
        try:
            assert q.awaitTermination(90)
        except StreamingQueryException as e:
            return e
        return None

    def before(self, *a):
        raise RuntimeError("killed before the pointer")

    def after(self, *a):
        publish(self, *a)
        raise RuntimeError("killed after the pointer")

    for i, (batch, kill) in enumerate(zip(batches, (before, after, None), strict=True)):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.json(str(src / f"b{i}"))
        seen = store.pointer()
        if kill is not None:
            monkeypatch.setattr(snapshots.SnapshotTable, "_publish", kill)
            assert "killed" in str(run())
            assert (store.pointer() == seen) == (kill is before)
            monkeypatch.setattr(snapshots.SnapshotTable, "_publish", publish)
        versions = len(store.history())
        assert run() is None
        assert len(store.history()) == versions + (kill is not after)
    assert rows(store) == {1: (True, 2, "c"), 2: (True, 1, "b"), 3: (False, 3, "g")}
