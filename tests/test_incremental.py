"""What a second metric adds, against NumPy; merged boards; the log as a stream."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pairlytics.operators import leaderboards, logs, models


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def weights(x, y):
    x, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + 1e-3 * np.eye(len(w)), x.T @ (p - y) / len(x) + 1e-3 * w)
    return w


def pair_auc(s, y):
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / (len(a) * len(b))


def test_incremental_auc(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 2)) * [2, 5] + [1, -3]
    y = (rng.random(160) < 1 / (1 + np.exp(-(x[:, 0] - 1) - 0.3 * (x[:, 1] + 3)))).astype(int)
    df = spark.createDataFrame([(int(i), float(a), float(b), int(c)) for i, (a, b), c in zip(range(-100, 60), x, y, strict=True)], "i long, a double, b double, y int")
    got = models.incremental_auc(df.where("i < 0"), df.where("i >= 0"), ["a"], "b", "y", "i", 20).collect()
    z = (x - x[:100].mean(0)) / x[:100].std(0)
    s = [np.round(np.c_[np.ones(60), z[100:, :k]] @ weights(z[:100, :k], y[:100]), 10) for k in (1, 2)]
    t = y[100:]
    gains = []
    for rep in range(1, 21):
        at = np.array([int(hashlib.md5(f"{rep}|{i}".encode()).hexdigest()[:8], 16) % 60 for i in range(60)])
        gains.append(pair_auc(s[1][at], t[at]) - pair_auc(s[0][at], t[at]))
    gains.sort()
    want = (60, pair_auc(s[0], t), pair_auc(s[1], t), pair_auc(s[1], t) - pair_auc(s[0], t), gains[0], gains[int(0.975 * 20) - 1])
    assert len(got) == 1 and np.allclose(tuple(got[0]), want, atol=1e-9)


def test_boards(spark):
    a = spark.createDataFrame([("x", 1, 5, 2), ("x", 2, None, 3), ("y", 1, 7, 1), (None, 1, 9, 9)], "k string, page int, kills int, sets int")
    b = spark.createDataFrame([("x", 3, 4, 3), ("z", 1, None, None)], "k string, page int, digs int, sets int")
    got = {r["k"]: (r["kills"], r["digs"], r["sets"], r["conflicts"]) for r in leaderboards.merged([a, b], "k", "page").collect()}
    assert got == {"x": (5, 4, 3, ["sets"]), "y": (7, None, 1, []), "z": (None, None, None, [])}
    assert leaderboards.merged([a.limit(0), b.limit(0)], "k", "page").isEmpty()


def test_final_wins_on_a_stream(spark, tmp_path):
    schema, out = "id long, final boolean, at long, points int", []
    src = tmp_path / "in"
    batches = [[(1, False, 1, 10), (2, True, 1, 20)], [(1, True, 2, 11), (2, False, 2, 99), (3, False, 2, 5)], [(1, False, 3, 77), (3, False, 3, 6)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(src / f"b{i}"))
        log = spark.readStream.schema(schema).json(str(src / "*"))
        best = logs.dedupe_final_wins(log, "id", F.col("final"), "at")
        keep = lambda df, _: out.append({r["id"]: r["points"] for r in df.collect()})
        q = best.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None
    assert out[0] == {1: 10, 2: 20} and out[-1] == {1: 11, 2: 20, 3: 6}
