"""Exact products, clustering and top-k search against plain Python, with odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlytics.llm import centroid_clustering as C
from pairlytics.llm import exact_topk as T
from pairlytics.llm import vectors as V


def floors(x):
    return [math.floor(1024 * v) for v in x]


@pytest.mark.parametrize("top", [100, 2**28, 2**40, 2**80])
def test_products_are_exact_at_any_magnitude(top):
    r = random.Random(1)
    x, y = ([[r.randint(-top, top) for _ in range(9)] for _ in range(n)] for n in (5, 4))
    x[2] = [v % 7 for v in x[2]]  # a small row beside large ones
    kind = np.int64 if top < 2**62 else object
    a, b = np.array(x, kind), np.array(y, kind)
    got = V.products(a, b)
    assert [[int(v) for v in row] for row in got] == [[sum(p * q for p, q in zip(m, n)) for n in y] for m in x]
    dist = np.zeros((5, 4), object)
    for at, d in V.squared_distances(a, b):
        dist[at] = V.whole(d)
    assert dist.tolist() == [[sum((p - q) ** 2 for p, q in zip(m, n)) for n in y] for m in x]


def made(spark, n=60, width=4, seed=2):
    r = random.Random(seed)
    rows = [(i, [r.uniform(-2, 2) for _ in range(width)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(30)]  # a common vector
    odd = [(500, None), (501, [1.0, None, 2.0, 0.0]), (502, [float("nan")] * width), (503, [float("inf"), 0.0, 0.0, 0.0]), (3, rows[3][1])]
    return rows, spark.createDataFrame([(i, x, "x") for i, x in rows + odd], "vec_id long, embedding array<double>, DISTANCE string")


def test_clusters_equal_plain_rounds(spark):
    rows, df = made(spark)
    rows = rows + [rows[3]]
    start = sorted(rows, key=lambda v: (hashlib.sha256(f"3:{v[0]}".encode()).hexdigest(), v[1]))[:3]
    c, q = [floors(x) for _, x in start], [(i, floors(x)) for i, x in rows]
    near = lambda x: min(range(3), key=lambda j: (sum((a - b) ** 2 for a, b in zip(x, c[j])), j))
    for _ in range(10):
        parts = [[x for _, x in q if near(x) == j] for j in range(3)]
        c = [[sum(v) // len(p) for v in zip(*p)] if p else c[j] for j, p in enumerate(parts)]
    want = sorted((i, near(x), sum((a - b) ** 2 for a, b in zip(x, c[near(x)]))) for i, x in q)
    got = C.clusters(df.repartition(3), k=3, width=4).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == want
    assert {r["inertia"] for r in got} == {sum(w[2] for w in want)}
    assert {(r["cluster"], r["centroid"]) for r in got} == {(j, ",".join(map(str, c[j]))) for j in {w[1] for w in want}}


def test_clusters_beyond_doubles_and_longs(spark):
    big = [(1, [1e9, -1e9]), (2, [1e9 + 1, 5.0]), (3, [1e300, 0.0]), (4, [3e305, 1.0]), (None, [0.0, 0.0])]
    got = {r["vec_id"]: r for r in C.clusters(spark.createDataFrame(big, "vec_id long, embedding array<double>"), k=2, width=2).collect()}
    assert set(got) == {1, 2, 3, None}  # 1024 times the fourth isn't finite
    assert got[1]["inertia"] is None or got[1]["inertia"] >= 0
    assert C.clusters(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def best(rows, i, x, top):
    q = floors(x)
    scores = [(sum(a * b for a, b in zip(q, floors(y))), j) for j, y in rows if j != i]
    return [(i, k + 1, j, s) for k, (s, j) in enumerate(sorted(scores, key=lambda v: (-v[0], v[1]))[:top])]


@pytest.mark.parametrize("pivots,group,task", [(64, 8192, 8192), (5, 4, 10), (25, 3, 1000)])
def test_topk_equals_all_pairs(spark, pivots, group, task):
    rows, df = made(spark)
    rows = rows + [rows[3]]
    got = T.topk(df.repartition(4), F.col("vec_id") % 4 == 3, top=6, pivots=pivots, group_queries=group, task_rows=task).collect()
    want = [w for i, x in rows if i % 4 == 3 for w in best(rows, i, x, 6)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_leaves_out_what_cannot_matter(spark):
    r = random.Random(5)
    rows = [(i, [g * 10 + r.random(), 10 - g * 10 + r.random()]) for i in range(400) for g in [i % 2]]
    got = T.topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, top=3, pivots=40)
    rows = [(i, [float(np.float32(v)) for v in x]) for i, x in rows]
    assert sorted(map(tuple, got.collect())) == sorted(w for i, x in rows if i % 50 == 0 for w in best(rows, i, x, 3))
    p = np.array([floors(x) for _, x in rows[:40]])
    least = T.least_distances(p, {0: 10.0}, {0: 9e7})
    assert min(least.values()) == -math.inf or max(least.values()) > 0


def test_topk_lengths_ids_and_magnitudes(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0]), (2, []), (None, [9.0, 9.0]), (3, [-1e150, 0.0]), (4, [1e8, 1e8])]
    got = [tuple(r) for r in T.topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, top=10).collect()]
    # of two scores the larger first, a row without id after others; the last is beyond 64 bits
    assert [g[2] for g in sorted(got)] == [4, None, 1, 2, 3] and sorted(got)[-1][3] is None
    assert T.topk(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0
    one = T.topk(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), F.lit(True))
    assert one.count() == 0
