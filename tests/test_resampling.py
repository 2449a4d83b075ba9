"""Areas by replicate and shuffles against plain loops, with ranges and digits forced to be small."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import SparkSession

from pairlytics.operators import digests, models


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("size", [200_000, 7])
def test_auc_of_resamples(spark, size, monkeypatch):
    monkeypatch.setattr(models, "RANGE_SCORES", size)
    r = random.Random(1)
    rows = [(i, r.choice([-1.5, 0.0, 0.25, 0.5, 3.0, r.random()]), r.randrange(2)) for i in range(50)]
    df = spark.createDataFrame(rows, "i long, score double, y int").repartition(4)
    got = {x["rep"]: x["auc"] for x in models.auc_by(models.resampled(df, "i", 12), "rep", "score", "y", df).collect()}
    assert len(got) == 12
    for rep, auc in got.items():
        drawn = [rows[int(md5(f"{rep}|{i}")[:8], 16) % 50] for i in range(50)]
        a, b = [s for _, s, y in drawn if y], [s for _, s, y in drawn if not y]
        assert abs(auc - sum((x > y) + (x == y) / 2 for x in a for y in b) / len(a) / len(b)) < 1e-12
    one = models.auc_by(df.where("y = 1").selectExpr("1 AS rep", "*"), "rep", "score", "y", df).collect()
    assert [x["auc"] for x in one] == [None]


@pytest.mark.parametrize("n,ones,big", [(40, 13, 10_000), (40, 13, 0.001), (3, 1, 10_000)])
def test_permutation(spark, n, ones, big, monkeypatch):
    monkeypatch.setattr(models, "SORTED_ROWS", big)
    r = random.Random(2)
    rows = [(i, i < ones, r.choice([0.0, 0.5, r.random()])) for i in range(n)] + [(100, None, 5.0)]
    df = spark.createDataFrame(rows, "k long, up boolean, x double").repartition(3)
    got = models.permutation_gap(df, "k", "up", "x", 60).first()
    mean = lambda v: sum(v) / len(v)
    real = mean([x for _, u, x in rows if u]) - mean([x for _, u, x in rows if u is False])
    hits = 0
    for t in range(1, 61):
        order = [x for _, x in sorted((md5(f"{t}|{k}"), x) for k, u, x in rows if u is not None)]
        hits += round(abs(mean(order[:ones]) - mean(order[ones:])), 12) >= round(abs(real), 12)
    assert abs(got["gap"] - real) < 1e-12 and got["p"] == (hits + 1) / 61
    assert tuple(models.permutation_gap(df.where("up"), "k", "up", "x", 5).first()) == (None, None)


def test_digests_equal_the_library():
    texts = [b"%d" % i for i in (0, 7, 12345, 10**18)] + [b"", b"x" * 49, b"y" * 50, b"z" * 200]
    for prefix in (b"1|", b"12345|"):
        words = digests.Keys(texts).words(prefix)
        assert [words[:, i].astype(">u4").tobytes() for i in range(len(texts))] == [hashlib.md5(prefix + t).digest() for t in texts]


@pytest.mark.parametrize("places", [1 << 15, 16])
def test_packed_resamples(spark, places, monkeypatch):
    monkeypatch.setattr(models, "PLACES", places)
    r = random.Random(5)
    rows = [(i, r.choice([-1.5, 0.0, 0.25, 0.5, r.random()]), r.choice([0.0, 1.0]), r.randrange(2)) for i in range(70)]
    df = spark.createDataFrame(rows, "i long, u double, v double, y int").repartition(4)
    got = {x["rep"]: x for x in models.resampled_aucs(df, "i", ["u", "v"], "y", 9).collect()}
    assert set(got) == set(range(10))
    for rep, x in got.items():
        drawn = rows if rep == 0 else [rows[int(md5(f"{rep}|{i}")[:8], 16) % 70] for i in range(70)]
        for k, name in ((1, "u"), (2, "v")):
            a, b = [t[k] for t in drawn if t[3]], [t[k] for t in drawn if not t[3]]
            assert abs(x[f"auc_{name}"] - sum((s > t) + (s == t) / 2 for s in a for t in b) / len(a) / len(b)) < 1e-12
    assert [x["auc_u"] for x in models.resampled_aucs(spark.createDataFrame([(0, 1.0, 1)], "i long, u double, y int"), "i", ["u"], "y", 2).collect()] == [None] * 3
    assert models.resampled_aucs(df.limit(0), "i", ["u"], "y", 2).isEmpty()


def test_shuffles_whose_group_ends_far_from_its_share(spark, monkeypatch):
    monkeypatch.setattr(models, "DEVIATIONS", 0.5)  # most trials are then sorted over the whole range
    rows = [(f"team {'x' * i}", i % 3 == 0, float(i % 7)) for i in range(60)]
    got = models.permutation_gap(spark.createDataFrame(rows, "k string, up boolean, x double").repartition(3), "k", "up", "x", 40).first()
    real, hits = np.mean([x for _, u, x in rows if u]) - np.mean([x for _, u, x in rows if not u]), 0
    for t in range(1, 41):
        order = [x for _, x in sorted((md5(f"{t}|{k}"), x) for k, _, x in rows)]
        hits += round(abs(np.mean(order[:20]) - np.mean(order[20:])), 12) >= round(abs(real), 12)
    assert abs(got["gap"] - real) < 1e-12 and got["p"] == (hits + 1) / 41
