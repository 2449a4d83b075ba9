"""The sparse solve against a dense one, and the twelve measures against a plain restatement."""

import random

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pairlytics.operators import adjustment, lineage, metrics
from pairlytics.queries import evaluation
from pairlytics.queries.records import match_sides

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def dense(rows):
    """{team: (off, def, n)} of (team, opp, home, y), by the solution of least norm, centred."""
    rows = [r for r in rows if r[3] is not None]
    teams = sorted({r[0] for r in rows} | {r[1] for r in rows})
    at, t = {x: i for i, x in enumerate(teams)}, len(teams)
    a = np.zeros((len(rows), 2 * t + 2))
    for k, (i, j, home, _) in enumerate(rows):
        a[k, at[i]], a[k, t + at[j]], a[k, -2], a[k, -1] = 1, -1, 1, 1 if home else -1
    x = np.linalg.lstsq(a, np.array([float(r[3]) for r in rows]), rcond=1e-12)[0]
    off, dfn = x[:t] - x[:t].mean(), x[t : 2 * t] - x[t : 2 * t].mean()
    return {k: (off[i], dfn[i], sum(r[0] == k for r in rows)) for k, i in at.items()}


def test_made_table_with_gaps_and_parts_that_never_meet(spark):
    r = random.Random(7)
    rows = []
    for _ in range(150):
        i, j = r.sample(range(12), 2) if r.random() < 0.8 else r.sample(range(20, 24), 2)
        home = r.random() < 0.5
        for a, b, h in ((i, j, home), (j, i, not home)):
            rows.append((a, b, h, r.choice([None, r.uniform(0, 30)]), r.uniform(-1, 1) if a % 2 else None))
    rows.append((99, 1, True, None, None))  # no observation at all
    df = spark.createDataFrame(rows, "team long, opp long, home boolean, u double, v double").repartition(3)
    got = {x["team"]: x for x in adjustment.solve(df, ["u", "v"]).collect()}
    for k, m in ((3, "u"), (4, "v")):
        want = dense([(*x[:3], x[k]) for x in rows])
        for team, (off, dfn, n) in want.items():
            g = got[team]
            assert abs(g[f"{m}_off"] - off) < 1e-8 and abs(g[f"{m}_def"] - dfn) < 1e-8 and g[f"{m}_n"] == n
    assert got[99]["u_off"] is None and adjustment.solve(df.limit(0), ["u"]).isEmpty()


def test_given_games_equal_a_dense_solve(spark):
    rows = [tuple(x) for x in match_sides(spark, SF).select("team", "opp", "home", "pf").collect()]
    want = dense(rows)
    got = {x["team"]: x for x in evaluation.opponent_adjusted(spark, SF).collect()}
    assert set(got) == set(want)
    assert max(abs(got[k]["adjusted"] - v[0] - v[1]) for k, v in want.items()) < 1e-6 and all(got[k]["games"] == v[2] for k, v in want.items())


def test_measures(spark):
    sides = [(1, "a", "b", 75.0, 60.0, 1, True, 3), (1, "b", "a", 60.0, 75.0, 0, False, 3), (2, "c", "a", 90.0, 80.0, 1, True, 4), (2, "a", "c", 80.0, 90.0, 0, False, 4), (3, "b", "c", 50.0, 40.0, 1, False, 0), (3, "c", "b", 40.0, 50.0, 0, True, 0)]
    boxes = [(1, "a", 10.0, 2.0, 40.0, 3.0, 30.0), (1, "b", 8.0, 4.0, 0.0, 1.0, 0.0), (2, "a", 9.0, 9.0, 9.0, 9.0, 9.0), (3, "b", 1.0, 0.0, 4.0, 0.0, 4.0), (3, "c", 2.0, 1.0, 5.0, 1.0, 5.0)]
    s = spark.createDataFrame(sides, "gid long, team string, opp string, pf double, pa double, won int, home boolean, sets long")
    b = spark.createDataFrame(boxes, "gid long, team string, " + ", ".join(f"{c} double" for c in metrics.BOX))
    e = spark.createDataFrame([("a", "b", 1), ("c", "a", 2), ("b", "c", 3)], "winner string, loser string, gid long")
    got = {x["team"]: x for x in metrics.build(s, b, e).collect()}
    # the second match counts no box: only one side has one; b's first has no attempts, but counts in sums
    assert got["a"]["own_hit_eff"] == 8 / 40 and got["a"]["opp_hit_eff"] is None and got["a"]["hit_eff_diff"] is None and got["a"]["net_points_set"] == 5 / 7
    assert got["b"]["own_hit_eff"] == 5 / 4 and got["b"]["sideout_proxy"] == 1 - 1 / 4 and got["b"]["opp_hit_eff"] == -(9 / 45)
    assert got["c"]["net_points_set"] == 0.0 and got["c"]["win_pct"] == 0.5
    o = metrics.observations(metrics.with_boxes(s, b)).collect()
    for k, m in ((3, "pts"), (4, "hit"), (5, "rec")):
        want = dense([(x[0], x[1], x[2], x[k]) for x in o])
        col = {"pts": lambda w: w[0] + w[1], "hit": lambda w: w[0] + w[1], "rec": lambda w: w[0]}[m]
        name = {"pts": "adj_net_points_set", "hit": "adj_hit_eff_diff", "rec": "adj_sideout_proxy"}[m]
        for team, w in want.items():
            assert abs(got[team][name] - col(w)) < 1e-8


def test_many_blocks_and_no_table_left_of_each_round(spark, monkeypatch):
    monkeypatch.setattr(adjustment, "BLOCK_PAIRS", 12)
    r = random.Random(3)
    rows = [(*(f"t{x}" for x in r.sample(range(9), 2)), r.random() < 0.5, r.uniform(0, 9)) for _ in range(40)]
    df = spark.createDataFrame([*rows, (None, "t1", True, 1.0)], "team string, opp string, home boolean, u double")
    before = len(lineage._written)
    got = {x["team"]: x for x in adjustment.solve(df, ["u"]).collect()}
    assert len(lineage._written) - before <= 4
    for team, (off, dfn, n) in dense(rows).items():
        assert abs(got[team]["u_off"] - off) < 1e-8 and abs(got[team]["u_def"] - dfn) < 1e-8 and got[team]["u_n"] == n
