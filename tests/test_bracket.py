"""Propagation over made brackets against a plain recursion."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import SparkSession

from pairlytics.operators import bracket


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def set_win(p, target):
    """By the race itself: points of both sides until the target, two ahead."""
    q, at, won = 1 - p, {(0, 0): 1.0}, 0.0
    for _ in range(4000):
        after = {}
        for (a, b), v in at.items():
            for x, y, w in ((a + 1, b, p), (a, b + 1, q)):
                if max(x, y) >= target and abs(x - y) >= 2:
                    won += v * w if x > y else 0.0
                else:
                    after[x, y] = after.get((x, y), 0.0) + v * w
        at = {k: v for k, v in after.items() if v > 1e-14}
        if not at:
            return won
    return won


def match_win(margin):
    r = min(0.9, max(0.1, 0.5 + margin / (2 * 43.44)))
    s, last = set_win(r, 25), set_win(r, 15)
    q = 1 - s
    return s**3 * (1 + 3 * q) + 6 * s * s * q * q * last


def plain(games, strength, half):
    played, rounds = {}, {}
    for g in sorted(games, key=lambda g: (g[1] or date(1900, 1, 1), g[0])):
        r = max(played.get(t, 0) for t in g[2:4])
        rounds.setdefault(r, []).append(g)
        for t in g[2:4]:
            played[t] = played.get(t, 0) + 1

    def feeder(r, team):
        for k in range(r - 1, -1, -1):
            for g in rounds.get(k, []):
                if g[4] == team:
                    return k, g
        return None

    def p(a, b, home=None):
        if a not in strength or b not in strength:
            return 0.5
        return match_win(strength[a] - strength[b] + (2 * half if home == a else -2 * half if home == b else 0))

    def dist(r, g):
        fed = [feeder(r, t) for t in g[2:4]]
        if r == 0 or None in fed:
            x = p(g[2], g[3], g[5])
            return {g[2]: x, g[3]: 1 - x}
        left, right = (dist(*f) for f in fed)
        out = {}
        for a, pa in left.items():
            for b, pb in right.items():
                out[a] = out.get(a, 0) + pa * pb * p(a, b)
                out[b] = out.get(b, 0) + pa * pb * (1 - p(a, b))
        return out

    top = max(rounds)
    return {g[0]: r for r, gs in rounds.items() for g in gs}, dist(top, rounds[top][0]), rounds[top][0][4]


def season(kind):
    r, day = random.Random(3), date(2020, 1, 1)
    if kind == "clean":  # eight teams, and both first rounds on the same days
        games, alive, gid = [], list(range(8)), 0
        while len(alive) > 1:
            after = []
            for a, b in zip(alive[::2], alive[1::2]):
                w = r.choice([a, b])
                games.append((gid, day + timedelta(gid // 3), a, b, w, r.choice([a, b])))
                after.append(w)
                gid += 1
            alive = after
        return games
    games = []
    for gid in range(28):
        a, b = r.sample(range(11), 2)
        games.append((gid, None if gid % 9 == 4 else day + timedelta(r.randrange(9)), a, b, r.choice([a, b]), r.choice([a, b])))
    return games


@pytest.mark.parametrize("kind", ["clean", "irregular"])
def test_propagation(spark, kind):
    games = season(kind)
    strength = {t: (t * 7 % 5) * 1.5 - 2 for t in range(11) if t != 6}
    rounds, want, champion = plain(games, strength, 0.4)
    tree = bracket.nodes(spark.createDataFrame(games, "gid long, date date, team_a long, team_b long, winner long, home long").repartition(3))
    assert {x["gid"]: x["round"] for x in tree.collect()} == rounds
    s = spark.createDataFrame(list(strength.items()), "team long, margin double")
    titles = bracket.title(tree, s, 0.4)
    got = {x["team"]: x["p"] for x in titles.collect()}
    assert set(got) == set(want) and max(abs(got[t] - want[t]) for t in want) < 1e-9
    c = bracket.champion(tree, titles).first()
    assert c["champion"] == champion and c["adds_up"] and c["teams"] == len(want) and abs(c["p"] - want[champion]) < 1e-9
    assert c["rank"] == 1 + sum(round(v, 12) > round(want[champion], 12) or (round(v, 12) == round(want[champion], 12) and t < champion) for t, v in want.items())


def test_no_games(spark):
    tree = bracket.nodes(spark.createDataFrame([], "gid long, date date, team_a long, team_b long, winner long, home long"))
    assert bracket.title(tree, spark.createDataFrame([], "team long, margin double"), 0.4).isEmpty()
