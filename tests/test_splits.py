"""The split runner against a loop over splits, with null dates, teams without fitting matches and small splits."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pairlytics.operators import metrics, splits

SCHEMA = "gid long, team_a long, team_b long, points_a double, points_b double, sets long, winner int, date date, championship boolean"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def test_against_a_loop(spark):
    rng, rows = np.random.default_rng(5), []
    for gid in range(80):
        a, b = sorted(int(x) for x in rng.choice(9 if gid < 70 else 11, 2, replace=False))  # two teams come late
        x, y = (float(v) for v in rng.choice(np.arange(10, 40), 2, replace=False))
        day = None if gid % 19 == 0 else date(2020, 1 + gid // 10, 1)
        rows.append((gid, a, b, x, y, 3 + gid % 3, int(y > x), day, None if gid % 23 == 0 else gid % 4 == 0))
    m = spark.createDataFrame(rows, SCHEMA)
    boxes = spark.createDataFrame([(g, t, 10.0 + (g * t) % 7, 3.0, 30.0, 1.0, 30.0) for g, a, b, *_ in rows if g % 3 for t in (a, b)], "gid long, team long, kills double, errors double, attempts double, reception_errors double, reception_attempts double")
    cuts = ["2020-04-01", "2020-09-01"]
    got = {(r["split"], r["metric"]): r for r in splits.standalone(m, boxes, cuts, 10, 5).collect()}
    for split, test in [("tournament", lambda r: bool(r[8])), (cuts[0], lambda r: r[7] and r[7] >= date(2020, 4, 1))]:
        fit = [r for r in rows if test(r) is False]
        won = {}
        for r in fit:
            for t, w in ((r[1], 1 - r[6]), (r[2], r[6])):
                won.setdefault(t, []).append(w)
        pct = {t: sum(w) / len(w) for t, w in won.items()}
        pairs = [(round(pct[r[1]] - pct[r[2]], 10), 1 - r[6]) for r in rows if test(r) and r[1] in pct and r[2] in pct]
        s, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        pos, neg = s[y == 1][:, None], s[y == 0]
        one = got[split, "win_pct"]
        assert (one["n_fit"], one["n"]) == (len(fit), len(pairs))
        assert np.isclose(one["auc"], ((pos > neg).sum() + (pos == neg).sum() / 2) / (len(pos) * len(neg))) and np.isclose(one["accuracy"], ((s > 0) == (y == 1)).mean())
    assert not any(k[0] == cuts[1] for k in got)  # no match after it
    small = splits.standalone(m, boxes, cuts, 40, 5).where(F.col("split") == cuts[0]).collect()
    assert len(small) == len(metrics.RAW) and all(r["auc"] is None and r["accuracy"] is None and r["n"] > 0 for r in small)
    empty = splits.standalone(m.limit(0), boxes.limit(0), cuts, 0, 0)
    assert empty.isEmpty() and splits.stability(empty, cuts[0]).isEmpty()


def test_ranks_with_ties_and_nulls(spark):
    rows = [("x", "a", 0.6), ("x", "b", 0.6), ("x", "c", None), ("y", "a", 0.5), ("y", "b", 0.9), ("y", "c", 0.7)]
    out = splits.stability(spark.createDataFrame(rows, "split string, metric string, auc double"), "x")
    got = {(r["split"], r["metric"]): (r["rank"], r["shift"]) for r in out.collect()}
    assert got == {("x", "a"): (1, 0), ("x", "b"): (2, 0), ("x", "c"): (None, None), ("y", "a"): (3, 2), ("y", "b"): (1, -1), ("y", "c"): (2, None)}
