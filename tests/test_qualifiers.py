"""Every branch of the qualifiers' rules on a small table."""

from datetime import date

from pyspark.sql import SparkSession

from pairlytics.operators import field


def test_each_branch():
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    teams = [(c * 10 + i, f"c{c}") for c in range(7) for i in range(4)] + [(99, None)]
    day = [date(2020, 1, d) for d in range(1, 9)]
    games, gid = [], 0

    def add(c, w, l, d):  # noqa: E741
        nonlocal gid
        for t, o, x in ((w, l, 1), (l, w, 0)):
            games.append((gid, c * 10 + t, c * 10 + o, x, d))
        gid += 1

    for c in (0, 1, 3, 4, 5):  # team 0 is best over the season, without game on the last day
        add(c, 0, 1, day[0])
        add(c, 0, 2, day[1])
        add(c, 1, 2, None)
    add(0, 3, 1, day[5])  # sole game
    add(1, 3, 2, day[5])  # a batch: 3 has the better share, though 1 won more
    add(1, 1, 2, day[5])
    add(3, 3, 1, day[5])  # 3 is barred: the bid passes to the best rank that isn't
    add(4, 3, 1, day[5])  # all are barred
    games.append((gid, 20, 99, 1, day[0]))  # no game inside c2
    ranks = [(c * 10 + i, 100 - c * 10 - i) for c in range(7) for i in range(3)]  # the fourth has none
    s = spark.createDataFrame(games, "gid long, team long, opp long, won int, date date")
    t, r = spark.createDataFrame(teams, "team long, conference string"), spark.createDataFrame(ranks, "team long, rank int")
    kinds, barred = spark.createDataFrame([("c5", field.SEASON), ("c6", field.SEASON)], "conference string, mechanism string"), spark.createDataFrame([(33,), (40,), (41,), (42,), (43,)], "team long")
    got = {x["conference"]: (x["team"], x["mechanism"], x["note"]) for x in field.automatic(s, t, r, kinds, barred).collect()}
    assert got == {
        "c0": (3, "TOURNAMENT", "sole game of the last day"), "c1": (13, "TOURNAMENT", "best of 2 games of the last day"), "c2": (None, "TOURNAMENT", "no conference games"),
        "c3": (32, "TOURNAMENT", "sole game of the last day, champion ineligible: bid passes"), "c4": (None, "TOURNAMENT", "champion ineligible, no eligible member"),
        "c5": (50, "REGULAR_SEASON", "best share"), "c6": (None, "REGULAR_SEASON", "no conference games"),
    }
    assert field.automatic(s.limit(0), t.limit(0), r, kinds, barred).isEmpty()
