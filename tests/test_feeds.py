"""Nested feeds on small texts: variants, faults, nulls, repeats and empty tables; the append-only log from files."""

import json
from datetime import date

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pairlytics.operators import logs
from pairlytics.sources import payloads


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def raw(spark, *rows):
    return spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in rows], "game_id string, payload string")


def game(first=None, second=None, **more):
    sides = [{"teamId": 7, "nameShort": "A", "isHome": True, "isWinner": first}, {"teamId": "8", "nameShort": "B", "isWinner": second}]
    return {"contests": [{"gameState": "F", "startTimeEpoch": "86400", "teams": sides, **more}]}


def test_schedule(spark, tmp_path):
    days = {
        "2020-01-02": {"games": [{"game": {"gameID": "1"}}, {"id": 2}, {"gameID": "", "id": "3"}, {"game": {"id": "4"}, "gameID": "x"}, {}, {"game": {}}]},
        "2020-01-01": {"games": [{"gameID": "1"}, {"gameID": "1"}]},
        "2020-01-03": {"games": [{"gameID": "2"}, {"gameID": "5"}]},
        "2020-01-04": {"games": []}, "2020-01-05": {},
    }
    for day, doc in days.items():
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}/a.json").write_text(json.dumps(doc))
    (tmp_path / "day=2020-01-01/b.json").write_text('{"games": [{"gameID": "9"}')
    (tmp_path / "day=2020-01-01/c.json").write_text("")
    got = lambda today: {r["game_id"]: r["day"].day for r in payloads.schedule_ids(spark, str(tmp_path), today).collect()}
    assert got(F.lit(date(2020, 1, 2))) == {"1": 1, "2": 2, "3": 2, "4": 2}
    assert got(None) == {"1": 1, "2": 2, "3": 2, "4": 2, "5": 3}
    (tmp_path / "day=2020-01-01/d.json").write_text('{"games": [{"id": "5"}]}\n\n{"games"\n{"games": [{"id": "6"}]}\n')
    assert {r["game_id"]: r["day"].day for r in payloads.schedule_ids(spark, str(tmp_path), None, whole=False).collect()} == {"1": 1, "2": 2, "3": 2, "4": 2, "5": 1, "6": 1}
    plan = payloads.schedule_ids(spark, str(tmp_path), F.lit(date(2020, 1, 2)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(day#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_games_and_dead_letters(spark):
    rows = raw(spark, ("a", game(True, True)), ("b", {"contests": []}), ("c", None), ("d", ""), ("e", '{"contests": [{"gameState"'), (None, game()), ("f", {}), ("g", {"contests": [{}]}), ("h", {"contests": [None, {"gameState": "F"}]}))
    got = {r["game_id"]: r for r in payloads.game_records(rows).collect()}
    assert set(got) == {"a", "g"} and got["g"]["teams"] == [] and got["g"]["linescores"] is None
    assert [t["team_id"] for t in got["a"]["teams"]] == ["7", "8"] and got["a"]["source_tier"] == "OFFICIAL"
    reasons = {r["game_id"]: r["reason"] for r in payloads.dead_letters(rows).collect()}
    assert reasons == {"b": "no contest", "c": "missing", "d": "missing", "e": "not JSON", "f": "no contest", "h": "no contest"}
    assert payloads.game_records(rows.limit(0)).isEmpty() and payloads.dead_letters(rows.limit(0)).isEmpty()


def test_folds(spark):
    sets = [("25", "20"), ("1,000", "7"), ("-", "3"), (None, "4"), (" 5 ", "x")]
    df = spark.createDataFrame([(1, sets), (2, []), (3, None)], "id int, l array<struct<home string, visit string>>")
    got = {r["id"]: (tuple(r["s"]), tuple(r["z"])) for r in df.select("id", payloads.folded(F.col("l"), True).alias("s"), payloads.folded(F.col("l"), False).alias("z")).collect()}
    assert got == {1: ((1025, 27, 2), (30, 34, 5)), 2: ((0, 0, 0), (0, 0, 0)), 3: ((0, 0, 0), (0, 0, 0))}


def test_boxes_sides_and_players(spark):
    stats = lambda k: {"__typename": "S", "kills": k, "sets": [{"game": "1"}]}
    players = [{"participated": True, "lastName": "P", "kills": "3"}, {"participated": False, "lastName": "Q"}, {"lastName": "R"}]
    box = {"teams": [{"teamId": 7, "nameShort": "old"}, {"teamId": "7", "nameShort": "A"}], "teamBoxscore": [{"teamId": "7", "teamStats": stats("9"), "playerStats": players}, {"teamId": 8, "teamStats": stats("x")}]}
    one = {"teamBoxscore": [{"teamId": 7, "teamStats": stats("5")}]}
    boxes = raw(spark, ("a", box), ("b", one), ("c", None), ("d", "{"), ("e", {"teamBoxscore": []}))
    teams = {(r["game_id"], r["team_id"]): (r["name_short"], sorted(r["stats"])) for r in payloads.team_boxes(boxes).collect()}
    assert teams == {("a", "7"): ("A", ["kills", "sets"]), ("a", "8"): (None, ["kills", "sets"]), ("b", "7"): (None, ["kills", "sets"])}
    assert [(r["team_id"], r["last"], r["kills"], r["num"]) for r in payloads.player_rows(boxes).collect()] == [("7", "P", "3", None)]
    sets = [{"home": "25", "visit": "20"}]
    games = raw(spark, ("a", game(True, True, linescores=sets)), ("b", game(None, True)), ("c", game()), ("d", game(True, gameState="P")))
    sides = payloads.match_sides(payloads.game_records(games), payloads.team_boxes(boxes))
    got = {(r["game_id"], r["team_id"]): (r["won"], r["pf"], r["pa"], r["sets"], r["stats"] is None, r["opp_stats"] is None) for r in sides.collect()}
    assert got == {("a", "7"): (True, 25, 20, 1, False, False), ("a", "8"): (False, 20, 25, 1, False, False), ("b", "7"): (False, 0, 0, 0, False, True), ("b", "8"): (True, 0, 0, 0, True, False)}
    own = {r["team_id"]: (r["boxed"], r["kills"], r["opp_kills"]) for r in payloads.own_and_opponent(sides, ["kills"]).collect()}
    assert own == {"7": (1, 9, 0), "8": (1, 0, 9)}
    assert payloads.match_sides(payloads.game_records(games.limit(0)), payloads.team_boxes(boxes.limit(0))).isEmpty()


def test_log_of_files(spark, tmp_path):
    lines = ['{"id": "a", "s": "F", "n": 1}', "", '{"id": "a", "s": "I", "n": 2}', '{"id": "b", "s": "I", "n": 3}', '{"s": "F", "n": 4}', "   ", '{"id": "b", "s": "I", "n": 5}', '{"id": "c", "s": "F", "n"']
    (tmp_path / "1.jsonl").write_text("\n".join(lines))
    (tmp_path / "2.jsonl").write_text('{"id": "b", "s": "I", "n": 6}\n{"id": "a", "s": "F", "n": 7}\n')
    got = logs.read_log(spark, str(tmp_path), "id string, s string, n int", "id", F.col("s") == "F").collect()
    assert {r["id"]: r["n"] for r in got} == {"a": 7, "b": 6}
