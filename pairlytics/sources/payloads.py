"""Nested feeds: daily schedules, game payloads, boxes of teams and players, and their dead letters.

A payload is one JSON text a game id. Numbers stay text as served; ids that a feed writes as numbers become text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names

#: Fields of the feeds: fixed names that the payloads have.
SIDE = "teamId string, seoname string, nameShort string, nameFull string, isHome boolean, division int, divisionName string, score string, isWinner boolean, record string, teamRank string, seed string"
CONTEST = f"""seasonYear int, sportCode string, division int, gameState string, finalMessage string, startTimeEpoch string, winner string, championship boolean,
teams array<struct<{SIDE}>>, linescores array<struct<period string, home string, visit string>>, hasBoxscore boolean, hasPbp boolean"""
PLAYER = "participated boolean, firstName string, lastName string, number string, position string, gamesPlayed string, kills string, attackErrors string, attackAttempts string, serviceAces string, digs string, blockSolos string, blockAssists string, assists string, points string"
GAME_PAYLOAD = f"contests array<struct<{CONTEST}>>"
BOX_PAYLOAD = f"teams array<struct<teamId string, nameShort string, isHome boolean>>, teamBoxscore array<struct<teamId string, teamStats map<string, string>, playerStats array<struct<{PLAYER}>>>>"
DAY = "games array<struct<game struct<gameID string, id string>, gameID string, id string>>"
TIER = "OFFICIAL"


def schedule_ids(spark: SparkSession, path: str, today: Column | None = None, whole: bool = True) -> DataFrame:
    """(game_id, day): each game of a schedule with the first day that lists it; path has a folder day=YYYY-MM-DD of JSON texts a day.

    today: days after it are left out, by folder, before any file is opened; None takes all. A game is an object `game` or stands bare, its
    id is gameID, else id; those without and texts that aren't JSON are skipped. A text is a whole file, or a line where whole is false: such files
may hold any number of them, and large ones are split.
    """
    texts = spark.read.schema("value string, day date").text(path, wholetext=whole)
    if today is not None:
        texts = texts.where(F.col("day") <= today)
    games = texts.where("day IS NOT NULL").select("day", F.explode(F.from_json("value", DAY)["games"]).alias("g"))
    named = [F.when(F.col(c) != "", F.col(c)) for c in ("g.game.gameID", "g.game.id", "g.gameID", "g.id")]
    bare = F.col("g.game").isNull()
    found = games.select("day", F.when(bare, F.coalesce(*named[2:])).otherwise(F.coalesce(*named[:2])).alias("game_id"))
    return found.where("game_id IS NOT NULL").groupBy("game_id").agg(F.min("day").alias("day"))


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.where("game_id IS NOT NULL").select("game_id", F.from_json("payload", schema).alias("p"))


def game_records(raw: DataFrame) -> DataFrame:
    """raw (game_id, payload) flattened: one record a game from the payload's first contest; payloads without one give none."""
    c = _parsed(raw, GAME_PAYLOAD).select("game_id", F.get("p.contests", F.lit(0)).alias("c")).where("c IS NOT NULL")
    renamed = {
        "team_id": "teamId", "seoname": "seoname", "name_short": "nameShort", "name_full": "nameFull", "is_home": "isHome", "division": "division", "division_name": "divisionName",
        "sets_won": "score", "is_winner": "isWinner", "record_at_time": "record", "team_rank": "teamRank", "seed": "seed",
    }
    sides = F.transform(F.coalesce("c.teams", F.array()), lambda t: F.struct(*[t[old].alias(new) for new, old in renamed.items()]))
    top = {
        "season_year": "seasonYear", "sport_code": "sportCode", "division": "division", "game_state": "gameState", "final_message": "finalMessage", "start_time_epoch": "startTimeEpoch",
        "winner_team_id": "winner", "championship": "championship", "linescores": "linescores", "has_boxscore": "hasBoxscore", "has_pbp": "hasPbp",
    }
    return c.select("game_id", *[F.col(f"c.{old}").alias(new) for new, old in top.items()], sides.alias("teams"), F.lit(TIER).alias("source_tier"), F.concat(F.lit("/game/"), "game_id").alias("source"))


def dead_letters(raw: DataFrame) -> DataFrame:
    """(game_id, reason) of payloads that give no game record: missing, not JSON, or without a contest."""
    parsed = F.from_json("payload", f"{GAME_PAYLOAD}, _torn string", {"columnNameOfCorruptRecord": "_torn"})
    whole = raw.where("game_id IS NOT NULL").select("game_id", "payload", parsed.alias("p"))
    reason = F.when(F.col("payload").isNull() | (F.trim("payload") == ""), "missing").when(F.col("p._torn").isNotNull(), "not JSON").when(F.get("p.contests", F.lit(0)).isNull(), "no contest")
    return whole.select("game_id", reason.alias("reason")).where("reason IS NOT NULL")


def folded(linescores: Column, strict: bool) -> Column:
    """struct(home, visit, sets) of a game's linescores, null or empty: zeros.

    strict leaves a set out if either score is no number (commas are allowed); else such a score counts zero and the set counts.
    """
    number = names.number_or_null if strict else names.number_or_zero

    def add(acc: Column, one: Column) -> Column:
        home, visit = number(one["home"]).cast("long"), number(one["visit"]).cast("long")
        sums = F.struct((acc["home"] + home).alias("home"), (acc["visit"] + visit).alias("visit"), (acc["sets"] + 1).alias("sets"))
        return F.when(home.isNull() | visit.isNull(), acc).otherwise(sums) if strict else sums

    zero = F.struct(F.lit(0).cast("long").alias("home"), F.lit(0).cast("long").alias("visit"), F.lit(0).cast("long").alias("sets"))
    return F.aggregate(F.coalesce(linescores, F.array()), zero, add)


def team_boxes(raw: DataFrame) -> DataFrame:
    """(game_id, team_id, name_short, is_home, stats map): a row per team of a box, its name from the payload's list of teams (the last of an id)."""
    p = _parsed(raw, BOX_PAYLOAD).select("game_id", F.col("p.teams").alias("meta"), F.explode("p.teamBoxscore").alias("t"))
    named = F.element_at(F.filter(F.coalesce("meta", F.array()), lambda m: m["teamId"] == F.col("t.teamId")), -1)
    named = F.when(F.exists(F.coalesce("meta", F.array()), lambda m: m["teamId"] == F.col("t.teamId")), named)
    stats = F.map_filter("t.teamStats", lambda k, _: k != "__typename")
    return p.select("game_id", F.col("t.teamId").alias("team_id"), named.alias("m"), stats.alias("stats")).select("game_id", "team_id", "m.nameShort", "m.isHome", "stats").toDF("game_id", "team_id", "name_short", "is_home", "stats")


def player_rows(raw: DataFrame) -> DataFrame:
    """A row per player who took part: game_id, team_id, first, last, num, pos, gp and the counts, as served."""
    p = _parsed(raw, BOX_PAYLOAD).select("game_id", F.explode("p.teamBoxscore").alias("t")).select("game_id", F.col("t.teamId").alias("team_id"), F.explode("t.playerStats").alias("s"))
    short = {
        "first": "firstName", "last": "lastName", "num": "number", "pos": "position", "gp": "gamesPlayed", "kills": "kills", "errors": "attackErrors", "atts": "attackAttempts",
        "aces": "serviceAces", "digs": "digs", "bs": "blockSolos", "ba": "blockAssists", "assists": "assists", "points": "points",
    }
    return p.where("s.participated").select("game_id", "team_id", *[F.col(f"s.{old}").alias(new) for new, old in short.items()])


def match_sides(records: DataFrame, boxes: DataFrame) -> DataFrame:
    """A row per side of each final two-sided game with a winner: game_id, date, championship, team_id, opp_id, won, home, pf, pa, sets, stats, opp_stats.

    The first side is asked first whether it won. Points are the sum of the sets, oriented by who is at home; stats are null
    where the game has no box of the side.
    """
    two = records.where((F.col("game_state") == "F") & (F.size("teams") == 2))
    flag = lambda i: F.coalesce(F.get("teams", F.lit(i))["is_winner"], F.lit(False))
    won = F.when(flag(0), 0).when(flag(1), 1)
    fold = folded(F.col("linescores"), strict=False)
    flat = two.select("game_id", names.utc_date(F.col("start_time_epoch")).alias("date"), F.coalesce("championship", F.lit(False)).alias("championship"), "teams", won.alias("winner"), fold.alias("f")).where("winner IS NOT NULL")
    side = flat.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    me, other = F.get("teams", F.col("i")), F.get("teams", 1 - F.col("i"))
    home = F.coalesce(me["is_home"], F.lit(False))
    side = side.select(
        "game_id", "date", "championship", me["team_id"].alias("team_id"), other["team_id"].alias("opp_id"), (F.col("winner") == F.col("i")).alias("won"), home.alias("home"),
        F.when(home, F.col("f.home")).otherwise(F.col("f.visit")).alias("pf"), F.when(home, F.col("f.visit")).otherwise(F.col("f.home")).alias("pa"), F.col("f.sets").alias("sets"),
    )
    # one table of boxes a game, so that both sides' lines come with one join
    box = boxes.where("team_id IS NOT NULL").groupBy("game_id").agg(F.collect_list(F.struct("team_id", "stats")).alias("lines"))  # the teams of one box
    line = lambda c: F.get(F.filter("lines", lambda x: x["team_id"] == F.col(c)), F.lit(0))["stats"]
    return side.join(box, "game_id", "left").withColumns({"stats": line("team_id"), "opp_stats": line("opp_id")}).drop("lines")


def own_and_opponent(sides: DataFrame, fields: list[str]) -> DataFrame:
    """Per team_id: boxed games and the sums of the fields, own and the opponents' (opp_<field>), over games with both boxes; no number counts zero."""
    both = sides.where("stats IS NOT NULL AND opp_stats IS NOT NULL")
    total = lambda of, f: F.sum(names.number_or_zero(F.element_at(of, f)).cast("long"))
    return both.groupBy("team_id").agg(F.count("*").alias("boxed"), *[total(F.col(s), f).alias(p + f) for f in fields for s, p in (("stats", ""), ("opp_stats", "opp_"))])
