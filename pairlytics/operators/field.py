"""Selection of a field: automatic qualifiers, at-large places, seeds, and the comparison with an actual field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import stored
from .ordering import ranked

#: Least winning share and least share of games against members of an at-large team; rank of a team without one.
MIN_PCT, MIN_SHARE, NO_RANK = 0.5, 0.8, 999


def qualifiers(conference: DataFrame, ranks: DataFrame) -> DataFrame:
    """(conference, team): the best share inside each conference, then the best rank, then the key."""
    rows = conference.join(ranks.select("team", "rank"), "team", "left")
    best = F.struct(F.round("pct", 10), -F.coalesce("rank", F.lit(NO_RANK)), -F.col("team"))
    return rows.groupBy("conference").agg(F.max_by("team", best).alias("team"))


def gates(totals: DataFrame) -> DataFrame:
    """(team, at_large, reason) of team totals."""
    wins = F.col("member_wins") + F.col("other_wins")
    pct = wins / F.col("games")
    reason = F.when(pct < MIN_PCT, "under .500").when(F.col("member_share") < MIN_SHARE, "schedule").otherwise("")
    return totals.select("team", (reason == "").alias("at_large"), reason.alias("reason"))


def resume(ranks: DataFrame, bands: DataFrame) -> DataFrame:
    """(team, rank, score): rank less two for each top-25 win and one for each top-50 win (lower is better)."""
    out = ranks.select("team", "rank").join(bands, "team", "left").fillna(0)
    return out.select("team", "rank", (F.col("rank") - 2 * F.col("top25_wins") - F.col("top50_wins")).alias("score"))


def select(autos: DataFrame, resumes: DataFrame, gate: DataFrame, size: int, seeds: int) -> DataFrame:
    """(team, bid, seed): qualifiers and the best other eligible teams up to size places; the first `seeds` by rank have a seed."""
    auto = stored(autos.select("team").distinct())
    places = max(0, size - auto.count())
    pool = resumes.join(gate.where("at_large").select("team"), "team", "left_semi").join(auto, "team", "left_anti")
    chosen = ranked(pool.withColumn("_s", -F.col("score")), "_s", "team", "place").where(F.col("place") <= places)
    both = auto.withColumn("bid", F.lit("auto")).unionByName(chosen.select("team", F.lit("at-large").alias("bid")))
    out = ranked(both.join(resumes.select("team", "rank"), "team").withColumn("_r", -F.col("rank")), "_r", "team", "seed")
    return out.select("team", "bid", F.when(F.col("seed") <= seeds, F.col("seed")).cast("long").alias("seed"))


def compared(field: DataFrame, actual: DataFrame) -> DataFrame:
    """(outcome, n): hits, missed and wrong teams of a projected field (team) against an actual one."""
    f, a = field.select("team", F.lit(True).alias("f")), actual.select("team", F.lit(True).alias("a"))
    both = f.join(a, "team", "full")
    return both.groupBy(F.when(F.col("f").isNull(), "missed").when(F.col("a").isNull(), "wrong").otherwise("hit").alias("outcome")).agg(F.count("*").alias("n"))


#: How a conference names its qualifier.
TOURNAMENT, SEASON = "TOURNAMENT", "REGULAR_SEASON"


def automatic(sides: DataFrame, teams: DataFrame, ranks: DataFrame, mechanisms: DataFrame, ineligible: DataFrame) -> DataFrame:
    """(conference, team, mechanism, note): the automatic qualifier of each conference, and by which rule it was found.

    teams (team, conference), ranks (team, rank), mechanisms (conference, mechanism; a tournament where none is given), ineligible (team). A tournament's champion
    is the winner of the only game of the last day inside the conference; of a batch of games that day, the winner with the best share. In a season conference it is the
    member with the best share. Shares tie by rank (none counts last), then by key. An ineligible champion's bid goes to the eligible member of best rank, if there
    is one. A conference without games among its members has no qualifier. Nothing is gathered: each step is an aggregate by conference.
    """
    member = teams.where("conference IS NOT NULL").select("team", "conference")
    inside = sides.join(member, "team").join(member.select(F.col("team").alias("opp"), F.col("conference").alias("_c")), "opp").where("conference = _c")
    inside = stored(inside.select("conference", "team", "gid", "won", "date"))
    share = inside.groupBy("conference", "team").agg(F.round(F.avg("won"), 10).alias("pct"))
    latest = inside.groupBy("conference").agg(F.max("date").alias("date"))
    day = inside.join(latest, ["conference", "date"])
    games = day.groupBy("conference").agg(F.count_distinct("gid").alias("games"))
    winner = day.where("won = 1").select("team", F.lit(True).alias("won_last")).distinct()
    rows = member.join(ranks.select("team", "rank"), "team", "left").join(share, ["conference", "team"], "left").join(winner, "team", "left")
    rows = rows.join(ineligible.select("team", F.lit(True).alias("barred")).distinct(), "team", "left").join(mechanisms, "conference", "left").join(games, "conference", "left")
    rows = rows.withColumns({"mechanism": F.coalesce("mechanism", F.lit(TOURNAMENT)), "place": F.coalesce("rank", F.lit(NO_RANK))})
    by_share = F.struct(F.coalesce("pct", F.lit(0.0)), -F.col("place"), -F.col("team"))
    candidate = (F.col("mechanism") == SEASON) | F.col("won_last")
    who = F.struct("team", F.coalesce("barred", F.lit(False)).alias("barred"))
    out = rows.groupBy("conference").agg(
        F.max("mechanism").alias("mechanism"), F.max("games").alias("games"), F.max_by(who, F.when(candidate, by_share)).alias("first"),
        F.max_by("team", F.when(F.col("barred").isNull(), F.struct(-F.col("place"), -F.col("team")))).alias("next"),
    )
    how = F.when(F.col("mechanism") == SEASON, "best share").when(F.col("games") == 1, "sole game of the last day").otherwise(F.concat(F.lit("best of "), F.col("games").cast("string"), F.lit(" games of the last day")))
    played, barred = F.col("games").isNotNull() & F.col("first.team").isNotNull(), F.col("first.barred")
    note = F.when(~played, "no conference games").when(~barred, how).when(F.col("next").isNull(), "champion ineligible, no eligible member").otherwise(F.concat(how, F.lit(", champion ineligible: bid passes")))
    team = F.when(played, F.when(barred, F.col("next")).otherwise(F.col("first.team")))
    return out.select("conference", team.alias("team"), "mechanism", note.alias("note"))


def eligibility(totals: DataFrame, ineligible: DataFrame) -> DataFrame:
    """(team, championship, at_large, reason): ineligible teams may do neither; the gates of `gates` hold for at-large places only."""
    rows = gates(totals).join(ineligible.select("team", F.lit(True).alias("barred")).distinct(), "team", "left")
    free = F.col("barred").isNull()
    return rows.select("team", free.alias("championship"), (free & F.col("at_large")).alias("at_large"), F.when(~free, "ineligible").when(F.col("reason") != "", F.concat("reason", F.lit(", at-large only"))).otherwise("").alias("reason"))
