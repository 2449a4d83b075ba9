"""Matches and their two sides, memberships, totals and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decided(games: DataFrame) -> DataFrame:
    """Final games with a winner, as (gid, date, championship, sets, winner side 0 or 1, both teams and points)."""
    return games.where("game_state = 'F' AND points_a <> points_b").withColumn("winner", F.when(F.col("points_a") > F.col("points_b"), 0).otherwise(1))


def sides(matches: DataFrame) -> DataFrame:
    """One row per match and side: gid, team, opp, pf, pa, won, home, date, championship, sets; by even gid the first side is at home."""
    a_home = F.col("gid") % 2 == 0

    def side(me: str, other: str, won: Column, home: Column) -> Column:
        return F.struct(F.col(f"team_{me}").alias("team"), F.col(f"team_{other}").alias("opp"), F.col(f"points_{me}").alias("pf"), F.col(f"points_{other}").alias("pa"), won.cast("int").alias("won"), home.alias("home"))

    both = F.explode(F.array(side("a", "b", F.col("winner") == 0, a_home), side("b", "a", F.col("winner") == 1, ~a_home)))
    return matches.select("gid", "date", "championship", "sets", both.alias("s")).select("gid", "s.*", "date", "championship", "sets")


def among_members(matches: DataFrame, members: DataFrame) -> DataFrame:
    """Matches with both teams in members (team)."""
    m = members.select("team")
    return matches.join(m.withColumnRenamed("team", "team_a"), "team_a", "left_semi").join(m.withColumnRenamed("team", "team_b"), "team_b", "left_semi")


def resolve_members(official: DataFrame | None, live: DataFrame) -> tuple[DataFrame, str]:
    """Members by precedence: the official table where it has rows, else those flagged in the log; and the source's name."""
    if official is not None and not official.isEmpty():
        return official, "official"
    return live.distinct(), "live"


def totals(sides_: DataFrame, members: DataFrame) -> DataFrame:
    """Per team: games, wins and losses against members and others, sets, points, and the share of games against members."""
    inside = F.col("opp_in")
    rows = sides_.join(members.select(F.col("team").alias("opp"), F.lit(True).alias("opp_in")), "opp", "left").fillna(False, ["opp_in"])
    n = lambda c, name: F.count_if(c).alias(name)
    won = F.col("won") == 1
    return rows.groupBy("team").agg(
        F.count("*").alias("games"), n(inside & won, "member_wins"), n(inside & ~won, "member_losses"), n(~inside & won, "other_wins"), n(~inside & ~won, "other_losses"),
        F.sum("sets").alias("sets"), F.sum("pf").alias("points_for"), F.sum("pa").alias("points_against"), F.avg(inside.cast("int")).alias("member_share"),
    )


def reconcile(derived: DataFrame, official: DataFrame) -> DataFrame:
    """Full outer join of two record tables (team, wins, losses): both records, their differences and a status."""
    d, o = derived.select("team", F.col("wins").alias("d_wins"), F.col("losses").alias("d_losses")), official.select("team", F.col("wins").alias("o_wins"), F.col("losses").alias("o_losses"))
    same = (F.col("d_wins") == F.col("o_wins")) & (F.col("d_losses") == F.col("o_losses"))
    status = F.when(F.col("d_wins").isNull(), "only official").when(F.col("o_wins").isNull(), "only derived").when(same, "matched").otherwise("mismatched")
    return d.join(o, "team", "full").select("*", status.alias("status"), (F.col("d_wins") - F.col("o_wins")).alias("delta_wins"), (F.col("d_losses") - F.col("o_losses")).alias("delta_losses"))


def conference_records(sides_: DataFrame, teams: DataFrame) -> DataFrame:
    """(conference, team, wins, losses, pct) from games between teams of one conference; teams (team, conference) without one are left out."""
    c = teams.where("conference IS NOT NULL").select("team", "conference")
    rows = sides_.join(c, "team").join(c.select(F.col("team").alias("opp"), F.col("conference").alias("opp_conf")), "opp").where("conference = opp_conf")
    out = rows.groupBy("conference", "team").agg(F.sum("won").alias("wins"), (F.count("*") - F.sum("won")).alias("losses"))
    return out.withColumn("pct", F.col("wins") / (F.col("wins") + F.col("losses")))


def split_by_date(matches: DataFrame, cutoff) -> DataFrame:
    """matches with `part`: before or from the cutoff on; those without a date are in neither and left out."""
    return matches.where("date IS NOT NULL").withColumn("part", F.when(F.col("date") < F.lit(cutoff), "before").otherwise("after"))


def last_day(rows: DataFrame, group: str, date: str) -> DataFrame:
    """The rows at the latest date of their group."""
    latest = rows.groupBy(group).agg(F.max(date).alias("_latest"))
    return rows.join(latest, group).where(F.col(date) == F.col("_latest")).drop("_latest")


def appearance_rounds(sides_: DataFrame) -> DataFrame:
    """(gid, round): the most games that either of its teams has played before it, by date and gid."""
    n = F.row_number().over(Window.partitionBy("team").orderBy("date", "gid"))
    return sides_.select("gid", n.alias("n")).groupBy("gid").agg((F.max("n") - 1).alias("round"))


def cut_dates(matches: DataFrame, fractions: tuple[float, ...]) -> DataFrame:
    """Distinct dates at the places floor(f (n - 1)) of the sorted match dates, counted by day before any sort."""
    per = matches.where("date IS NOT NULL").groupBy("date").agg(F.count("*").alias("n"))
    upto = per.withColumn("upto", F.sum("n").over(Window.orderBy("date"))).withColumn("all", F.sum("n").over(Window.partitionBy()))  # a row per day
    places = F.array(*[F.floor(F.lit(f) * (F.col("all") - 1)) for f in fractions])
    hit = F.exists(places, lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("n")))
    return upto.where(hit).select("date")
