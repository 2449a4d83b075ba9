"""Records and schedule-aware ratings of teams from (winner, loser, gid) edges.

The opponent terms use head-to-head counts, never pairs of games: a team's opponents' percentage without their games
against it follows from the opponent's totals less the two teams' mutual ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import stored
from .ordering import ranked

__all__ = ["bands", "head_to_head", "meetings", "ranked", "records", "rpi"]

#: Fixed weights of own, opponents' and opponents' opponents' winning percentage.
WP, OWP, OOWP = 0.25, 0.50, 0.25


def head_to_head(edges: DataFrame) -> DataFrame:
    """(winner, loser, n)."""
    return edges.groupBy("winner", "loser").agg(F.count("*").alias("n"))


def meetings(edges: DataFrame) -> DataFrame:
    """(team, opp, won, lost): both directions of each pair that met."""
    both = edges.select(F.col("winner").alias("team"), F.col("loser").alias("opp"), F.lit(1).alias("w")).unionByName(edges.select(F.col("loser").alias("team"), F.col("winner").alias("opp"), F.lit(0).alias("w")))
    return both.groupBy("team", "opp").agg(F.sum("w").alias("won"), (F.count("*") - F.sum("w")).alias("lost"))


def records(edges: DataFrame) -> DataFrame:
    """(team, wins, losses) of the teams that played."""
    return meetings(edges).groupBy("team").agg(F.sum("won").alias("wins"), F.sum("lost").alias("losses"))


def rpi(edges: DataFrame) -> DataFrame:
    """(team, wins, losses, wp, owp, oowp, rpi); an opponent who played no one else counts 0."""
    met = stored(meetings(edges))  # a row per pair of teams, read by each term
    total = met.groupBy("team").agg(F.sum("won").alias("wins"), F.sum("lost").alias("losses"))
    opp = total.select(F.col("team").alias("opp"), F.col("wins").alias("ow"), F.col("losses").alias("ol"))
    n = F.col("won") + F.col("lost")
    # the opponent's wins over this team are this team's losses
    other = F.coalesce(F.try_divide(F.col("ow") - F.col("lost"), F.col("ow") + F.col("ol") - n), F.lit(0.0))
    owp = met.join(opp, "opp").groupBy("team").agg((F.sum(other * n) / F.sum(n)).alias("owp"))
    oowp = met.join(owp.withColumnRenamed("team", "opp"), "opp").groupBy("team").agg((F.sum(F.col("owp") * n) / F.sum(n)).alias("oowp"))
    out = total.join(owp, "team").join(oowp, "team").withColumn("wp", F.col("wins") / (F.col("wins") + F.col("losses")))
    return out.select("team", "wins", "losses", "wp", "owp", "oowp", (WP * F.col("wp") + OWP * F.col("owp") + OOWP * F.col("oowp")).alias("rpi"))


def bands(edges: DataFrame, ranks: DataFrame, top: tuple[int, ...] = (25, 50)) -> DataFrame:
    """(team, wins and losses against the first `top` ranks, cumulative)."""
    met = meetings(edges).join(ranks.select(F.col("team").alias("opp"), "rank"), "opp")
    inside = lambda c, t: F.coalesce(F.sum(F.when(F.col("rank") <= t, F.col(c))), F.lit(0)).alias(f"top{t}_{'wins' if c == 'won' else 'losses'}")
    return met.groupBy("team").agg(*[inside(c, t) for t in top for c in ("won", "lost")])
