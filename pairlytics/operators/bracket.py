"""A bracket rebuilt from its games, and exact propagation of probabilities over it.

Rounds follow from appearances, feeders from an as-of self-join (the latest earlier round's game that a team won), so the tree may be irregular: a node
whose feeders aren't both known falls back to the pair that really met. Distributions are passed on round by round; only nodes that lead to the
final one are computed, a round is one join and one aggregation, and each round is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import probability
from .lineage import stored
from .matches import appearance_rounds

EVEN = 0.5  # fixed: probability where a strength is missing


def nodes(games: DataFrame) -> DataFrame:
    """(gid, round, date, team_a, team_b, winner, home, feeder_a, feeder_b) of decided games (gid, date, team_a, team_b, winner and home as team); games without date come first."""
    sides = games.select("gid", F.explode(F.array("team_a", "team_b")).alias("team"), F.coalesce("date", F.to_date(F.lit("1900-01-01"))).alias("date"))
    rows = stored(games.join(appearance_rounds(sides), "gid"))
    # all a team's games with what it won; the frame ends before the game's own round
    side = lambda c: rows.select("gid", "round", "date", F.col(c).alias("team"), F.lit(c).alias("side"), "winner")
    seen = F.struct("round", -F.unix_date(F.coalesce("date", F.to_date(F.lit("1900-01-01")))).alias("_d"), (-F.col("gid")).alias("_g"))
    won = F.when(F.col("winner") == F.col("team"), seen)
    earlier = Window.partitionBy("team").orderBy("round").rangeBetween(Window.unboundedPreceding, -1)
    fed = side("team_a").unionByName(side("team_b")).withColumn("feeder", -F.max(won).over(earlier)["_g"])
    pair = fed.groupBy("gid").agg(*[F.max(F.when(F.col("side") == f"team_{s}", F.col("feeder"))).alias(f"feeder_{s}") for s in "ab"])
    return rows.join(pair, "gid")


def final_node(tree: DataFrame) -> DataFrame:
    """The first game of the last round, by date and gid."""
    return tree.orderBy(F.desc("round"), F.asc_nulls_first("date"), "gid").limit(1)


def needed(tree: DataFrame, rounds: int) -> DataFrame:
    """The nodes from which the final node is reached through feeders."""
    fed = F.explode(F.array("feeder_a", "feeder_b")).alias("gid")
    whole = F.col("feeder_a").isNotNull() & F.col("feeder_b").isNotNull()
    want = final_node(tree).select("gid")
    for r in range(rounds, 0, -1):
        below = tree.where(F.col("round") == r).where(whole).join(want, "gid", "left_semi").select(fed)
        want = stored(want.unionByName(below).distinct())
    return stored(tree.join(want, "gid", "left_semi"))


def wins(margin: Column) -> Column:
    return F.when(margin.isNull(), EVEN).otherwise(probability.match_win(margin))  # greatest and least would skip the null


def winner_distributions(tree: DataFrame, strength: DataFrame, home_half: float) -> DataFrame:
    """(gid, team, p): probability to win each node that leads to the final one; strength (team, margin) may lack teams."""
    top = tree.agg(F.max("round")).first()[0]
    if top is None:
        return tree.select("gid", F.col("team_a").alias("team"), F.lit(0.0).alias("p"))
    tree = needed(tree, top)
    leaf = (F.col("round") == 0) | F.col("feeder_a").isNull() | F.col("feeder_b").isNull()
    s = lambda c: strength.select(F.col("team").alias(c), F.col("margin").alias(f"m_{c}"))
    met = tree.where(leaf).join(s("team_a"), "team_a", "left").join(s("team_b"), "team_b", "left")
    gap = F.col("m_team_a") - F.col("m_team_b") + F.when(F.col("home") == F.col("team_a"), 2 * home_half).when(F.col("home") == F.col("team_b"), -2 * home_half).otherwise(0.0)
    real = met.withColumn("pa", wins(gap)).select("gid", F.explode(F.array(F.struct(F.col("team_a").alias("team"), F.col("pa").alias("p")), F.struct(F.col("team_b").alias("team"), (1 - F.col("pa")).alias("p")))).alias("x"))
    done = [stored(real.select("gid", "x.*"))]
    for r in range(1, top + 1):
        known = reduce(DataFrame.unionByName, done)
        here = tree.where((F.col("round") == r) & ~leaf)
        into = here.select("gid", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("feeder_a").alias("from")), F.struct(F.lit("b").alias("side"), F.col("feeder_b").alias("from")))).alias("x")).select("gid", "x.*")
        fed = into.join(known.withColumnRenamed("gid", "from"), "from").join(strength, "team", "left").select("gid", "side", "team", "p", "margin")
        other = fed.select("gid", F.col("side").alias("side2"), F.col("p").alias("p2"), F.col("margin").alias("m2"))
        pairs = fed.join(other, "gid").where("side <> side2")
        out = pairs.groupBy("gid", "team").agg(F.sum(F.col("p") * F.col("p2") * wins(F.col("margin") - F.col("m2"))).alias("p"))
        done.append(stored(out))
    return reduce(DataFrame.unionByName, done)


def title(tree: DataFrame, strength: DataFrame, home_half: float) -> DataFrame:
    """(team, p): probability to win the final node."""
    return winner_distributions(tree, strength, home_half).join(final_node(tree).select("gid"), "gid", "left_semi").select("team", "p")


def champion(tree: DataFrame, titles: DataFrame) -> DataFrame:
    """One row: the final node's real winner, its probability and its rank among the teams (1 + teams with more, ties by key), their number, and whether all add up to one."""
    won = F.broadcast(final_node(tree).select("winner"))
    rows = titles.withColumn("p", F.round("p", 12)).join(won)  # one row
    mine = F.max(F.struct((F.col("team") == F.col("winner")).alias("is"), "p", "team")).over(Window.partitionBy("winner"))
    rows = rows.withColumn("mine", mine).withColumn("before", (F.col("p") > F.col("mine.p")) | ((F.col("p") == F.col("mine.p")) & (F.col("team") < F.col("winner"))))
    got = rows.groupBy("winner").agg(F.max(F.when(F.col("team") == F.col("winner"), F.col("p"))).alias("p"), (F.count_if("before") + 1).alias("rank"), F.count("*").alias("teams"), F.sum("p").alias("total"))
    return got.select(F.col("winner").alias("champion"), "p", F.when(F.col("p").isNotNull(), F.col("rank")).alias("rank"), "teams", (F.abs(F.col("total") - 1) < 1e-9).alias("adds_up"))
