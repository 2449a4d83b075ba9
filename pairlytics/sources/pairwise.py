"""Pairwise results from order tables: a game is an order with exactly two suppliers, who are its sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, team, points, lines): one row per order and supplier."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("gid"), F.col("l_suppkey").alias("team")).agg(F.sum("l_quantity").alias("points"), F.count("*").alias("lines"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, n, a, b): number of sides of each order, and its first and last by team; two aggregations on one key prefix."""
    side = F.struct("team", "points", "lines")
    return sides(spark, sf_dir).groupBy("gid").agg(F.count("*").alias("n"), F.min(side).alias("a"), F.max(side).alias("b"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, team_a, team_b, points_a, points_b, sets, game_state, date, championship) of two-sided orders."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("gid"), F.col("o_orderstatus").alias("game_state"), F.to_date("o_orderdate").alias("date"), (F.col("o_orderpriority") == "1-URGENT").alias("championship")
    )
    two = shapes(spark, sf_dir).where("n = 2")
    return two.join(orders, "gid").select(
        "gid", F.col("a.team").alias("team_a"), F.col("b.team").alias("team_b"), F.col("a.points").alias("points_a"), F.col("b.points").alias("points_b"),
        (F.col("a.lines") + F.col("b.lines")).alias("sets"), "game_state", "date", "championship",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(games(spark, sf_dir))


def edges_of(games_: DataFrame) -> DataFrame:
    """(winner, loser, gid) of the final games with a winner."""
    won = F.col("points_a") > F.col("points_b")
    final = games_.where("game_state = 'F' AND points_a <> points_b")
    return final.select(F.when(won, F.col("team_a")).otherwise(F.col("team_b")).alias("winner"), F.when(won, F.col("team_b")).otherwise(F.col("team_a")).alias("loser"), "gid")


SIDE = "side AS (SELECT l_orderkey AS gid, l_suppkey AS team, sum(l_quantity) AS points, count(*) AS lines FROM lineitem GROUP BY ALL)"
GAME = f"""{SIDE}, two AS (SELECT gid FROM side GROUP BY gid HAVING count(*) = 2),
game AS (SELECT a.gid, a.team AS team_a, b.team AS team_b, a.points AS points_a, b.points AS points_b, o_orderstatus AS game_state
FROM two JOIN side a USING (gid) JOIN side b ON b.gid = a.gid AND a.team < b.team JOIN orders ON o_orderkey = a.gid)"""
EDGE = f"""{GAME}, edge AS (SELECT CASE WHEN points_a > points_b THEN team_a ELSE team_b END AS winner, CASE WHEN points_a > points_b THEN team_b ELSE team_a END AS loser, gid
FROM game WHERE game_state = 'F' AND points_a <> points_b)"""
