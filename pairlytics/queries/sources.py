"""Prioritised sources: official values over derived ones, chains of sources, people who changed teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fallback, ratings
from ..sources import pairwise
from ..sources.pairwise import EDGE, table


def official_override(spark, d):
    """Records of the games; every third team has an official one, some of them without losses."""
    derived = ratings.records(pairwise.edges(spark, d)).select("team", F.col("wins").cast("long").alias("wins"), F.col("losses").cast("long").alias("losses"))
    s = table(spark, d, "supplier").where("s_suppkey % 3 = 0")
    official = s.select(F.col("s_suppkey").alias("team"), F.col("s_nationkey").cast("long").alias("wins"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(7).cast("long")).alias("losses"))
    return fallback.overridden(derived, official, "team", ["wins", "losses"]).select("team", "wins", "losses", "method")


def source_fallback(spark, d):
    """Balances of the suppliers from three sources, each of which covers some; the first has rows without a value."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("team"), F.col("s_acctbal").alias("v"))
    part = lambda n, times: s.where(F.col("team") % n == 0).select("team", (F.col("v") * times).alias("value"))
    joined = part(4, 1).withColumn("value", F.when(F.col("team") % 8 != 0, F.col("value")))
    return fallback.first_source(s.select("team"), [("joined", joined), ("players", part(3, 2)), ("compact", part(5, 4))], "team", ["value"]).select("team", "value", "method")


def transfer_points(spark, d):
    """Parts of odd keys look for their points among those of even keys and the same brand; some write a first name as an initial."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("team"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("points"))
    short = F.concat(F.left("name", F.lit(1)), F.lit(".  "), F.element_at(F.split("name", " "), -1))
    moved = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id"), "team", F.when(F.col("p_partkey") % 6 == 1, short).when(F.col("p_partkey") % 10 != 5, F.upper("name")).alias("name"))
    out = fallback.transfers(moved, p.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "pool_id"))
    return out.select("id", "pool_id", "points", "method")


QUERIES = [official_override, source_fallback, transfer_points]


def oracle(rpi: str) -> dict[str, str]:
    """rpi isn't used here."""
    plain = r"trim(regexp_replace(replace(lower(coalesce({}, '')), '.', ''), '\s+', ' ', 'g'))"
    return {
        "official_override": f"""WITH {EDGE}, r AS (SELECT team, sum(w)::BIGINT AS wins, (count(*) - sum(w))::BIGINT AS losses FROM (SELECT winner AS team, 1 AS w FROM edge UNION ALL SELECT loser, 0 FROM edge) GROUP BY team)
SELECT team, CASE WHEN team % 3 = 0 THEN s_nationkey ELSE wins END AS wins, CASE WHEN team % 3 <> 0 THEN losses WHEN team % 2 = 0 THEN 7 END AS losses,
CASE WHEN team % 3 = 0 THEN 'official' ELSE 'derived' END AS method FROM r JOIN supplier ON s_suppkey = team""",
        "source_fallback": """SELECT s_suppkey AS team, CASE method WHEN 'joined' THEN s_acctbal WHEN 'players' THEN s_acctbal * 2 WHEN 'compact' THEN s_acctbal * 4 END AS value, method
FROM (SELECT *, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 8 <> 0 THEN 'joined' WHEN s_suppkey % 3 = 0 THEN 'players' WHEN s_suppkey % 5 = 0 THEN 'compact' ELSE 'none' END AS method FROM supplier)""",
        "transfer_points": f"""WITH raw AS (SELECT p_partkey AS id, p_brand AS team, p_size::BIGINT AS points, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 6 = 1 THEN p_name[1] || '.  ' || split(p_name, ' ')[-1]
WHEN p_partkey % 10 <> 5 THEN upper(p_name) END AS name FROM part), n AS (SELECT *, {plain.format('name')} AS k FROM raw), p AS (SELECT * FROM n WHERE id % 2 = 0 AND k <> ''),
m AS (SELECT n.id, p.id AS pool_id, p.points, n.k = p.k AS same, row_number() OVER (PARTITION BY n.id ORDER BY n.k = p.k DESC, p.id) AS place
FROM n JOIN p ON p.team = n.team AND (p.k = n.k OR (split(p.k, ' ')[-1] = split(n.k, ' ')[-1] AND p.k[1] = n.k[1])) WHERE n.id % 2 = 1 AND n.k <> '')
SELECT n.id, m.pool_id, m.points, CASE WHEN m.id IS NULL THEN 'none' WHEN same THEN 'exact' ELSE 'surname' END AS method FROM n LEFT JOIN m ON m.id = n.id AND place = 1 WHERE n.id % 2 = 1""",
    }
