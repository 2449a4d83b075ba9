"""Matches, records, memberships, reconciliation."""

from pyspark.sql import functions as F

from ..operators import matches as M
from ..operators import ratings
from ..operators.ordering import ranked
from ..sources import pairwise
from ..sources.pairwise import SIDE, table

CUTOFF = "1997-01-01"
GAMEX = f"""{SIDE}, two AS (SELECT gid FROM side GROUP BY gid HAVING count(*) = 2),
m AS (SELECT a.gid, a.team AS team_a, b.team AS team_b, a.points AS points_a, b.points AS points_b, a.lines + b.lines AS sets, o_orderdate::DATE AS date, o_orderpriority = '1-URGENT' AS championship
FROM two JOIN side a USING (gid) JOIN side b ON b.gid = a.gid AND a.team < b.team JOIN orders ON o_orderkey = a.gid WHERE o_orderstatus = 'F' AND a.points <> b.points),
ms AS (SELECT gid, team_a AS team, team_b AS opp, points_a AS pf, points_b AS pa, (points_a > points_b)::INT AS won, gid % 2 = 0 AS home, date, championship, sets FROM m
UNION ALL SELECT gid, team_b, team_a, points_b, points_a, (points_b > points_a)::INT, gid % 2 <> 0, date, championship, sets FROM m)"""
TEAM = """team AS (SELECT s_suppkey AS team, s_name AS name, n_name AS conference, s_acctbal >= 0 AS is_member, row_number() OVER (ORDER BY round(s_acctbal, 10) DESC, s_suppkey) AS official_rank
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""


def matches(spark, d):
    return M.decided(pairwise.games(spark, d))


def teams(spark, d):
    """(team, name, conference, is_member, official_rank)."""
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    s = s.select(F.col("s_suppkey").alias("team"), F.col("s_name").alias("name"), F.col("n_name").alias("conference"), (F.col("s_acctbal") >= 0).alias("is_member"), "s_acctbal")
    return ranked(s, "s_acctbal", "team", "official_rank").drop("s_acctbal")


def conferences(spark, d):
    """(team, conference)."""
    n = F.broadcast(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("conference")))  # 25 rows
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("team"), "conference")


def members(spark, d):
    return table(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("team"))


def match_sides(spark, d):
    return M.sides(matches(spark, d))


def _records(sides):
    return sides.groupBy("team").agg(F.sum("won").alias("wins"), (F.count("*") - F.sum("won")).alias("losses"))


def member_records(spark, d):
    return _records(M.sides(M.among_members(matches(spark, d), members(spark, d))))


def team_totals(spark, d):
    return M.totals(match_sides(spark, d), members(spark, d)).withColumn("member_share", F.round("member_share", 6))


def reconcile_records(spark, d):
    return M.reconcile(member_records(spark, d), _records(match_sides(spark, d).where("NOT championship")))


def reconcile_largest(spark, d):
    """The 60 largest differences."""
    out = reconcile_records(spark, d).where("status = 'mismatched'")
    size = F.abs(F.col("delta_wins") + F.col("delta_losses"))
    return out.select("team", size.alias("size"), (F.col("d_wins") + F.col("d_losses")).alias("games")).orderBy(F.desc("size"), F.desc("games"), "team").limit(60)


def date_split(spark, d):
    out = M.split_by_date(matches(spark, d), F.to_date(F.lit(CUTOFF)))
    return out.groupBy("part", F.coalesce("championship", F.lit(False)).alias("championship")).agg(F.count("*").alias("games"))


def conference_records(spark, d):
    return M.conference_records(match_sides(spark, d), conferences(spark, d)).withColumn("pct", F.round("pct", 6))


def last_day_games(spark, d):
    t = conferences(spark, d)
    s = match_sides(spark, d).join(t, "team").join(t.select(F.col("team").alias("opp"), F.col("conference").alias("c2")), "opp").where("conference = c2 AND won = 1")
    return M.last_day(s, "conference", "date").select("conference", "gid", F.col("team").alias("winner"), F.col("date").cast("string").alias("date"))


def appearance_rounds(spark, d):
    return M.appearance_rounds(match_sides(spark, d)).withColumn("round", F.col("round").cast("long"))


def chrono_cut_dates(spark, d):
    return M.cut_dates(matches(spark, d), (0.55, 0.70, 0.85)).select(F.col("date").cast("string").alias("date"))


def membership_resolve(spark, d):
    found, label = M.resolve_members(members(spark, d), match_sides(spark, d).select("team"))
    return found.groupBy(F.lit(label).alias("source")).agg(F.count("*").alias("teams"))


def data_through(spark, d):
    return matches(spark, d).agg(F.max("date").cast("string").alias("data_through"), F.count("*").alias("games"))


def rank_agreement(spark, d):
    both = _ranks(spark, d).withColumn("x", F.abs("delta"))
    n = lambda k: F.count_if(F.col("x") <= k)
    return both.agg(F.count("*").alias("teams"), n(0).alias("exact"), n(3).alias("within3"), n(10).alias("within10"), F.round(F.avg("x"), 6).alias("mean_abs"))


def _ranks(spark, d):
    derived = ratings.ranked(ratings.rpi(pairwise.edges(spark, d)), "rpi", "team", "derived_rank")
    return derived.join(teams(spark, d).select("team", "official_rank"), "team", "left").withColumn("delta", F.col("official_rank") - F.col("derived_rank"))


def rank_delta_top(spark, d):
    """The 16 largest differences of rank; none where there is no official rank."""
    out = _ranks(spark, d).select("team", F.col("delta").cast("long").alias("delta")).orderBy(F.abs("delta").desc_nulls_last(), "team")
    return out.limit(16)


def marquee_profile(spark, d):
    """Wins against ranks 1-25 and 26-50, losses to the lowest 61-85 and lower, and the signed sum 2a+b-(c+2d)."""
    ranks = _ranks(spark, d).select(F.col("team").alias("opp"), F.col("official_rank").alias("r"))
    rows = match_sides(spark, d).join(ranks, "opp")
    n = lambda won, low, high: F.count_if((F.col("won") == won) & F.col("r").between(low, high))
    out = rows.groupBy("team").agg(n(1, 1, 25).alias("wins_1_25"), n(1, 26, 50).alias("wins_26_50"), n(0, 61, 85).alias("losses_61_85"), n(0, 86, 1 << 30).alias("losses_86_up"))
    return out.withColumn("signed", 2 * F.col("wins_1_25") + F.col("wins_26_50") - (F.col("losses_61_85") + 2 * F.col("losses_86_up")))


def group_means_by_sign(spark, d):
    rows = _ranks(spark, d).select(F.signum("delta").cast("long").alias("sign"), F.col("wp"))
    return rows.groupBy("sign").agg(F.count("*").alias("teams"), F.round(F.avg("wp"), 6).alias("mean_wp"))


def pearson(spark, d):
    out = _ranks(spark, d).agg(F.coalesce(F.corr(F.col("delta").cast("double"), "wp"), F.lit(0.0)).alias("r"))
    return out.select(F.round("r", 6).alias("pearson"))


QUERIES = [match_sides, member_records, team_totals, reconcile_records, reconcile_largest, date_split, conference_records, last_day_games, appearance_rounds, chrono_cut_dates,
           membership_resolve, data_through, rank_agreement, rank_delta_top, marquee_profile, group_means_by_sign, pearson]


def oracle(rpi: str) -> dict[str, str]:
    """rpi: the WITH clause that defines r and k (ranks)."""
    rec = "(SELECT team, sum(won)::BIGINT AS wins, (count(*) - sum(won))::BIGINT AS losses FROM {} GROUP BY team)"
    mem = "(SELECT ms.* FROM ms JOIN team t USING (team) JOIN team o ON o.team = ms.opp WHERE t.is_member AND o.is_member)"
    reconciled = f"""SELECT team, d.wins AS d_wins, d.losses AS d_losses, o.wins AS o_wins, o.losses AS o_losses,
CASE WHEN d.wins IS NULL THEN 'only official' WHEN o.wins IS NULL THEN 'only derived' WHEN d.wins = o.wins AND d.losses = o.losses THEN 'matched' ELSE 'mismatched' END AS status,
d.wins - o.wins AS delta_wins, d.losses - o.losses AS delta_losses FROM {rec.format(mem)} d FULL JOIN {rec.format("(SELECT * FROM ms WHERE NOT championship)")} o USING (team)"""
    x = f"WITH {GAMEX}, {TEAM} "
    ranks = f"WITH {rpi.replace('WITH ', '')}, {TEAM}, d AS (SELECT k.*, official_rank, official_rank - rank AS delta FROM k LEFT JOIN team USING (team))"

    return {
        "match_sides": x + "SELECT * FROM ms",
        "member_records": x + f"SELECT * FROM {rec.format(mem)}",
        "team_totals": x + """SELECT ms.team, count(*) AS games, count_if(o.is_member AND won = 1)::BIGINT AS member_wins, count_if(o.is_member AND won = 0)::BIGINT AS member_losses,
count_if(NOT o.is_member AND won = 1)::BIGINT AS other_wins, count_if(NOT o.is_member AND won = 0)::BIGINT AS other_losses, sum(sets)::BIGINT AS sets, sum(pf) AS points_for, sum(pa) AS points_against,
round(avg(o.is_member::INT), 6) AS member_share FROM ms JOIN team o ON o.team = ms.opp GROUP BY ms.team""",
        "reconcile_records": x + reconciled,
        "reconcile_largest": x + f"SELECT team, abs(delta_wins + delta_losses) AS size, d_wins + d_losses AS games FROM ({reconciled}) WHERE status = 'mismatched' ORDER BY size DESC, games DESC, team LIMIT 60",
        "date_split": x + f"SELECT CASE WHEN date < DATE '{CUTOFF}' THEN 'before' ELSE 'after' END AS part, championship, count(*) AS games FROM m GROUP BY ALL",
        "conference_records": x + """SELECT t.conference, ms.team, sum(won)::BIGINT AS wins, (count(*) - sum(won))::BIGINT AS losses, round(sum(won) / count(*), 6) AS pct
FROM ms JOIN team t USING (team) JOIN team o ON o.team = ms.opp AND o.conference = t.conference GROUP BY ALL""",
        "last_day_games": x + """, c AS (SELECT t.conference, gid, ms.team AS winner, date FROM ms JOIN team t USING (team) JOIN team o ON o.team = ms.opp AND o.conference = t.conference WHERE won = 1)
SELECT conference, gid, winner, date::VARCHAR AS date FROM c WHERE date = (SELECT max(date) FROM c e WHERE e.conference = c.conference)""",
        "appearance_rounds": x + "SELECT gid, max(n) - 1 AS round FROM (SELECT gid, row_number() OVER (PARTITION BY team ORDER BY date, gid) AS n FROM ms) GROUP BY gid",
        "chrono_cut_dates": x + ", s AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM m) SELECT DISTINCT date::VARCHAR AS date FROM s WHERE i IN (floor(.55 * (n - 1)), floor(.7 * (n - 1)), floor(.85 * (n - 1)))",
        "membership_resolve": "SELECT 'official' AS source, count(*) AS teams FROM supplier WHERE s_acctbal >= 0",
        "data_through": x + "SELECT max(date)::VARCHAR AS data_through, count(*) AS games FROM m",
        "rank_agreement": ranks + " SELECT count(*) AS teams, count_if(delta = 0)::BIGINT AS exact, count_if(abs(delta) <= 3)::BIGINT AS within3, count_if(abs(delta) <= 10)::BIGINT AS within10, round(avg(abs(delta)), 6) AS mean_abs FROM d",
        "rank_delta_top": ranks + " SELECT team, delta FROM d ORDER BY abs(delta) DESC NULLS LAST, team LIMIT 16",
        "marquee_profile": ranks + """, b AS (SELECT s.team, count_if(w = 1 AND official_rank <= 25)::BIGINT AS wins_1_25, count_if(w = 1 AND official_rank BETWEEN 26 AND 50)::BIGINT AS wins_26_50,
count_if(w = 0 AND official_rank BETWEEN 61 AND 85)::BIGINT AS losses_61_85, count_if(w = 0 AND official_rank > 85)::BIGINT AS losses_86_up FROM side2 s JOIN d ON d.team = s.opp GROUP BY s.team)
SELECT *, 2 * wins_1_25 + wins_26_50 - (losses_61_85 + 2 * losses_86_up) AS signed FROM b""",
        "group_means_by_sign": ranks + " SELECT sign(delta)::BIGINT AS sign, count(*) AS teams, round(avg(wp), 6) AS mean_wp FROM d GROUP BY ALL",
        "pearson": ranks + " SELECT round(coalesce(corr(delta, wp), 0), 6) AS pearson FROM d",
    }
