"""Every registered query of the library and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import leaderboards, logs, ratings
from .sources import pairwise
from .queries import evaluation as _evaluation
from .queries import feeds as _feeds
from .queries import records as _records
from .queries import selection as _selection
from .queries import sources as _sources
from .sources.pairwise import EDGE, SIDE, table

AREAS = [_records, _evaluation, _selection, _feeds, _sources]


def _long(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def team_records(spark, d):
    return _long(ratings.records(pairwise.edges(spark, d)), "wins", "losses")


def head_to_head(spark, d):
    return ratings.head_to_head(pairwise.edges(spark, d))


def bad_shape_counts(spark, d):
    n = F.when(F.col("n") == 2, "two sides").when(F.col("n") < 2, "fewer").otherwise("more")
    return pairwise.shapes(spark, d).groupBy(n.alias("shape")).agg(F.count("*").alias("games"))


def rpi(spark, d):
    out = ratings.rpi(pairwise.edges(spark, d))
    return out.select("team", *[F.round(c, 6).alias(c) for c in ("wp", "owp", "oowp", "rpi")])


def rpi_ranked(spark, d):
    out = ratings.ranked(ratings.rpi(pairwise.edges(spark, d)), "rpi", "team")
    return out.select("team", F.col("wins").cast("long").alias("wins"), F.col("losses").cast("long").alias("losses"), F.round("rpi", 6).alias("rpi"), F.col("rank").cast("long").alias("rank"))


def sos_rank(spark, d):
    out = ratings.ranked(ratings.rpi(pairwise.edges(spark, d)), "owp", "team")
    return out.select("team", F.round("owp", 6).alias("owp"), F.col("rank").cast("long").alias("sos_rank"))


def resume_top_bands(spark, d):
    edges = pairwise.edges(spark, d)
    out = ratings.bands(edges, ratings.ranked(ratings.rpi(edges), "rpi", "team"))
    return _long(out, *[c for c in out.columns if c != "team"])


def spearman(spark, d):
    rank = ratings.ranked(ratings.rpi(pairwise.edges(spark, d)), "rpi", "team", "derived")
    official = ratings.ranked(table(spark, d, "supplier").select(F.col("s_suppkey").alias("team"), "s_acctbal"), "s_acctbal", "team", "official")
    both = rank.join(official, "team")
    return both.agg(F.count("*").alias("teams"), F.round(F.corr("derived", "official"), 6).alias("spearman"))


def log_dedupe_final_wins(spark, d):
    out = logs.dedupe_final_wins(table(spark, d, "events"), "user_id", F.col("event_type") == "purchase", "event_id")
    return out.select("user_id", "event_id", "event_type")


def field_conflicts(spark, d):
    return logs.conflicts(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_quantity")


def leaderboard_merge(spark, d):
    """Three boards of the lines by flag; the tax is a field of all of them, quantity one of each."""
    lines = table(spark, d, "lineitem").withColumn("page", F.struct("l_orderkey", "l_linenumber"))
    board = lambda flag, name: lines.where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("team"), "page", F.col("l_quantity").alias(name), F.col("l_tax").alias("tax"))
    out = leaderboards.merged([board("A", "aces"), board("N", "kills"), board("R", "errors")], "team", "page")
    return out.select("team", "aces", "errors", "kills", "tax", F.array_join("conflicts", ",").alias("conflicts"))


def metric_auc(spark, d):
    both = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    out = logs.auc(both, "n_chars", "quality")
    return out.select(F.col("n").cast("long").alias("n"), F.col("positives").cast("long").alias("positives"), F.round("auc", 6).alias("auc"))


def queries() -> dict:
    all_ = (team_records, head_to_head, bad_shape_counts, rpi, rpi_ranked, sos_rank, resume_top_bands, spearman, log_dedupe_final_wins, field_conflicts, leaderboard_merge, metric_auc)
    return {f.__name__: f for f in [*all_, *(q for area in AREAS for q in area.QUERIES)]}


RPI = f"""{EDGE}, side2 AS (SELECT winner AS team, loser AS opp, 1 AS w FROM edge UNION ALL SELECT loser, winner, 0 FROM edge),
tot AS (SELECT team, sum(w)::BIGINT AS wins, (count(*) - sum(w))::BIGINT AS losses FROM side2 GROUP BY team),
ex AS (SELECT g.team, g.opp, (SELECT coalesce(avg(w), 0.0) FROM side2 o WHERE o.team = g.opp AND o.opp <> g.team) AS p FROM side2 g),
o AS (SELECT team, avg(p) AS owp FROM ex GROUP BY team), oo AS (SELECT s.team, avg(owp) AS oowp FROM side2 s JOIN o ON o.team = s.opp GROUP BY s.team),
r AS (SELECT team, wins, losses, wins / (wins + losses) AS wp, owp, oowp, .25 * wins / (wins + losses) + .5 * owp + .25 * oowp AS rpi FROM tot JOIN o USING (team) JOIN oo USING (team)),
k AS (SELECT *, row_number() OVER (ORDER BY round(rpi, 10) DESC, team) AS rank FROM r)"""


def oracle_sql() -> dict:
    found = {
        "team_records": f"WITH {EDGE} SELECT team, sum(w)::BIGINT AS wins, (count(*) - sum(w))::BIGINT AS losses FROM (SELECT winner AS team, 1 AS w FROM edge UNION ALL SELECT loser, 0 FROM edge) GROUP BY team",
        "head_to_head": f"WITH {EDGE} SELECT winner, loser, count(*) AS n FROM edge GROUP BY ALL",
        "bad_shape_counts": f"WITH {SIDE} SELECT shape, count(*) AS games FROM (SELECT CASE WHEN count(*) = 2 THEN 'two sides' WHEN count(*) < 2 THEN 'fewer' ELSE 'more' END AS shape FROM side GROUP BY gid) GROUP BY shape",
        "rpi": f"WITH {RPI} SELECT team, round(wp, 6) AS wp, round(owp, 6) AS owp, round(oowp, 6) AS oowp, round(rpi, 6) AS rpi FROM r",
        "rpi_ranked": f"WITH {RPI} SELECT team, wins, losses, round(rpi, 6) AS rpi, rank FROM k",
        "sos_rank": f"WITH {RPI} SELECT team, round(owp, 6) AS owp, row_number() OVER (ORDER BY round(owp, 10) DESC, team) AS sos_rank FROM r",
        "resume_top_bands": f"""WITH {RPI} SELECT s.team, count_if(rank <= 25 AND w = 1)::BIGINT AS top25_wins, count_if(rank <= 25 AND w = 0)::BIGINT AS top25_losses,
count_if(rank <= 50 AND w = 1)::BIGINT AS top50_wins, count_if(rank <= 50 AND w = 0)::BIGINT AS top50_losses FROM side2 s JOIN k ON k.team = s.opp GROUP BY s.team""",
        "spearman": f"""WITH {RPI}, f AS (SELECT s_suppkey AS team, row_number() OVER (ORDER BY round(s_acctbal, 10) DESC, s_suppkey) AS official FROM supplier)
SELECT count(*) AS teams, round(corr(rank, official), 6) AS spearman FROM k JOIN f USING (team)""",
        "log_dedupe_final_wins": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, event_id DESC) AS n FROM events WHERE user_id IS NOT NULL) WHERE n = 1",
        "field_conflicts": "SELECT l_orderkey, l_linenumber, count(DISTINCT l_quantity) AS n_values FROM lineitem GROUP BY ALL HAVING n_values > 1",
        "leaderboard_merge": """WITH x AS (SELECT l_suppkey AS team, l_returnflag AS f, l_quantity AS q, l_tax AS t, {'o': l_orderkey, 'l': l_linenumber, 'v': l_quantity} AS byq, {'o': l_orderkey, 'l': l_linenumber, 'v': l_tax} AS byt
FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R'))
SELECT team, (max(byq) FILTER (f = 'A'))['v'] AS aces, (max(byq) FILTER (f = 'R'))['v'] AS errors, (max(byq) FILTER (f = 'N'))['v'] AS kills, max(byt)['v'] AS tax,
concat_ws(',', CASE WHEN count(DISTINCT q) FILTER (f = 'A') > 1 THEN 'aces' END, CASE WHEN count(DISTINCT q) FILTER (f = 'R') > 1 THEN 'errors' END,
CASE WHEN count(DISTINCT q) FILTER (f = 'N') > 1 THEN 'kills' END, CASE WHEN count(DISTINCT t) > 1 THEN 'tax' END) AS conflicts FROM x GROUP BY team""",
        "metric_auc": """WITH s AS (SELECT n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT x, sum(y) AS p, sum(1 - y) AS q FROM s GROUP BY x),
b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT (sum(p) + sum(q))::BIGINT AS n, sum(p)::BIGINT AS positives, round(sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0), 6) AS auc FROM b""",
    }
    for area in AREAS:
        found |= area.oracle(RPI)
    return found
