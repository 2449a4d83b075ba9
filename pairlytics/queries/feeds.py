"""Nested feeds and upserts. The feeds are JSON made of the order tables, with the variants and faults that real ones have."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage
from ..sources import payloads
from ..sources.pairwise import games, table
from ..streaming import snapshots


def _lines(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gid"), F.col("l_suppkey").alias("team"), F.col("l_partkey").alias("pk"), F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("flag"))


def _base(spark, d):
    g = games(spark, d)
    at_home = F.col("gid") % 2 == 0
    return lineage.stored(g.withColumn("home", F.when(at_home, F.col("team_a")).otherwise(F.col("team_b"))))  # read by each join of a feed


def _faulty(body):
    """No payload, a torn one, or one without a contest, by game; else the body and, for some, a second contest."""
    gid = F.col("gid")
    decoy = F.concat(F.expr("left(body, length(body) - 2)"), F.lit(',{"gameState":"P","teams":[]}]}'))
    return F.when(gid % 17 == 0, None).when(gid % 13 == 0, F.expr("left(body, length(body) - 3)")).when(gid % 7 == 0, '{"contests":[]}').when(gid % 11 == 0, decoy).otherwise(body)


def _game_payloads(spark, d, g=None):
    """(game_id, payload) of two-sided orders: a set per line, whose other side has half the score, a dash or none."""
    g = _base(spark, d) if g is None else g
    q, other = F.col("q").cast("string"), F.when(F.col("pk") % 4 == 0, "-").when(F.col("pk") % 4 > 1, F.floor(F.col("q") / 2).cast("string"))
    mine = F.col("team") == F.col("home")
    score = F.struct(F.col("pk").cast("string").alias("period"), F.when(mine, q).otherwise(other).alias("home"), F.when(mine, other).otherwise(q).alias("visit"))
    sets = _lines(spark, d).join(g.select("gid", "home"), "gid").groupBy("gid").agg(F.collect_list(score).alias("linescores"))  # the lines of one order
    team = lambda me, won: F.struct(F.col(me).alias("teamId"), F.concat(F.lit("s-"), F.col(me)).alias("nameShort"), (F.col(me) == F.col("home")).alias("isHome"), won.alias("isWinner"))
    epoch = F.datediff("date", F.lit("1970-01-01")).cast("long") * 86400 + 3600
    teams = F.array(team("team_a", F.col("points_a") > F.col("points_b")), team("team_b", F.col("points_b") > F.col("points_a")))
    one = F.struct(F.year("date").alias("seasonYear"), F.col("game_state").alias("gameState"), epoch.cast("string").alias("startTimeEpoch"), "championship", teams.alias("teams"), "linescores")
    body = g.join(sets, "gid").select("gid", F.to_json(F.struct(F.array(one).alias("contests"))).alias("body"))
    return body.select(F.col("gid").cast("string").alias("game_id"), _faulty(F.col("body")).alias("payload"))


def _box_payloads(spark, d, g=None):
    """(game_id, payload) of two-sided orders: stats and players of both sides, every fifth game only of the first."""
    g = (_base(spark, d) if g is None else g).select("gid", "team_a", "team_b", "home")
    player = F.struct(
        F.when(F.col("pk") % 9 != 0, F.col("flag") != "R").alias("participated"), F.lit("P").alias("firstName"), F.col("pk").cast("string").alias("lastName"), F.col("q").cast("string").alias("kills"),
    )
    text = lambda c: F.sum(c).cast("string")
    kills, errors = F.when(F.col("flag") == "N", F.col("q")), F.when(F.col("flag") == "R", F.col("q"))
    per = _lines(spark, d).join(g, "gid").groupBy("gid", "team", "team_a", "team_b", "home").agg(text(kills).alias("kills"), text(errors).alias("errors"), text("q").alias("attempts"), F.collect_list(player).alias("playerStats"))
    stats = F.create_map(F.lit("__typename"), F.lit("Stats"), *[x for c in ("kills", "errors", "attempts") for x in (F.lit(c), F.col(c))])
    box = per.select("gid", "team_a", "team_b", "home", F.struct(F.col("team").alias("teamId"), stats.alias("teamStats"), "playerStats").alias("b"), (F.col("team") == F.col("team_b")).alias("second"))
    meta = F.array(*[F.struct(F.col(c).alias("teamId"), F.concat(F.lit("s-"), F.col(c)).alias("nameShort"), (F.col(c) == F.col("home")).alias("isHome")) for c in ("team_a", "team_b")])
    kept = box.where("gid % 5 <> 0 OR NOT second").groupBy("gid", "team_a", "team_b", "home").agg(F.collect_list("b").alias("teamBoxscore"))  # at most two
    return kept.select(F.col("gid").cast("string").alias("game_id"), F.to_json(F.struct(meta.alias("teams"), "teamBoxscore")).alias("payload"))


def payload_games(spark, d):
    strict, lenient = payloads.folded(F.col("linescores"), True), payloads.folded(F.col("linescores"), False)
    out = payloads.game_records(_game_payloads(spark, d)).withColumns({"s": strict, "l": lenient, "day": payloads.names.utc_date(F.col("start_time_epoch"))})
    return out.select(
        "game_id", F.col("day").cast("string").alias("day"), "season_year", "game_state", "championship", F.size("teams").cast("long").alias("n_teams"), F.col("l.home").alias("home_points"),
        F.col("l.visit").alias("visit_points"), F.col("l.sets").alias("sets"), F.col("s.home").alias("strict_home"), F.col("s.visit").alias("strict_visit"), F.col("s.sets").alias("strict_sets"),
    )


def dead_letters(spark, d):
    return payloads.dead_letters(_game_payloads(spark, d))


def _sides(spark, d):
    g = _base(spark, d)
    return payloads.match_sides(payloads.game_records(_game_payloads(spark, d, g)), payloads.team_boxes(_box_payloads(spark, d, g)))


def payload_sides(spark, d):
    return _sides(spark, d).select("game_id", "team_id", "opp_id", "won", "home", "pf", "pa", "sets", F.col("stats").isNotNull().alias("boxed"), F.col("opp_stats").isNotNull().alias("opp_boxed"))


def payload_box_totals(spark, d):
    return payloads.own_and_opponent(_sides(spark, d), ["kills", "errors", "attempts"])


def payload_players(spark, d):
    p = payloads.player_rows(_box_payloads(spark, d))
    return p.groupBy("team_id").agg(F.count("*").alias("n"), F.count_distinct("game_id").alias("n_games"), F.sum(F.col("kills").cast("long")).alias("kills"))


def payload_box_teams(spark, d):
    b = payloads.team_boxes(_box_payloads(spark, d))
    return b.select("game_id", "team_id", "name_short", "is_home", F.array_join(F.array_sort(F.map_keys(F.map_filter("stats", lambda _, v: v.isNotNull()))), ",").alias("fields"))


TODAY = "1997-06-01"


def schedule_first_days(spark, d):
    """Orders listed on the first of their month, every fourth again a month later; wrapped or bare, under either name of the id, some without one."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("gid"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("day"))
    days = F.when(F.col("gid") % 4 == 0, F.array("day", F.add_months("day", 1))).otherwise(F.array("day"))
    listed = o.select("gid", F.explode(days).alias("day"))
    text, none = F.col("gid").cast("string"), F.lit(None).cast("string")
    named = lambda r: F.struct(F.when(F.col("gid") % 6 == r, text).otherwise(none).alias("gameID"), F.when(F.col("gid") % 6 == r + 1, text).otherwise(none).alias("id"))
    bare = named(2)
    game = F.struct(F.when(F.col("gid") % 6 < 2, named(0)).alias("game"), bare["gameID"].alias("gameID"), bare["id"].alias("id"))
    texts = listed.groupBy("day", F.floor(F.col("gid") / 10000).alias("chunk")).agg(F.to_json(F.struct(F.collect_list(game).alias("games"))).alias("value"))  # at most 10,000 a text
    path = lineage.folder(spark)
    texts.select("day", "value").write.partitionBy("day").text(path)
    return payloads.schedule_ids(spark, path, F.lit(TODAY).cast("date"), whole=False).select("game_id", F.col("day").cast("string").alias("day"))


EVENT = "event_id long, user_id long, event_type string, final boolean"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", F.col("user_id").cast("long").alias("user_id"), "event_type", (F.col("event_type") == "purchase").alias("final"))


def upsert_stream(spark, d):
    """The events as an append-only log of JSON lines that grows three times, torn lines in between; each time the stream is started again."""
    log, into = lineage.folder(spark), snapshots.SnapshotTable(spark, lineage.folder(spark), EVENT, "user_id", "final", "event_id", 8)
    checkpoint = lineage.folder(spark)
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "final"))
    lines = _events(spark, d).select(F.pmod(F.hash("event_id"), F.lit(3)).alias("part"), F.explode(F.when(F.col("event_id") % 50 == 0, F.array(line, F.substring(line, 1, 20))).otherwise(F.array(line))).alias("value"))
    for part in range(3):
        lines.where(F.col("part") == part).select("value").write.mode("append").text(log)
        stream = spark.readStream.text(log).select(F.from_json("value", EVENT).alias("r")).select("r.*")
        snapshots.upsert(stream, into, checkpoint).awaitTermination()
    return into.read().select("user_id", "event_id", "event_type")


def snapshot_versions(spark, d):
    """Versions of a table of the events: merged in two parts, a worse replacement refused, repaired twice, stamped twice."""
    t = snapshots.SnapshotTable(spark, lineage.folder(spark), EVENT, "event_id", "final", "event_id", 8)
    e = _events(spark, d)
    t.merge(e.where("event_type <> 'click'"))
    now = t.merge(e)
    refused = []
    try:
        t.replace(e.where("NOT final"))
    except snapshots.Refused:
        refused = [(now["version"], "refused", now["rows"], now["finals"])]
    for _ in range(2):
        t.repair(lambda df: df.withColumn("event_type", F.upper("event_type")))
        t.stamp(checked=True)
    return spark.createDataFrame([(p["version"], p["action"], p["rows"], p["finals"]) for p in t.history()] + refused, "version long, action string, n_rows long, n_finals long")


QUERIES = [payload_games, dead_letters, payload_sides, payload_box_totals, payload_players, payload_box_teams, schedule_first_days, upsert_stream, snapshot_versions]

FEED = """ln AS (SELECT l_orderkey AS gid, l_suppkey AS team, l_partkey AS pk, l_quantity::BIGINT AS q, l_returnflag AS flag FROM lineitem),
sd AS (SELECT gid, team, sum(q)::BIGINT AS pts FROM ln GROUP BY ALL), tw AS (SELECT gid, min(team) AS a, max(team) AS b FROM sd GROUP BY gid HAVING count(*) = 2),
gm AS (SELECT tw.*, x.pts AS pa, y.pts AS pb, CASE WHEN gid % 2 = 0 THEN a ELSE b END AS home, o_orderstatus AS state, o_orderdate::DATE AS date, o_orderpriority = '1-URGENT' AS championship
FROM tw JOIN sd x USING (gid) JOIN sd y USING (gid) JOIN orders ON o_orderkey = gid WHERE x.team = a AND y.team = b),
ok AS (SELECT * FROM gm WHERE gid % 17 <> 0 AND gid % 13 <> 0 AND gid % 7 <> 0),
sc AS (SELECT gid, team = home AS mine, q, CASE WHEN pk % 4 > 1 THEN q // 2 END AS o FROM ok JOIN ln USING (gid)),
fo AS (SELECT gid, sum(CASE WHEN mine THEN q ELSE coalesce(o, 0) END)::BIGINT AS hp, sum(CASE WHEN mine THEN coalesce(o, 0) ELSE q END)::BIGINT AS vp, count(*) AS n,
coalesce(sum(CASE WHEN mine THEN q ELSE o END) FILTER (o IS NOT NULL), 0)::BIGINT AS shp, coalesce(sum(CASE WHEN mine THEN o ELSE q END) FILTER (o IS NOT NULL), 0)::BIGINT AS svp, count(o) AS sn FROM sc GROUP BY gid),
bx AS (SELECT gid, team, a, b, gm.home, sum(q)::BIGINT AS attempts, coalesce(sum(q) FILTER (flag = 'N'), 0)::BIGINT AS kills, coalesce(sum(q) FILTER (flag = 'R'), 0)::BIGINT AS errors,
count(*) FILTER (flag = 'N') AS nn, count(*) FILTER (flag = 'R') AS nr FROM gm JOIN ln USING (gid) WHERE gid % 5 <> 0 OR team = a GROUP BY ALL),
si AS (SELECT gid, unnest([a, b]) AS team, unnest([b, a]) AS opp, unnest([pa > pb, pb > pa]) AS won, home, hp, vp, n FROM ok JOIN fo USING (gid) WHERE state = 'F' AND pa <> pb)"""


def oracle(rpi: str) -> dict[str, str]:
    """rpi isn't used here."""
    best = "row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, event_id DESC)"
    counts = "count(*) AS n_rows, count_if(event_type = 'purchase')::BIGINT AS n_finals FROM events"
    return {
        "payload_games": f"""WITH {FEED} SELECT gid::VARCHAR AS game_id, date::VARCHAR AS day, year(date)::INT AS season_year, state AS game_state, championship, 2::BIGINT AS n_teams, hp AS home_points,
vp AS visit_points, n AS sets, shp AS strict_home, svp AS strict_visit, sn AS strict_sets FROM ok JOIN fo USING (gid)""",
        "dead_letters": f"""WITH {FEED} SELECT gid::VARCHAR AS game_id, CASE WHEN gid % 17 = 0 THEN 'missing' WHEN gid % 13 = 0 THEN 'not JSON' ELSE 'no contest' END AS reason
FROM gm WHERE gid % 17 = 0 OR gid % 13 = 0 OR gid % 7 = 0""",
        "payload_sides": f"""WITH {FEED} SELECT si.gid::VARCHAR AS game_id, si.team::VARCHAR AS team_id, opp::VARCHAR AS opp_id, won, si.team = si.home AS home, CASE WHEN si.team = si.home THEN hp ELSE vp END AS pf,
CASE WHEN si.team = si.home THEN vp ELSE hp END AS pa, n AS sets, x.gid IS NOT NULL AS boxed, y.gid IS NOT NULL AS opp_boxed
FROM si LEFT JOIN bx x ON x.gid = si.gid AND x.team = si.team LEFT JOIN bx y ON y.gid = si.gid AND y.team = si.opp""",
        "payload_box_totals": f"""WITH {FEED} SELECT si.team::VARCHAR AS team_id, count(*) AS boxed, sum(x.kills)::BIGINT AS kills, sum(y.kills)::BIGINT AS opp_kills, sum(x.errors)::BIGINT AS errors,
sum(y.errors)::BIGINT AS opp_errors, sum(x.attempts)::BIGINT AS attempts, sum(y.attempts)::BIGINT AS opp_attempts
FROM si JOIN bx x ON x.gid = si.gid AND x.team = si.team JOIN bx y ON y.gid = si.gid AND y.team = si.opp GROUP BY si.team""",
        "payload_players": f"""WITH {FEED} SELECT team::VARCHAR AS team_id, count(*) AS n, count(DISTINCT gid) AS n_games, sum(q)::BIGINT AS kills
FROM gm JOIN ln USING (gid) WHERE (gid % 5 <> 0 OR team = a) AND pk % 9 <> 0 AND flag <> 'R' GROUP BY team""",
        "payload_box_teams": f"""WITH {FEED} SELECT gid::VARCHAR AS game_id, team::VARCHAR AS team_id, 's-' || team AS name_short, team = home AS is_home,
concat_ws(',', 'attempts', CASE WHEN nr > 0 THEN 'errors' END, CASE WHEN nn > 0 THEN 'kills' END) AS fields FROM bx""",
        "schedule_first_days": f"""SELECT o_orderkey::VARCHAR AS game_id, date_trunc('month', o_orderdate)::DATE::VARCHAR AS day FROM orders WHERE o_orderkey % 6 < 4 AND date_trunc('month', o_orderdate) <= DATE '{TODAY}'""",
        "upsert_stream": f"SELECT user_id, event_id, event_type FROM (SELECT *, {best} AS n FROM events WHERE user_id IS NOT NULL) WHERE n = 1",
        "snapshot_versions": f"""SELECT 1::BIGINT AS version, 'merge' AS action, {counts} WHERE event_type <> 'click' UNION ALL SELECT 2, 'merge', {counts} UNION ALL SELECT 2, 'refused', {counts}
UNION ALL SELECT 3, 'repair', {counts} UNION ALL SELECT 4, 'stamp', {counts}""",
    }
