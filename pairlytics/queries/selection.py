"""Field, linkage, scalars, logs and gates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import field, gates, linkage, logs, ratings
from ..operators import matches as M
from ..operators.lineage import stored
from ..operators.ordering import ranked
from ..sources import pairwise
from ..sources.pairwise import table
from .evaluation import _rpi
from .records import GAMEX, conference_records, conferences, match_sides, matches, members, teams

SIZE, SEEDS = 24, 8
ACCENTS = ("aeioun", "áèîöüñ")


def conference_aq(spark, d):
    return field.qualifiers(conference_records(spark, d), ranked(_rpi(spark, d), "rpi", "team"))


def _barred(spark, d):
    return table(spark, d, "supplier").where("s_acctbal < 0 OR s_suppkey % 7 = 3").select(F.col("s_suppkey").alias("team"))


def conference_champions(spark, d):
    """Qualifiers by each conference's mechanism; every third nation has a season champion."""
    games = stored(pairwise.games(spark, d))
    ranks = ranked(ratings.rpi(pairwise.edges_of(games)), "rpi", "team")
    kinds = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("conference"), F.lit(field.SEASON).alias("mechanism"))
    return field.automatic(M.sides(M.decided(games)), conferences(spark, d), ranks, kinds, _barred(spark, d))


def championship_eligibility(spark, d):
    return field.eligibility(M.totals(match_sides(spark, d), members(spark, d)), _barred(spark, d))


def _field(spark, d):
    games = stored(pairwise.games(spark, d))
    edges, sides = pairwise.edges_of(games), M.sides(M.decided(games))
    ranks = stored(ranked(ratings.rpi(edges), "rpi", "team").select("team", "rank"))
    bands = ratings.bands(edges, ranks).select("team", "top25_wins", "top50_wins")
    auto = field.qualifiers(M.conference_records(sides, conferences(spark, d)).where("wins > losses").withColumn("pct", F.round("pct", 6)), ranks)
    return field.select(auto, stored(field.resume(ranks, bands)), field.gates(M.totals(sides, members(spark, d))), SIZE, SEEDS)


def seed_field(spark, d):
    return _field(spark, d)


def at_large_gates(spark, d):
    return field.gates(M.totals(match_sides(spark, d), members(spark, d)))


def field_backtest(spark, d):
    actual = match_sides(spark, d).where("championship").groupBy("team").agg(F.sum("won").alias("w")).where("w >= 3").select("team")
    return field.compared(_field(spark, d), actual)


def _people(spark, d, odd: int):
    """The parts of odd keys are a roster that writes names its own way: accents, a suffix, or a hyphen; those of even keys are the pool."""
    p = table(spark, d, "part").where(F.col("p_partkey") % 2 == odd)
    way = F.when(F.col("p_partkey") % 8 == 1, F.translate("p_name", *ACCENTS)).when(F.col("p_partkey") % 8 == 3, F.concat("p_name", F.lit(" Jr."))).when(F.col("p_partkey") % 8 == 5, F.replace("p_name", F.lit(" "), F.lit("-")))
    p = p.withColumn("p_name", F.coalesce(way, "p_name"))
    first, last = names.first_and_rest(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("team"), first.alias("first"), last.alias("last"), F.col("p_type").alias("year"), F.col("p_size").cast("double").alias("production"))


def roster_join_pass1(spark, d):
    out = linkage.exact_passes(_people(spark, d, 1), _people(spark, d, 0))
    return out.select("id", "pool_id", F.col("n").cast("long").alias("n"), "method")


def _linked(spark, d):
    roster, pool = (linkage.prepared(_people(spark, d, odd)) for odd in (1, 0))
    return roster, pool, stored(linkage.link(roster, pool))


def roster_join(spark, d):
    return _linked(spark, d)[2].groupBy("status", "why").agg(F.count("*").alias("n"))


def roster_links(spark, d):
    return _linked(spark, d)[2]


def unresolved_concentration(spark, d):
    return linkage.concentration(_linked(spark, d)[2])


def linkage_audit(spark, d):
    return linkage.audit(*_linked(spark, d))


def returning_share(spark, d):
    """Per team: production that returns, that departed, and its share; null where there is none."""
    pool = _people(spark, d, 0)
    linked = linkage.unique_pairs(linkage.exact_passes(_people(spark, d, 1), pool)).select(F.col("pool_id").alias("id"), F.lit(1).alias("r"))
    rows = pool.join(linked, "id", "left")
    out = rows.groupBy("team").agg(F.sum(F.when(F.col("r") == 1, F.col("production")).otherwise(0.0)).alias("returning"), F.sum(F.when(F.col("r").isNull(), F.col("production")).otherwise(0.0)).alias("departed"))
    return out.select("team", "returning", "departed", F.round(F.try_divide("returning", F.col("returning") + F.col("departed")), 6).alias("share"))


def top_departures(spark, d):
    """The two departed rows of most production of each team."""
    pool = _people(spark, d, 0)
    gone = linkage.departed(pool, linkage.unique_pairs(linkage.exact_passes(_people(spark, d, 1), pool)))
    place = F.row_number().over(Window.partitionBy("team").orderBy(F.desc("production"), "id"))  # limited before the shuffle
    return gone.select("team", "id", "production", place.alias("place")).where("place <= 2").drop("place")


def fuzzy_audit(spark, d):
    """The most similar unclaimed name of the own team, for each unresolved person."""
    roster, pool, linked = _linked(spark, d)
    left = roster.join(linked.where("status = 'UNRESOLVED'").select("id"), "id", "left_semi")
    return linkage.near_names(left, linkage.unclaimed(pool, linked)).withColumn("ratio", F.round("ratio", 4))


def _school():
    """Names in need of every rule: an abbreviation that applies and one that doesn't, an alias, apostrophes and marks."""
    key = F.col("s_suppkey")
    return F.when(key % 4 == 0, F.concat(F.lit(" St. "), "s_name", F.lit("'s & Co."))).when(key % 4 == 1, F.concat(F.lit("Northern Colo.St.#"), key.cast("string"))).when(key % 4 == 2, F.lit(" New  Orleans")).otherwise(F.concat(F.lit("N.C.A&T Miss.Tech "), "s_name"))


def name_norm(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), names.norm(_school()).alias("name"))


def name_keys(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.translate("p_name", *ACCENTS), F.when(F.col("p_partkey") % 2 == 0, " Jr.").otherwise("")).alias("n"))
    first, last = names.first_and_rest(F.col("n"))
    return p.select(F.col("p_partkey").alias("id"), names.narrow_key(first, last).alias("narrow"), names.whole_key(first, last).alias("whole"), F.size(names.tokens(F.col("n"))).cast("long").alias("n_tokens"))


def name_shapes(spark, d):
    n = lambda p: F.count_if(F.col("p_name").rlike(p))
    return table(spark, d, "part").agg(F.count("*").alias("n"), n("-").alias("hyphen"), n(r"(?i)\b(jr|sr|ii|iii|iv)\.?$").alias("suffix"), n(r"\S+\s+\S+\s+\S+").alias("three_parts"), n("'").alias("apostrophe"), n(r"[^\x00-\x7F]").alias("diacritic"))


def parse_record(spark, d):
    w, l = names.record(F.concat(F.col("s_suppkey").cast("string"), F.lit(" - "), (F.col("s_suppkey") % 7).cast("string"), F.lit(" (3-1)")))  # noqa: E741
    return table(spark, d, "supplier").select("s_suppkey", w.cast("long").alias("wins"), l.cast("long").alias("losses"))


def numeric_casts(spark, d):
    x = F.when(F.col("p_partkey") % 3 == 0, F.format_number(F.col("p_partkey") * 1000, 0)).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".7"))).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).otherwise("-")
    return table(spark, d, "part").select("p_partkey", names.number_or_null(x).cast("long").alias("or_null"), names.number_or_zero(x).cast("long").alias("or_zero"))


def text_mechanism(spark, d):
    kind = names.mechanism(F.col("text"), r"(?i)\b(the|of)\b", r"(?i)\b(and|is)\b")
    return table(spark, d, "documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def html_anchors(spark, d):
    links = F.regexp_extract_all("html", F.lit(r"<a [^>]*href=\"([^\"]*)\""), F.lit(1))
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("anchors"), F.coalesce(F.get(links, 0), F.lit("")).alias("first_link"), title.alias("title"))


def content_names(spark, d):
    safe = names.script_safe(F.col("html"))
    return table(spark, d, "pages").select("page_id", names.content_name(F.col("html")).alias("name"), F.md5(F.col("html").cast("binary")).alias("md5"), F.length(safe).cast("long").alias("safe_chars"))


def log_last_wins(spark, d):
    return logs.last_wins(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


def resume_todo_ids(spark, d):
    e = table(spark, d, "events")
    return logs.todo(e, logs.final_ids(e, "user_id", (F.col("event_type") == "purchase") & (F.col("event_id") % 11 == 0)), "user_id")


def first_seen_users(spark, d):
    return logs.first_seen(table(spark, d, "events"), "user_id", "event_id")


def freshness_settled_dates(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderstatus").where("date <= DATE '1997-06-01'")  # no future events
    out = logs.settled_dates(o, "date", F.col("o_orderstatus") == "F", F.to_date(F.lit("1997-06-01")))
    return out.select(F.col("date").cast("string").alias("date"), "n", "authoritative")


def range_rules(spark, d):
    return gates.out_of_range(table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey")), "id", {"l_quantity": (2, 49), "l_discount": (0, 0.09), "l_tax": (0, 0.08)})


def order_inversions(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return gates.inversions(o, "o_custkey", "o_orderkey", "o_totalprice").select("o_orderkey", "before")


def rank_permutation(spark, d):
    return gates.permutation(teams(spark, d), "official_rank")


def digest_equality(spark, d):
    return gates.digest(table(spark, d, "nation"), ["n_nationkey", "n_name"])


def freshness_sanity(spark, d):
    return gates.fresh(table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderdate").cast("string")).otherwise("soon").alias("t")), "t", F.to_timestamp(F.lit("1998-01-01 00:00:00")))


def matcher_validation(spark, d):
    m = matches(spark, d).join(_rpi(spark, d).select(F.col("team").alias("team_a"), F.col("rpi").alias("ra")), "team_a").join(_rpi(spark, d).select(F.col("team").alias("team_b"), F.col("rpi").alias("rb")), "team_b")
    return gates.validated(m.where("championship").select(F.when(F.col("ra") > F.col("rb"), 0).when(F.col("ra") < F.col("rb"), 1).alias("p"), "winner"), "p", "winner")


def player_season_totals(spark, d):
    """Totals of a player (team and letters of the name), with the most frequent spelling, ties by the alphabet."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("team"), names.letters(F.col("p_name")).alias("player"), "p_name", F.coalesce("p_size", F.lit(0)).alias("kills"), (F.col("p_partkey") % 5).alias("aces"), (F.col("p_partkey") % 3).alias("solos"), (F.col("p_partkey") % 4).alias("assists"))
    by = p.groupBy("team", "player", "p_name").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("kills", "aces", "solos", "assists")])
    name = F.min(F.struct((-F.col("n")).alias("o"), "p_name"))["p_name"]
    out = by.groupBy("team", "player").agg(name.alias("name"), F.sum("n").alias("games"), *[F.sum(c).cast("long").alias(c) for c in ("kills", "aces", "solos", "assists")])
    return out.withColumn("production", F.round(F.col("kills") + F.col("aces") + F.col("solos") + 0.5 * F.col("assists"), 1)).withColumn("per_set", F.round(F.col("production") / (3 * F.col("games")), 3))


def events_windowed(spark, d):
    """Extension: counts by hour and type."""
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("string").alias("start"), "event_type", "n")


QUERIES = [conference_aq, conference_champions, championship_eligibility, seed_field, at_large_gates, field_backtest, roster_join_pass1, roster_join, roster_links, unresolved_concentration, linkage_audit, returning_share, top_departures, fuzzy_audit, name_norm, name_keys, name_shapes, parse_record, numeric_casts, text_mechanism,
           html_anchors, content_names, log_last_wins, resume_todo_ids, first_seen_users, freshness_settled_dates, range_rules, order_inversions, rank_permutation, digest_equality, freshness_sanity, matcher_validation,
           player_season_totals, events_windowed]


def oracle(rpi: str) -> dict[str, str]:
    r = rpi.replace("WITH ", "")
    both = f"WITH {GAMEX}, edge AS (SELECT CASE WHEN points_a > points_b THEN team_a ELSE team_b END AS winner, CASE WHEN points_a > points_b THEN team_b ELSE team_a END AS loser, gid FROM m), {r[r.index('side2 AS'):]}"
    cr = """, ct AS (SELECT s_suppkey AS team, n_name AS conference, s_acctbal >= 0 AS is_member FROM supplier JOIN nation ON s_nationkey = n_nationkey),
cr AS (SELECT t.conference, ms.team, sum(won) AS wins, count(*) - sum(won) AS losses, round(sum(won) / count(*), 6) AS pct FROM ms JOIN ct t USING (team) JOIN ct c ON c.team = ms.opp AND c.conference = t.conference GROUP BY ALL)"""
    aq = "(SELECT conference, team FROM (SELECT *, row_number() OVER (PARTITION BY conference ORDER BY pct DESC, rank, team) AS i FROM cr JOIN k USING (team) {}) WHERE i = 1)"
    gate = """gt AS (SELECT ms.team, CASE WHEN sum(won) / count(*) < .5 THEN 'under .500' WHEN avg(o.is_member::INT) < .8 THEN 'schedule' ELSE '' END AS reason FROM ms JOIN ct o ON o.team = ms.opp GROUP BY 1)"""
    fld = f"""{cr}, {gate}, au AS (SELECT DISTINCT team FROM {aq.format('WHERE cr.wins > cr.losses')}), bd AS (SELECT s.team, count_if(k.rank <= 25 AND w = 1) AS t25, count_if(k.rank <= 50 AND w = 1) AS t50 FROM side2 s JOIN k ON k.team = s.opp GROUP BY 1),
rs AS (SELECT team, rank, rank - 2 * t25 - t50 AS score FROM k JOIN bd USING (team)), al AS (SELECT team FROM (SELECT team, row_number() OVER (ORDER BY score, team) AS i FROM rs JOIN gt USING (team) WHERE reason = '' AND team NOT IN (SELECT team FROM au)) WHERE i <= greatest(0, {SIZE} - (SELECT count(*) FROM au))),
bt AS (SELECT team, 'auto' AS bid FROM au UNION ALL SELECT team, 'at-large' FROM al), fl AS (SELECT team, bid, CASE WHEN i <= {SEEDS} THEN i END AS seed FROM (SELECT *, row_number() OVER (ORDER BY rank, team) AS i FROM bt JOIN rs USING (team)))"""
    accented = f"translate(p_name, '{ACCENTS[0]}', '{ACCENTS[1]}')"
    suffix = r"\b(jr|sr|ii|iii|iv|v)\.?$"
    letters = "regexp_replace(regexp_replace(strip_accents(lower({})), '" + suffix + "', ''), '[^a-z]', '', 'g')"
    narrow, whole = f"regexp_replace(strip_accents(lower(coalesce(first, ''))), '[^a-z]', '', 'g') || '|' || " + letters.format("coalesce(last, '')"), letters.format("concat_ws(' ', first, last)")
    people = f"""pn AS (SELECT *, CASE p_partkey % 8 WHEN 1 THEN {accented} WHEN 3 THEN p_name || ' Jr.' WHEN 5 THEN replace(p_name, ' ', '-') ELSE p_name END AS n FROM part),
pf AS (SELECT p_partkey AS id, p_brand AS team, split_part(n, ' ', 1) AS first, nullif(trim(regexp_replace(n, '^\\S*', '')), '') AS last, p_size::DOUBLE AS production FROM pn),
pe AS (SELECT *, concat_ws('|', first, last) AS k1, {narrow} AS k2, {whole} AS k3 FROM pf)"""
    step = "p{i} AS (SELECT pe.id, CASE WHEN n = 1 THEN pool_id END AS pool_id, n, '{name}' AS method FROM pe JOIN (SELECT team, k{i} AS k, count(*) AS n, min(id) AS pool_id FROM pe WHERE id % 2 = 0 GROUP BY ALL) q ON q.team = pe.team AND q.k = pe.k{i} WHERE pe.id % 2 = 1 AND length(pe.k{i}) > 1 {rest})"
    steps = ", ".join(step.format(i=i, name=n, rest="".join(f"AND pe.id NOT IN (SELECT id FROM p{j}) " for j in range(1, i))) for i, n in enumerate(("exact", "narrow", "whole"), 1))
    p1 = f"WITH {people}, {steps}, f AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3), u AS (SELECT pool_id AS id FROM f WHERE pool_id IS NOT NULL GROUP BY 1 HAVING count(*) = 1)"
    normed = "replace(replace(lower(trim(CASE s_suppkey % 4 WHEN 0 THEN ' St. ' || s_name || '''s & Co.' WHEN 1 THEN 'Northern Colo.St.#' || s_suppkey WHEN 2 THEN ' New  Orleans' ELSE 'N.C.A&T Miss.Tech ' || s_name END)), '&', ' and '), '''', '')"
    for short, long in names.ABBREVIATIONS:
        normed = f"regexp_replace({normed}, '{names.abbreviation(short)}', '{long}', 'g')"
    normed = f"trim(regexp_replace({normed}, '[^a-z0-9]+', ' ', 'g'))"
    scan = "row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)"
    return {
        "conference_aq": both + cr + f" SELECT conference, team FROM {aq.format('')}",
        "conference_champions": both + """, cf AS (SELECT s_suppkey AS team, n_name AS conference, CASE WHEN n_nationkey % 3 = 0 THEN 'REGULAR_SEASON' ELSE 'TOURNAMENT' END AS mechanism, s_acctbal < 0 OR s_suppkey % 7 = 3 AS barred FROM supplier JOIN nation ON s_nationkey = n_nationkey),
ci AS (SELECT a.conference, ms.team, gid, won, date FROM ms JOIN cf a USING (team) JOIN cf b ON b.team = ms.opp AND b.conference = a.conference), ld AS (SELECT * FROM ci QUALIFY date = max(date) OVER (PARTITION BY conference)),
cn AS (SELECT conference, count(DISTINCT gid) AS games FROM ld GROUP BY 1), cp AS (SELECT team, round(avg(won), 10) AS pct FROM ci GROUP BY 1),
cm AS (SELECT cf.*, coalesce(rank, 999) AS place, coalesce(pct, 0) AS pct, games, mechanism = 'REGULAR_SEASON' OR cf.team IN (SELECT team FROM ld WHERE won = 1) AS cand FROM cf LEFT JOIN k USING (team) LEFT JOIN cp USING (team) LEFT JOIN cn USING (conference)),
c1 AS (SELECT conference, team AS t1, barred AS b1 FROM cm WHERE cand AND games IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conference ORDER BY pct DESC, place, team) = 1),
c2 AS (SELECT conference, team AS t2 FROM cm WHERE NOT barred QUALIFY row_number() OVER (PARTITION BY conference ORDER BY place, team) = 1),
cx AS (SELECT DISTINCT conference, mechanism, games FROM cm), ch AS (SELECT *, CASE WHEN mechanism = 'REGULAR_SEASON' THEN 'best share' WHEN games = 1 THEN 'sole game of the last day' ELSE 'best of ' || games || ' games of the last day' END AS how FROM cx LEFT JOIN c1 USING (conference) LEFT JOIN c2 USING (conference))
SELECT conference, CASE WHEN t1 IS NULL THEN NULL WHEN b1 THEN t2 ELSE t1 END AS team, mechanism, CASE WHEN t1 IS NULL THEN 'no conference games' WHEN NOT b1 THEN how WHEN t2 IS NULL THEN 'champion ineligible, no eligible member' ELSE how || ', champion ineligible: bid passes' END AS note FROM ch""",
        "championship_eligibility": both + cr + f", {gate}, el AS (SELECT team, reason, s_acctbal < 0 OR s_suppkey % 7 = 3 AS barred FROM gt JOIN supplier ON s_suppkey = team) SELECT team, NOT barred AS championship, NOT barred AND reason = '' AS at_large, CASE WHEN barred THEN 'ineligible' WHEN reason <> '' THEN reason || ', at-large only' ELSE '' END AS reason FROM el",
        "seed_field": both + fld + " SELECT team, bid, seed FROM fl",
        "at_large_gates": both + cr + f", {gate} SELECT team, reason = '' AS at_large, reason FROM gt",
        "field_backtest": both + fld + ", ac AS (SELECT team FROM ms WHERE championship GROUP BY 1 HAVING sum(won) >= 3) SELECT CASE WHEN f.team IS NULL THEN 'missed' WHEN a.team IS NULL THEN 'wrong' ELSE 'hit' END AS outcome, count(*) AS n FROM fl f FULL JOIN ac a ON a.team = f.team GROUP BY 1",
        "roster_join_pass1": p1 + " SELECT * FROM f",
        "returning_share": p1 + ", x AS (SELECT team, sum(CASE WHEN u.id IS NOT NULL THEN production ELSE 0 END) AS ret, sum(CASE WHEN u.id IS NULL THEN production ELSE 0 END) AS departed FROM pe LEFT JOIN u ON u.id = pe.id WHERE pe.id % 2 = 0 GROUP BY 1) SELECT team, ret AS \"returning\", departed, round(ret / nullif(ret + departed, 0), 6) AS share FROM x",
        "top_departures": p1 + " SELECT team, id, production FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY production DESC, id) AS i FROM pe WHERE id % 2 = 0 AND production > 0 AND id NOT IN (SELECT id FROM u)) WHERE i <= 2",
        "name_norm": f"SELECT id, CASE n WHEN 'new orleans' THEN 'lsu new orleans' ELSE n END AS name FROM (SELECT s_suppkey AS id, {normed} AS n FROM supplier)",
        "name_keys": f"""WITH n AS (SELECT p_partkey AS id, {accented} || CASE WHEN p_partkey % 2 = 0 THEN ' Jr.' ELSE '' END AS n FROM part), s AS (SELECT id, split_part(n, ' ', 1) AS first, nullif(trim(regexp_replace(n, '^\\S*', '')), '') AS last, n FROM n)
SELECT id, {narrow} AS narrow, {whole} AS whole, len(list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(n)), '{suffix}', ''), '[^a-z]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM s""",
        "name_shapes": r"""SELECT count(*) AS n, count_if(contains(p_name, '-'))::BIGINT AS hyphen, count_if(regexp_matches(p_name, '(?i)\b(jr|sr|ii|iii|iv)\.?$'))::BIGINT AS suffix, count_if(regexp_matches(p_name, '\S+\s+\S+\s+\S+'))::BIGINT AS three_parts, count_if(contains(p_name, ''''))::BIGINT AS apostrophe, count_if(regexp_matches(p_name, '[^\x00-\x7F]'))::BIGINT AS diacritic FROM part""",
        "parse_record": "SELECT s_suppkey, s_suppkey::BIGINT AS wins, s_suppkey % 7 AS losses FROM supplier",
        "numeric_casts": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey * 1000 WHEN 1 THEN p_size::BIGINT WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN p_size::BIGINT END END AS or_null, CASE WHEN p_partkey % 6 = 2 THEN p_size::BIGINT ELSE 0 END AS or_zero FROM part",
        "text_mechanism": r"""SELECT CASE WHEN t AND s THEN 'AMBIGUOUS' WHEN t THEN 'TOURNAMENT' WHEN s THEN 'REGULAR_SEASON' END AS kind, count(*) AS n FROM (SELECT regexp_matches(text, '(?i)\b(the|of)\b') AS t, regexp_matches(text, '(?i)\b(and|is)\b') AS s FROM documents) GROUP BY 1""",
        "html_anchors": """SELECT page_id, len(l)::BIGINT AS anchors, coalesce(l[1], '') AS first_link, title FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)""",
        "content_names": "SELECT page_id, substr(sha1(html), 1, 12) AS name, md5(html) AS md5, length(replace(html, '</', '<\\/'))::BIGINT AS safe_chars FROM pages",
        "log_last_wins": f"SELECT user_id, event_id, event_type FROM (SELECT *, {scan} AS i FROM events WHERE user_id IS NOT NULL) WHERE i = 1",
        "resume_todo_ids": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 11 = 0 AND user_id IS NOT NULL)",
        "first_seen_users": "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1",
        "freshness_settled_dates": "SELECT o_orderdate::DATE::VARCHAR AS date, count(*) AS n, o_orderdate::DATE < DATE '1997-06-01' AND bool_and(o_orderstatus = 'F') AS authoritative FROM orders WHERE o_orderdate::DATE <= DATE '1997-06-01' GROUP BY o_orderdate::DATE",
        "range_rules": "SELECT id, field, value FROM (SELECT l_orderkey AS id, unnest([{'field': 'l_quantity', 'value': l_quantity, 'a': 2.0, 'b': 49.0}, {'field': 'l_discount', 'value': l_discount, 'a': 0.0, 'b': 0.09}, {'field': 'l_tax', 'value': l_tax, 'a': 0.0, 'b': 0.08}], recursive := true) FROM lineitem) WHERE value < a OR value > b",
        "order_inversions": "SELECT o_orderkey, before FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE o_totalprice < before",
        "rank_permutation": "SELECT count(*) AS n, true AS ok FROM supplier",
        "digest_equality": "SELECT count(*) AS n, sum(('0x' || substr(md5(n_nationkey || '|' || n_name), 1, 12))::BIGINT)::VARCHAR AS digest FROM nation",
        "freshness_sanity": "SELECT count(*) AS n, count_if(o_orderkey % 97 = 0)::BIGINT AS unparseable, count_if(o_orderkey % 97 <> 0 AND o_orderdate > TIMESTAMP '1998-01-01')::BIGINT AS future FROM orders",
        "matcher_validation": both + ", v AS (SELECT (a.rpi > b.rpi) = (points_a > points_b) AS ok FROM m JOIN r a ON a.team = team_a JOIN r b ON b.team = team_b WHERE championship AND a.rpi <> b.rpi) SELECT count(*) AS decided, count_if(ok)::BIGINT AS correct, count(*) >= 3 AND count_if(ok) = count(*) AS usable FROM v",
        "player_season_totals": """WITH p AS (SELECT p_brand AS team, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS player, p_name, count(*) AS n, sum(p_size) AS kills, sum(p_partkey % 5) AS aces, sum(p_partkey % 3) AS solos, sum(p_partkey % 4) AS assists FROM part GROUP BY ALL),
q AS (SELECT team, player, arg_min(p_name, (-n, p_name)) AS name, sum(n)::BIGINT AS games, sum(kills)::BIGINT AS kills, sum(aces)::BIGINT AS aces, sum(solos)::BIGINT AS solos, sum(assists)::BIGINT AS assists FROM p GROUP BY ALL)
SELECT *, round(kills + aces + solos + .5::DOUBLE * assists, 1) AS production, round(round(kills + aces + solos + .5::DOUBLE * assists, 1) / (3 * games), 3) AS per_set FROM q""",
        "events_windowed": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    }
