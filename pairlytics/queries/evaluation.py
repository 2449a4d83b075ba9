"""Ratings, their evaluation and simulation."""

from math import comb

from pyspark.sql import functions as F

from ..operators import adjustment, bracket, metrics, models, probability, ratings, splits
from ..operators import matches as M
from ..operators.lineage import stored
from ..operators.logs import auc
from ..operators.ordering import ranked
from ..sources import pairwise
from ..sources.pairwise import table
from .records import GAMEX, match_sides, matches, members, teams

TRIALS, RESAMPLES, SLOTS = 20_000, 600, (1, 8, 4, 5, 2, 7, 3, 6)
DEPTH = 12  # rounds that the SQL of the bracket spells out


def _games(spark, d):
    """All games, written once for a query that reads them in several places: lines and orders are read a single time."""
    return stored(pairwise.games(spark, d))


def _rpi(spark, d):
    return _rpi_of(pairwise.games(spark, d))


def _rpi_of(games):
    return ratings.rpi(pairwise.edges_of(games)).select("team", "wp", "owp", "rpi")


def _margins(spark, d):
    return _margins_of(pairwise.games(spark, d))


def _margins_of(games):
    return M.sides(M.decided(games)).groupBy("team").agg((F.sum(F.col("pf") - F.col("pa")) / F.sum("sets")).alias("margin"))


def net_points_raw(spark, d):
    return _margins(spark, d).select("team", F.round("margin", 6).alias("margin"))


def box_rates(spark, d):
    l = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("team"))  # noqa: E741
    of = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0))
    out = l.agg(of("N").alias("kills"), of("R").alias("errors"), F.sum("l_quantity").alias("attempts"), F.sum(F.round(F.col("l_discount") * 100)).alias("reception_errors"))
    return out.select("team", "kills", "errors", "attempts", F.round(F.try_divide(F.col("kills") - F.col("errors"), F.col("attempts")), 6).alias("hit_eff"), F.round(F.try_divide("reception_errors", "attempts"), 6).alias("reception"))


def opponent_adjusted(spark, d):
    """Points of a match, adjusted: offence and defence together."""
    out = adjustment.solve(match_sides(spark, d).select("team", "opp", "home", F.col("pf").alias("points")), ["points"])
    return out.select("team", F.round(F.col("points_off") + F.col("points_def"), 6).alias("adjusted"), F.col("points_n").alias("games"))


def _boxes(spark, d):
    """(gid, team, counts) of the sides that have a line which isn't returned as A."""
    of = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("gid"), F.col("l_suppkey").alias("team"))
    out = lines.agg(of("N").alias("kills"), of("R").alias("errors"), F.sum("l_quantity").alias("attempts"), F.sum(F.round(F.col("l_discount") * 100)).alias("reception_errors"), F.sum("l_quantity").alias("reception_attempts"), F.count_if(F.col("l_returnflag") != "A").alias("n"))
    return out.where("n > 0").drop("n")


def _measures(spark, d, adjusted):
    games = stored(pairwise.games(spark, d))
    return metrics.build(M.sides(M.decided(games)), _boxes(spark, d), pairwise.edges_of(games), adjusted)


def team_metrics_raw(spark, d):
    return _measures(spark, d, False).select("team", *[F.round(c, 6).alias(c) for c in metrics.RAW])


def team_metrics(spark, d):
    """All twelve measures."""
    return _measures(spark, d, True).select("team", *[F.round(c, 6).alias(c) for c in (*metrics.RAW, *metrics.ADJUSTED)])


CUTOFFS, MIN_FIT, MIN_TEST = ("1998-05-01", "1999-06-01", "2000-05-01"), 50, 20


def split_runner(spark, d):
    """Each raw measure, fitted before and tested after three dates and on the championship, with its rank against that at the second date."""
    m = stored(matches(spark, d))
    out = splits.stability(splits.standalone(m, _boxes(spark, d), list(CUTOFFS), MIN_FIT, MIN_TEST), CUTOFFS[1])
    return out.select("split", "metric", "n_fit", "n", F.round("accuracy", 6).alias("accuracy"), F.round("auc", 6).alias("auc"), "rank", "shift")


def _weights(games, m):
    z = models.standardised(models.differences(M.decided(games), m, ["rpi", "margin"]), ["d_rpi", "d_margin"])
    return models.logistic(z, ["z_d_rpi", "z_d_margin"], "y")


def ratings_table(spark, d):
    return _ratings_of(_games(spark, d))


def _ratings_of(games):
    return stored(_rpi_of(games).join(_margins_of(games), "team"))


def logistic_weights(spark, d):
    games = _games(spark, d)
    return spark.createDataFrame(list(zip(("intercept", "rpi", "margin"), (round(w, 5) for w in _weights(games, _ratings_of(games))), strict=True)), "name string, weight double")


def composite_rating(spark, d):
    games = _games(spark, d)
    table_ = _ratings_of(games)
    w = _weights(games, table_)
    z = models.standardised(table_, ["rpi", "margin"])
    out = z.withColumn("composite", w[1] * F.col("z_rpi") + w[2] * F.col("z_margin"))
    return ranked(out, "composite", "team").select("team", F.round("composite", 4).alias("composite"), "rank")


def adj_score(spark, d, sos_weight: float = 2.0):
    """Z of net points per set plus sos_weight times Z of the rank of schedule strength (a low rank is good)."""
    r = ranked(ratings_table(spark, d), "owp", "team", "sos")
    z = models.standardised(r, ["margin", "sos"])
    return z.select("team", F.col("sos").cast("long").alias("sos"), F.round(F.col("z_margin") - sos_weight * F.col("z_sos"), 5).alias("adj"))


def _scored(spark, d):
    games = _games(spark, d)
    return models.differences(M.decided(games), _rpi_of(games), ["rpi"]).withColumn("score", F.round("d_rpi", 10))


def metric_accuracy(spark, d):
    s = _scored(spark, d)
    return s.groupBy("championship").agg(F.count("*").alias("games"), F.round(F.avg(((F.col("score") > 0) == (F.col("y") == 1)).cast("int")), 6).alias("accuracy"))


def match_auc(spark, d):
    out = auc(_scored(spark, d), "score", "y")
    return out.select(F.col("n").cast("long").alias("n"), F.round("auc", 6).alias("auc"))


def auc_bootstrap_md5(spark, d):
    s = stored(ranked(_scored(spark, d).withColumn("o", -F.col("gid")), "o", "gid", "i").select((F.col("i") - 1).alias("i"), "score", "y"))
    out = models.interval(models.resampled_aucs(s, "i", ["score"], "y", RESAMPLES).where("rep > 0").select(F.round("auc_score", 6).alias("auc")).where("auc IS NOT NULL"), "auc")
    return out.select("n", "low", "high")


def _metrics_of(m):
    """(team, rpi, margin) from these matches alone."""
    won = F.col("winner") == 0
    edges = m.select(F.when(won, F.col("team_a")).otherwise(F.col("team_b")).alias("winner"), F.when(won, F.col("team_b")).otherwise(F.col("team_a")).alias("loser"), "gid")
    margins = M.sides(m).groupBy("team").agg((F.sum(F.col("pf") - F.col("pa")) / F.sum("sets")).alias("margin"))
    return ratings.rpi(edges).select("team", "rpi").join(margins, "team")


def incremental_auc(spark, d):
    """What the margin adds to the ranking index on the last 30 % of days, both models fitted on the days before."""
    m = stored(matches(spark, d))
    cut = M.cut_dates(m, (0.70,)).first()
    if cut is None:
        return spark.createDataFrame([], "n long, auc_base double, auc_full double, gain double, low double, high double")
    before, after = m.where(F.col("date") < F.lit(cut["date"])), m.where(F.col("date") >= F.lit(cut["date"]))
    metrics = stored(_metrics_of(before))
    fit, test = (models.differences(x, metrics, ["rpi", "margin"]) for x in (before, after))
    test = stored(ranked(test.withColumn("o", -F.col("gid")), "o", "gid", "i").withColumn("i", F.col("i") - 1))
    out = models.incremental_auc(fit, test, ["d_rpi"], "d_margin", "y", "i", RESAMPLES)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("auc_base", "auc_full", "gain", "low", "high")])


def chrono_validation(spark, d):
    """(date, n_fit, n_test, auc_fit, auc_test, gap) at each quantile date: ratings and weights from the days before it alone."""
    m, out = stored(matches(spark, d)), []
    for cut in M.cut_dates(m, (0.55, 0.70, 0.85)).collect():  # three dates at most
        before, after = m.where(F.col("date") < F.lit(cut["date"])), m.where(F.col("date") >= F.lit(cut["date"]))
        metrics, names = stored(_metrics_of(before)), ["d_rpi", "d_margin"]
        fit, test = models.scaled_as(f := models.differences(before, metrics, ["rpi", "margin"]), [f, models.differences(after, metrics, ["rpi", "margin"])], names)
        z = [f"z_{n}" for n in names]
        score = models.linear(models.logistic(fit, z, "y"), z)
        a, b = (auc(x.select(score.alias("score"), "y"), "score", "y").first() for x in (fit, test))
        gap = None if a["auc"] is None or b["auc"] is None else round(a["auc"] - b["auc"], 6)
        out.append((str(cut["date"]), a["n"] or 0, b["n"] or 0, a["auc"] and round(a["auc"], 6), b["auc"] and round(b["auc"], 6), gap))
    return spark.createDataFrame(out, "date string, n_fit long, n_test long, auc_fit double, auc_test double, gap double")


def _favoured(spark, d):
    p = models.sigmoid(10 * F.col("score"))
    up = F.col("p") >= 0.5
    return _scored(spark, d).withColumn("p", p).select(F.when(up, F.col("p")).otherwise(1 - F.col("p")).alias("p"), F.when(up, F.col("y")).otherwise(1 - F.col("y")).alias("won"))


def calibration_buckets(spark, d):
    b = F.least(F.floor(F.round(F.col("p") * 10, 8)) * 10, F.lit(90)).cast("long")
    return _favoured(spark, d).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("won"), 6).alias("mean_won"))


def brier(spark, d):
    return _favoured(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("won"), F.lit(2))), 6).alias("brier"), F.round(F.avg("won"), 6).alias("favourite_accuracy"))


def _with_margin(spark, d):
    games = _games(spark, d)
    return models.differences(M.decided(games), _margins_of(games), ["margin"])


def series_length(spark, d):
    """Observed and expected shares of matches of three, four and five sets (observed lengths beyond these go to the nearest)."""
    parts = {k: probability.match_parts(F.col("r"))[k] + probability.match_parts(1 - F.col("r"))[k] for k in ("p30", "p31", "p32")}
    m = _with_margin(spark, d).select(F.greatest(F.lit(3), F.least(F.lit(5), "sets")).alias("n"), probability.rally(F.col("d_margin")).alias("r")).withColumns(parts)
    each = m.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("length"), F.col(k).alias("e"), (F.col("n") == i).cast("int").alias("o")) for i, k in ((3, "p30"), (4, "p31"), (5, "p32"))])).alias("x")).select("x.*")
    return each.groupBy("length").agg(F.round(F.avg("o"), 6).alias("observed"), F.round(F.avg("e"), 6).alias("expected"))


def set_match_probability(spark, d):
    p = F.col("k") / 100
    grid = spark.range(10, 95, 5).select(F.col("id").alias("k"))
    parts = {k: F.round(v, 8) for k, v in probability.match_parts(p).items()}
    return grid.select("k", F.round(probability.set_win(p, 25), 8).alias("set25"), F.round(probability.set_win(p, 15), 8).alias("set15"), *[v.alias(k) for k, v in parts.items()])


def bracket_title_probs(spark, d):
    top = ranked(ratings_table(spark, d), "rpi", "team").where(F.col("rank") <= len(SLOTS)).select("team", "rank", "margin")
    slots = top.select((F.array_position(F.array(*map(F.lit, SLOTS)), F.col("rank")) - 1).cast("int").alias("slot"), "team", "margin").persist()  # 8 rows, read several times
    other = slots.select(F.col("team").alias("opp"), F.col("margin").alias("m2"))
    met = F.broadcast(slots).join(F.broadcast(other), F.col("team") != F.col("opp"))  # 8 rows each
    pairs = met.select("team", "opp", probability.match_win(F.col("margin") - F.col("m2")).alias("p")).persist()
    return probability.titles(slots, pairs, 3).select("team", F.round("p", 6).alias("p"))


def _tree(spark, d):
    """The championship games as a bracket, the members' margins as strengths, and half the home advantage in points a set."""
    m = stored(matches(spark, d))
    w, home = F.col("winner") == 0, F.col("gid") % 2 == 0
    games = m.where("championship").select("gid", "date", "team_a", "team_b", F.when(w, F.col("team_a")).otherwise(F.col("team_b")).alias("winner"), F.when(home, F.col("team_a")).otherwise(F.col("team_b")).alias("home"))
    sides = M.sides(m)
    strength = sides.groupBy("team").agg((F.sum(F.col("pf") - F.col("pa")) / F.sum("sets")).alias("margin")).join(members(spark, d), "team", "left_semi")
    half = sides.where("home").agg(F.avg((F.col("pf") - F.col("pa")) / F.col("sets")) / 2).first()[0]
    return stored(bracket.nodes(games)), stored(strength), round(half or 0.0, 6)


def bracket_tree(spark, d):
    tree = _tree(spark, d)[0]
    return tree.select("gid", F.col("round").cast("long").alias("round"), "feeder_a", "feeder_b")


def bracket_propagation(spark, d):
    return bracket.title(*_tree(spark, d)).select("team", F.round("p", 6).alias("p"))


def bracket_champion(spark, d):
    tree, strength, half = _tree(spark, d)
    return bracket.champion(tree, stored(bracket.title(tree, strength, half))).withColumn("p", F.round("p", 6))


def permutation_gap_md5(spark, d):
    delta = teams(spark, d).select("team", "official_rank").join(ranked(_rpi(spark, d), "rpi", "team"), "team")
    rows = delta.select("team", F.when(F.col("official_rank") != F.col("rank"), F.col("official_rank") > F.col("rank")).alias("up"), "wp")
    return models.permutation_gap(rows, "team", "up", "wp", TRIALS).select(F.round("gap", 6).alias("gap"), F.round("p", 6).alias("p"))


QUERIES = [net_points_raw, box_rates, opponent_adjusted, team_metrics_raw, split_runner, team_metrics, logistic_weights, composite_rating, adj_score, metric_accuracy, match_auc, auc_bootstrap_md5, incremental_auc, chrono_validation, calibration_buckets, brier, series_length,
           set_match_probability, bracket_title_probs, bracket_tree, bracket_propagation, bracket_champion, permutation_gap_md5]


def _set_sql(p: str, t: int) -> str:
    early = " + ".join(f"{comb(t - 1 + b, b)}::DOUBLE * pow(1 - {p}, {b})" for b in range(t - 1))
    return f"(({early}) * pow({p}, {t}) + {comb(2 * t - 2, t - 1)}::DOUBLE * pow({p} * (1 - {p}), {t - 1}) * {p} * {p} / (1 - 2 * {p} * (1 - {p})))"


def oracle(rpi: str) -> dict[str, str]:
    x = f"WITH {GAMEX} "
    margin = "g AS (SELECT team, sum(pf - pa) / sum(sets) AS margin FROM ms GROUP BY team)"
    r = rpi.replace("WITH ", "")
    # both CTE chains define side and two: the second as they are
    both = f"WITH {GAMEX}, edge AS (SELECT CASE WHEN points_a > points_b THEN team_a ELSE team_b END AS winner, CASE WHEN points_a > points_b THEN team_b ELSE team_a END AS loser, gid FROM m), {r[r.index('side2 AS'):]}, {margin}"
    sc = ", sc AS (SELECT m.*, round(a.rpi - b.rpi, 10) AS score, (points_a > points_b)::INT AS y FROM m JOIN r a ON a.team = team_a JOIN r b ON b.team = team_b)"
    fav = sc + ", q AS (SELECT 1 / (1 + exp(-least(30, greatest(-30, 10 * score)))) AS p, y FROM sc), f AS (SELECT CASE WHEN p >= .5 THEN p ELSE 1 - p END AS p, CASE WHEN p >= .5 THEN y ELSE 1 - y END AS won FROM q)"
    ral = "least(.9, greatest(.1, .5 + ({}) / (2 * 43.44)))"
    parts = "s25 * s25 * s25 AS p30, 3 * s25 * s25 * s25 * (1 - s25) AS p31, 6 * s25 * s25 * (1 - s25) * (1 - s25) * s15 AS p32"
    place = "list_position([" + ", ".join(map(str, SLOTS)) + "], rank) - 1"
    rounds = ", t0 AS (SELECT slot, team, 1.0::DOUBLE AS p FROM sl)"
    for i in range(3):
        rounds += f", t{i + 1} AS (SELECT a.slot, a.team, a.p * sum(b.p * pm.p) AS p FROM t{i} a JOIN t{i} b ON xor(a.slot >> {i}, 1) = b.slot >> {i} JOIN pm ON pm.team = a.team AND pm.opp = b.team GROUP BY a.slot, a.team, a.p)"
    tree = x + """, cg AS (SELECT gid, date, team_a, team_b, CASE WHEN points_a > points_b THEN team_a ELSE team_b END AS winner, CASE WHEN gid % 2 = 0 THEN team_a ELSE team_b END AS home FROM m WHERE championship),
ap AS (SELECT gid, row_number() OVER (PARTITION BY team ORDER BY date, gid) - 1 AS n FROM (SELECT gid, date, unnest([team_a, team_b]) AS team FROM cg)), nr AS (SELECT cg.*, round FROM cg JOIN (SELECT gid, max(n) AS round FROM ap GROUP BY gid) USING (gid)),
fd AS (SELECT a.gid, a.team_a, b.gid AS f, b.winner FROM nr a JOIN nr b ON b.winner IN (a.team_a, a.team_b) AND b.round < a.round QUALIFY row_number() OVER (PARTITION BY a.gid, b.winner ORDER BY b.round DESC, b.date, b.gid) = 1),
nd AS MATERIALIZED (SELECT nr.*, fa.f AS feeder_a, fb.f AS feeder_b FROM nr LEFT JOIN fd fa ON fa.gid = nr.gid AND fa.winner = nr.team_a LEFT JOIN fd fb ON fb.gid = nr.gid AND fb.winner = nr.team_b)"""
    pw = lambda gap: f"(SELECT p30 + p31 + p32 FROM (SELECT {parts} FROM (SELECT {_set_sql('p', 25)} AS s25, {_set_sql('p', 15)} AS s15 FROM (SELECT {ral.format(gap)} AS p))))"
    spread = tree + f""", {margin}, st AS MATERIALIZED (SELECT team, margin FROM g JOIN supplier ON s_suppkey = team WHERE s_acctbal >= 0), hh AS (SELECT round(avg((pf - pa) / sets) / 2, 6) AS h FROM ms WHERE home),
lf AS (SELECT gid, team_a, team_b, CASE WHEN gap IS NULL THEN .5 ELSE {pw('gap')} END AS pa FROM (SELECT nd.*, a.margin - b.margin + CASE WHEN home = team_a THEN 2 * h ELSE -2 * h END AS gap FROM nd LEFT JOIN st a ON a.team = team_a LEFT JOIN st b ON b.team = team_b, hh WHERE round = 0 OR feeder_a IS NULL OR feeder_b IS NULL)),
d0 AS MATERIALIZED (SELECT gid, team_a AS team, pa AS p FROM lf UNION ALL SELECT gid, team_b, 1 - pa FROM lf)"""
    for i in range(1, DEPTH):
        spread += f""",
e{i} AS (SELECT nd.gid, side, d.team, d.p, margin FROM nd, (VALUES ('a'), ('b')) v(side), d{i - 1} d LEFT JOIN st ON st.team = d.team WHERE round = {i} AND feeder_a IS NOT NULL AND feeder_b IS NOT NULL AND d.gid = CASE side WHEN 'a' THEN feeder_a ELSE feeder_b END),
d{i} AS MATERIALIZED (SELECT * FROM d{i - 1} UNION ALL SELECT gid, team, sum(pp * CASE WHEN gap IS NULL THEN .5 ELSE {pw('gap')} END) FROM (SELECT a.gid, a.team, a.p * b.p AS pp, a.margin - b.margin AS gap FROM e{i} a JOIN e{i} b ON b.gid = a.gid AND b.side <> a.side) GROUP BY ALL)"""
    last = "(SELECT gid, winner FROM nd ORDER BY round DESC, date, gid LIMIT 1)"
    auc_of = "(SELECT {k} sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) AS auc FROM (SELECT *, coalesce(sum(q) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {k} score, sum(y) AS p, sum(1 - y) AS q FROM {t} GROUP BY ALL)) {by})"
    return {
        "net_points_raw": x + f", {margin} SELECT team, round(margin, 6) AS margin FROM g",
        "box_rates": """WITH b AS (SELECT l_suppkey AS team, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS kills, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS errors,
sum(l_quantity) AS attempts, sum(round(l_discount * 100)) AS re FROM lineitem GROUP BY 1) SELECT team, kills, errors, attempts, round((kills - errors) / attempts, 6) AS hit_eff, round(re / attempts, 6) AS reception FROM b""",
        "team_metrics_raw": both + """, bx AS (SELECT l_orderkey AS gid, l_suppkey AS team, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS kills, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS errors,
sum(l_quantity) AS attempts, sum(round(l_discount * 100)) AS re FROM lineitem GROUP BY ALL HAVING count_if(l_returnflag <> 'A') > 0),
sb AS (SELECT ms.*, b.kills, b.errors, b.attempts, b.re, o.kills AS okills, o.errors AS oerrors, o.attempts AS oattempts FROM ms LEFT JOIN (bx b JOIN bx o ON o.gid = b.gid AND o.team <> b.team) ON b.gid = ms.gid AND b.team = ms.team AND o.team = ms.opp),
x AS (SELECT team, avg(won) AS win_pct, (sum(kills) - sum(errors)) / nullif(sum(attempts), 0) AS own, (sum(okills) - sum(oerrors)) / nullif(sum(oattempts), 0) AS opp, sum(pf - pa) / sum(sets) AS net, 1 - sum(re) / nullif(sum(attempts), 0) AS so FROM sb GROUP BY team)
SELECT team, round(rpi, 6) AS rpi, round(win_pct, 6) AS win_pct, round(own, 6) AS own_hit_eff, round(-opp, 6) AS opp_hit_eff, round(own - opp, 6) AS hit_eff_diff, round(net, 6) AS net_points_set, round(so, 6) AS sideout_proxy FROM x JOIN r USING (team)""",
        "split_runner": x + f""", bx AS (SELECT l_orderkey AS gid, l_suppkey AS team, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS kills, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS errors,
sum(l_quantity) AS attempts, sum(round(l_discount * 100)) AS re FROM lineitem GROUP BY ALL HAVING count_if(l_returnflag <> 'A') > 0),
pt AS (SELECT *, CASE WHEN split = 'tournament' THEN championship WHEN date IS NOT NULL THEN date >= try_cast(split AS DATE) END AS test FROM (SELECT m.*, unnest({['tournament', *CUTOFFS]}) AS split FROM m)),
fs AS (SELECT split, ms.*, b.kills, b.errors, b.attempts, b.re, o.kills AS okills, o.errors AS oerrors, o.attempts AS oattempts FROM pt JOIN ms USING (gid)
LEFT JOIN (bx b JOIN bx o ON o.gid = b.gid AND o.team <> b.team) ON b.gid = ms.gid AND b.team = ms.team AND o.team = ms.opp WHERE NOT test),
h AS (SELECT split, team, opp, sum(won) AS w, count(*) - sum(won) AS l FROM fs GROUP BY ALL), t AS (SELECT split, team, sum(w) AS w, sum(l) AS l FROM h GROUP BY ALL),
ex AS (SELECT h.split, h.team, h.opp, h.w + h.l AS n, coalesce((t.w - h.l) / nullif(t.w + t.l - h.w - h.l, 0), 0) AS p FROM h JOIN t ON t.split = h.split AND t.team = h.opp),
ow AS (SELECT split, team, sum(p * n) / sum(n) AS owp FROM ex GROUP BY ALL),
oo AS (SELECT ex.split, ex.team, sum(owp * n) / sum(n) AS oowp FROM ex JOIN ow ON ow.split = ex.split AND ow.team = ex.opp GROUP BY ALL),
me AS (SELECT split, team, avg(won) AS win_pct, (sum(kills) - sum(errors)) / nullif(sum(attempts), 0) AS own_hit_eff, -((sum(okills) - sum(oerrors)) / nullif(sum(oattempts), 0)) AS opp_hit_eff,
sum(pf - pa) / sum(sets) AS net_points_set, 1 - sum(re) / nullif(sum(attempts), 0) AS sideout_proxy FROM fs GROUP BY ALL),
wide AS (SELECT me.*, own_hit_eff + opp_hit_eff AS hit_eff_diff, .25 * t.w / (t.w + t.l) + .5 * owp + .25 * oowp AS rpi FROM me JOIN t USING (split, team) JOIN ow USING (split, team) JOIN oo USING (split, team)),
v AS (UNPIVOT wide ON {', '.join(metrics.RAW)} INTO NAME metric VALUE v),
sc AS (SELECT pt.split, a.metric, (points_a > points_b)::INT AS y, round(a.v - b.v, 10) AS score FROM pt JOIN v a ON a.split = pt.split AND a.team = team_a JOIN v b ON b.split = pt.split AND b.team = team_b AND b.metric = a.metric WHERE test),
c AS (SELECT split, metric, score, sum(y) AS p, sum(1 - y) AS q FROM sc GROUP BY ALL),
lo AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY split, metric ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
au AS (SELECT split, metric, sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) AS auc FROM lo GROUP BY ALL),
f AS (SELECT split, metric, n_fit, n, CASE WHEN n_fit >= {MIN_FIT} AND n >= {MIN_TEST} THEN accuracy END AS accuracy, CASE WHEN n_fit >= {MIN_FIT} AND n >= {MIN_TEST} THEN auc END AS auc
FROM (SELECT split, metric, count(*) AS n, avg(((score > 0) = (y = 1))::INT) AS accuracy FROM sc GROUP BY ALL) JOIN au USING (split, metric) JOIN (SELECT split, count_if(NOT test)::BIGINT AS n_fit FROM pt GROUP BY ALL) USING (split)),
k AS (SELECT *, CASE WHEN auc IS NOT NULL THEN row_number() OVER (PARTITION BY split ORDER BY round(auc, 8) DESC NULLS LAST, metric) END AS rank FROM f)
SELECT split, metric, n_fit, n, round(accuracy, 6) AS accuracy, round(auc, 6) AS auc, rank, rank - max(rank) FILTER (split = '{CUTOFFS[1]}') OVER (PARTITION BY metric) AS shift FROM k""",
        "adj_score": both + """, s AS (SELECT team, margin, row_number() OVER (ORDER BY round(owp, 10) DESC, team) AS sos FROM r JOIN g USING (team))
SELECT team, sos, round((margin - avg(margin) OVER ()) / stddev_pop(margin) OVER () - 2 * (sos - avg(sos) OVER ()) / stddev_pop(sos) OVER (), 5) AS adj FROM s""",
        "metric_accuracy": both + sc + " SELECT championship, count(*) AS games, round(avg(((score > 0) = (y = 1))::INT), 6) AS accuracy FROM sc GROUP BY 1",
        "match_auc": both + sc + f" SELECT (SELECT count(*) FROM sc) AS n, round(auc, 6) AS auc FROM {auc_of.format(k='', part='', t='sc', by='')}",
        "auc_bootstrap_md5": both + sc + f""", e AS (SELECT row_number() OVER (ORDER BY gid) - 1 AS i, score, y, count(*) OVER () AS n FROM sc),
dr AS (SELECT rep, ('0x' || substr(md5(rep || '|' || i), 1, 8))::BIGINT % n AS i FROM e, range(1, {RESAMPLES + 1}) t(rep)), z AS (SELECT rep, score, y FROM dr JOIN e USING (i)),
v AS (SELECT list_sort(list(round(auc, 6))) AS v, count(*) AS n FROM {auc_of.format(k='rep,', part='PARTITION BY rep', t='z', by='GROUP BY rep')}) SELECT n, v[floor(.025 * n)::INT + 1] AS low, v[floor(.975 * n)::INT] AS high FROM v""",
        "calibration_buckets": both + fav + " SELECT least(floor(round(p * 10, 8)) * 10, 90)::BIGINT AS bucket, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(won), 6) AS mean_won FROM f GROUP BY 1",
        "brier": both + fav + " SELECT count(*) AS n, round(avg(pow(p - won, 2)), 6) AS brier, round(avg(won), 6) AS favourite_accuracy FROM f",
        "series_length": x + f""", {margin}, w AS (SELECT greatest(3, least(5, sets)) AS n, {ral.format('a.margin - b.margin')} AS p FROM m JOIN g a ON a.team = team_a JOIN g b ON b.team = team_b),
u AS (SELECT n, {_set_sql('p', 25)} AS s25, {_set_sql('p', 15)} AS s15, {_set_sql('(1 - p)', 25)} AS o25, {_set_sql('(1 - p)', 15)} AS o15 FROM w), e AS (SELECT n, s25 ^ 3 + o25 ^ 3 AS p30, 3 * s25 ^ 3 * (1 - s25) + 3 * o25 ^ 3 * (1 - o25) AS p31,
6 * s25 ^ 2 * (1 - s25) ^ 2 * s15 + 6 * o25 ^ 2 * (1 - o25) ^ 2 * o15 AS p32 FROM u)
SELECT 3::BIGINT AS length, round(avg((n = 3)::INT), 6) AS observed, round(avg(p30), 6) AS expected FROM e UNION ALL SELECT 4, round(avg((n = 4)::INT), 6), round(avg(p31), 6) FROM e UNION ALL SELECT 5, round(avg((n = 5)::INT), 6), round(avg(p32), 6) FROM e""",
        "set_match_probability": f"WITH k AS (SELECT k, k / 100 AS p FROM range(10, 95, 5) t(k)), s AS (SELECT k, {_set_sql('p', 25)} AS s25, {_set_sql('p', 15)} AS s15 FROM k), q AS (SELECT *, {parts} FROM s) SELECT k, round(s25, 8) AS set25, round(s15, 8) AS set15, round(p30, 8) AS p30, round(p31, 8) AS p31, round(p32, 8) AS p32 FROM q",
        "bracket_title_probs": both + f""", sl AS (SELECT {place} AS slot, team, margin FROM k JOIN g USING (team) WHERE rank <= 8), pp AS (SELECT a.team, b.team AS opp, {ral.format('a.margin - b.margin')} AS p FROM sl a JOIN sl b ON a.team <> b.team),
ps AS (SELECT team, opp, {_set_sql('p', 25)} AS s25, {_set_sql('p', 15)} AS s15 FROM pp), pm AS (SELECT team, opp, p30 + p31 + p32 AS p FROM (SELECT team, opp, {parts} FROM ps)){rounds} SELECT team, round(p, 6) AS p FROM t3""",
        "bracket_tree": tree + " SELECT gid, round, feeder_a, feeder_b FROM nd",
        "bracket_propagation": spread + f" SELECT team, round(p, 6) AS p FROM d{DEPTH - 1} JOIN {last} USING (gid)",
        "bracket_champion": spread + f""", tt AS (SELECT winner, team, round(p, 12) AS p FROM d{DEPTH - 1} JOIN {last} USING (gid)), me AS (SELECT p AS mine FROM tt WHERE team = winner)
SELECT max(winner) AS champion, round(max(mine), 6) AS p, CASE WHEN max(mine) IS NOT NULL THEN count_if(p > mine OR (p = mine AND team < winner)) + 1 END AS rank, count(*) AS teams, abs(sum(p) - 1) < 1e-9 AS adds_up FROM tt LEFT JOIN me ON true""",
        "permutation_gap_md5": both + f""", off AS (SELECT s_suppkey AS team, row_number() OVER (ORDER BY round(s_acctbal, 10) DESC, s_suppkey) AS f FROM supplier), pool AS (SELECT team, (f > rank)::INT AS g, wp AS x FROM k JOIN off USING (team) WHERE f <> rank),
real AS (SELECT avg(x) FILTER (g = 1) - avg(x) FILTER (g = 0) AS gap, sum(g) AS n1 FROM pool), pl AS (SELECT trial, gap, n1, x, row_number() OVER (PARTITION BY trial ORDER BY md5(trial || '|' || team), team) AS i FROM pool, real, range(1, {TRIALS + 1}) t(trial)),
sh AS (SELECT trial, gap, avg(x) FILTER (i <= n1) - avg(x) FILTER (i > n1) AS g FROM pl GROUP BY ALL) SELECT round(max(gap), 6) AS gap, round((count_if(round(abs(g), 12) >= round(abs(gap), 12)) + 1) / ({TRIALS} + 1), 6) AS p FROM sh""",
    }
