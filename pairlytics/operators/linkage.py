"""Linking people of a roster to rows of an earlier pool, within their team.

Passes, each only over what the former left: exact names, narrow keys, whole-name keys (more than one candidate in a
pass is ambiguous and ends the search); then a word of the surname with a compatible given name, where the pair
is the only one for both sides and the person is no newcomer. What is left is classified, never guessed, with the reason.
Rows need id, team, first, last; names that many people share only meet inside one team. Keys and words of a name are computed once.

Similar names meet by a lossless filter. A ratio of at least c needs a common letter bag of c / 2 of both lengths together, so partners of a
name of n letters share c / (2 - c) n letters with it at least; two such names share one of their rarest letters (the k-th of its kind counts
as a letter of its own), on which they are joined. Lengths and bags are compared natively before a ratio is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .lineage import stored

CUTOFF = 0.72  # fixed: least similarity of names
#: Letters from rare to common; any other character counts as rarer. Only the cost depends on the order.
RARE_FIRST = "qjxzwkvfybghmpdutclsnoriae"


def prepared(people: DataFrame) -> DataFrame:
    """people with k1, k2, k3 (exact, narrow and whole-name key) and words (of the folded whole name), written once."""
    first, last = F.trim(F.coalesce("first", F.lit(""))), F.trim(F.coalesce("last", F.lit("")))
    return stored(people.withColumns({"k1": F.concat_ws("|", first, last), "k2": names.narrow_key(first, last), "k3": names.whole_key(first, last), "words": names.tokens(F.concat_ws(" ", first, last))}))


def _ready(people: DataFrame) -> DataFrame:
    return people if "words" in people.columns else prepared(people)


def exact_passes(roster: DataFrame, pool: DataFrame) -> DataFrame:
    """(id, pool_id, n, method): pass 1; pool_id is null where several candidates tie."""
    left, pool, found = _ready(roster), _ready(pool), None
    for key, name in (("k1", "exact"), ("k2", "narrow"), ("k3", "whole")):
        sides = pool.groupBy("team", key).agg(F.count("*").alias("n"), F.min("id").alias("pool_id"))
        met = left.where(F.length(key) > 1).select("id", "team", key).join(sides, ["team", key])
        one = met.select("id", F.when(F.col("n") == 1, F.col("pool_id")).alias("pool_id"), "n", F.lit(name).alias("method"))
        left = left.join(one.select("id"), "id", "left_anti")
        found = one if found is None else found.unionByName(one)
    return found


def unique_pairs(found: DataFrame) -> DataFrame:
    """Links whose pool row no other person claims."""
    claims = found.where("pool_id IS NOT NULL").groupBy("pool_id").agg(F.count("*").alias("claims"))
    return found.join(claims, "pool_id").where("claims = 1").select("id", "pool_id", "method")


def letter_bag(text: Column) -> Column:
    """The characters of a text, each with its number among its kind, rare ones first."""
    chars = F.split(text, "")

    def numbered(c: Column, i: Column) -> Column:
        kind = F.lpad(F.position(F.lower(c), F.lit(RARE_FIRST)).cast("string"), 2, "0")
        again = F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c))
        return F.concat(kind, c, again.cast("string"))

    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.transform(chars, numbered)))


def can_be_similar(bag_a: Column, bag_b: Column, cutoff: float = CUTOFF) -> Column:
    """Whether two texts' lengths and letters allow a ratio of the cutoff; never false where they reach it."""
    both = F.size(bag_a) + F.size(bag_b)
    short = 2.0 * F.least(F.size(bag_a), F.size(bag_b)) >= cutoff * both - 1e-9
    return short & (2.0 * F.size(F.array_intersect(bag_a, bag_b)) >= cutoff * both - 1e-9)


def similar_pairs(a: DataFrame, b: DataFrame, by: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """(x, y, ratio and `by`): distinct texts x of a and y of b with equal `by` columns and a ratio of the cutoff at least; none is lost, empty texts have none."""

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        n = F.size("bag")
        keep = n - F.ceil(F.lit(cutoff / (2 - cutoff)) * n - 1e-9).cast("int") + 1
        bags = df.select(*by, name).where(F.length(name) > 0).distinct().withColumn("bag", letter_bag(F.col(name)))
        return bags.select(*by, name, F.col("bag").alias(f"bag_{name}"), F.explode(F.slice("bag", F.lit(1), keep)).alias("letter"))

    met = prefixes(a, "x").join(prefixes(b, "y"), [*by, "letter"]).where(can_be_similar(F.col("bag_x"), F.col("bag_y"), cutoff))
    pairs = met.select(*by, "x", "y").distinct()
    return pairs.withColumn("ratio", names.similarity("y", "x")).where(F.col("ratio") >= cutoff)


def surname_pass(roster: DataFrame, pool: DataFrame, nicknames: DataFrame | None = None) -> DataFrame:
    """(id, pool_id, method): pairs that share a word after the first, with compatible given names, unique for both sides.

    Given names are compatible if one is part of the other or a word of the other's name, if they are linked nicknames, or similar.
    """
    def words(people: DataFrame, prefix: str) -> DataFrame:
        p = people.where(F.size("words") > 1).select(F.col("id").alias(f"{prefix}id"), "team", "words", F.get("words", 0).alias(f"{prefix}given"))
        return p.select(f"{prefix}id", "team", f"{prefix}given", F.col("words").alias(f"{prefix}words"), F.explode(F.array_distinct(F.slice("words", F.lit(2), F.size("words")))).alias("word"))

    r = words(_ready(roster).where(~names.freshman(F.col("year"))), "r_")
    met = r.join(words(_ready(pool), "p_"), ["team", "word"]).drop("word").distinct()
    x, y = F.col("r_given"), F.col("p_given")
    part = x.contains(y) | y.contains(x) | F.array_contains("p_words", x) | F.array_contains("r_words", y)
    met = stored(met.withColumn("sure", part).select("r_id", "p_id", "r_given", "p_given", "sure"))
    sure, rest = met.where("sure").select("r_id", "p_id"), met.where("NOT sure")
    given = rest.select(F.col("r_given").alias("x"), F.col("p_given").alias("y")).distinct()
    alike = given.where(can_be_similar(letter_bag(F.col("x")), letter_bag(F.col("y")))).withColumn("ratio", names.similarity("x", "y")).where(F.col("ratio") >= CUTOFF).select("x", "y")
    if nicknames is not None:
        alike = alike.unionByName(given.join(nicknames.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_semi"))
    more = rest.withColumnsRenamed({"r_given": "x", "p_given": "y"}).join(alike.distinct(), ["x", "y"]).select("r_id", "p_id")
    one = sure.unionByName(more).distinct().groupBy("r_id").agg(F.count("*").alias("n"), F.min("p_id").alias("p_id")).where("n = 1")
    claims = one.groupBy("p_id").agg(F.count("*").alias("m")).where("m = 1").select("p_id")
    return one.join(claims, "p_id").select(F.col("r_id").alias("id"), F.col("p_id").alias("pool_id"), F.lit("surname").alias("method"))


def link(roster: DataFrame, pool: DataFrame, nicknames: DataFrame | None = None) -> DataFrame:
    """One row per roster row: id, team, pool_id, method, status RETURNING, NEW, TRANSFER-IN or UNRESOLVED, and why.

    Nothing is carried over from another team: a name of one row elsewhere is a transfer, one of several is ambiguous.
    """
    roster, pool = _ready(roster), _ready(pool)
    first = stored(exact_passes(roster, pool))
    sure = unique_pairs(first)
    left = roster.join(first.select("id"), "id", "left_anti")
    free = pool.join(first.where("pool_id IS NOT NULL").select(F.col("pool_id").alias("id")), "id", "left_anti")
    linked = sure.unionByName(surname_pass(left, free, nicknames))
    here = pool.groupBy("k2", "team").agg(F.count("*").alias("here"))
    anywhere = here.groupBy("k2").agg(F.sum("here").alias("anywhere"))
    rows = roster.select("id", "team", "year", "k2").join(linked, "id", "left").join(first.select("id", F.col("n").alias("tied")), "id", "left")
    rows = rows.join(anywhere, "k2", "left").join(here, ["k2", "team"], "left").withColumn("elsewhere", F.coalesce("anywhere", F.lit(0)) - F.coalesce("here", F.lit(0)))
    there, tied, new = F.col("pool_id").isNotNull(), F.col("tied").isNotNull(), names.freshman(F.col("year"))
    status = F.when(there, "RETURNING").when(tied, "UNRESOLVED").when(new, "NEW").when(F.col("elsewhere") == 1, "TRANSFER-IN").otherwise("UNRESOLVED")
    why = F.when(there | (new & ~tied), "").when(F.col("tied") > 1, "ambiguous in team").when(tied, "claimed twice").when(F.col("elsewhere") == 1, "").when(F.col("elsewhere") > 1, "ambiguous elsewhere").otherwise("no such name")
    return rows.select("id", "team", "pool_id", "method", status.alias("status"), why.alias("why"))


def departed(pool: DataFrame, linked: DataFrame) -> DataFrame:
    """Pool rows that no one claimed and that have production."""
    return unclaimed(pool, linked).where("production > 0")


def unclaimed(pool: DataFrame, linked: DataFrame) -> DataFrame:
    return pool.join(linked.where("pool_id IS NOT NULL").select(F.col("pool_id").alias("id")), "id", "left_anti")


def display(people: DataFrame, name: str) -> DataFrame:
    """people with the name as it is written."""
    return people.withColumn(name, F.trim(F.concat_ws(" ", "first", "last")))


def near_names(unresolved: DataFrame, free: DataFrame) -> DataFrame:
    """(id, pool_id, ratio): the most similar free name of the own team, at CUTOFF at least; ties go to the greater name, then the smaller id."""
    a, b = display(unresolved, "x"), display(free, "y")
    found = similar_pairs(a, b, ["team"])
    best = found.groupBy("team", "x").agg(F.max(F.struct("ratio", "y")).alias("r")).select("team", "x", "r.*")
    one = b.groupBy("team", "y").agg(F.min("id").alias("pool_id"))
    return a.select("id", "team", "x").join(best, ["team", "x"]).join(one, ["team", "y"]).select("id", "pool_id", "ratio")


def audit(roster: DataFrame, pool: DataFrame, linked: DataFrame) -> DataFrame:
    """One row: how many are unresolved, of these with a near free name (with and without production), with a near name that is claimed, in a team without pool; the production
    stranded, and three join rates: every unresolved row a defect, near names only, near names with production only (percent)."""
    roster, pool = _ready(roster), _ready(pool)
    open_ = stored(roster.join(linked.where("status = 'UNRESOLVED'").select("id"), "id", "left_semi"))
    free = near_names(open_, unclaimed(pool, linked)).join(pool.select(F.col("id").alias("pool_id"), "production"), "pool_id").select("id", F.coalesce("production", F.lit(0.0)).alias("production"))
    every = near_names(open_, pool).select("id", F.lit(True).alias("near"))
    teams = pool.select("team", F.lit(True).alias("has_pool")).distinct()
    rows = open_.select("id", "team").join(free, "id", "left").join(every, "id", "left").join(teams, "team", "left")
    n, defect, live = F.count_if, F.col("production").isNotNull(), F.coalesce(F.col("production") > 0, F.lit(False))
    found = rows.agg(
        F.count("*").alias("unresolved"), n(defect).alias("near_free"), n(live).alias("with_production"), n(defect & ~live).alias("without_production"),
        n(~defect & F.col("near").isNotNull()).alias("near_claimed"), n(F.col("has_pool").isNull()).alias("empty_pool"), F.coalesce(F.sum(F.when(live, F.col("production"))), F.lit(0.0)).alias("stranded"),
    )
    total = linked.agg(F.count("*").alias("people"))
    rate = lambda c: F.round(F.try_divide(100.0 * (F.col("people") - F.col(c)), "people"), 2)
    return found.join(F.broadcast(total)).select("people", *found.columns, rate("unresolved").alias("rate_reported"), rate("near_free").alias("rate_defects"), rate("with_production").alias("rate_production"))  # one row each


def concentration(linked: DataFrame) -> DataFrame:
    """One row: unresolved rows, the share of the two teams with most, how many of the teams have any, and CLUSTERED or SPREAD."""
    per = linked.groupBy("team").agg(F.count_if(F.col("status") == "UNRESOLVED").alias("n"))
    two = per.orderBy(F.desc("n"), "team").limit(2).agg(F.sum("n").alias("top2"))
    all_ = per.agg(F.count("*").alias("teams"), F.sum("n").alias("unresolved"), F.count_if(F.col("n") > 0).alias("teams_with"))
    share = F.try_divide("top2", F.col("unresolved").cast("double"))
    verdict = F.when((share > 0.6) & (F.col("teams_with") <= F.greatest(F.lit(2), F.floor(F.col("teams") / 3))), "CLUSTERED").otherwise("SPREAD")
    return all_.join(F.broadcast(two)).select("teams", "unresolved", "teams_with", F.round(share, 6).alias("top2_share"), verdict.alias("verdict"))  # one row each


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Both directions of (a, b), letters only, without self links and repeats."""
    x = edges.select(names.letters(F.col("a")).alias("a"), names.letters(F.col("b")).alias("b")).where("a <> '' AND b <> '' AND a <> b")
    return x.unionByName(x.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
