"""URL filter: host and path rules, and link-graph propagation for what no rule decides (DataFrame functions only).

A rule is a host and a path prefix; it fits the host and its subdomains, and the longest rule that fits wins. Hosts
are seeds by the pages that rules decide: each allowed page is a unit of trust, each blocked one of distrust. Trust
runs along host links (personalised PageRank), distrust against them; mass of hosts without links goes back to the
seeds. A host is blocked if its distrust exceeds `THRESHOLD` of both together; a host that neither reaches is allowed.

Pages are aggregated to hosts and links to host pairs before any shuffle, so a hot host costs no more than its rows.
Ranks stay distributed; each round is written to the shared folder. Rounds end when no new host was reached and no
host's rank moved by `TOLERANCE` of itself, however small it is beside the seeds'. Damping makes that certain to happen.

Cases: null urls and those without `://` have empty host and path, no rule, and are allowed; null html has no links;
links that repeat count once a page; links within a host don't count; repeated pages each get a row and a unit; an
empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small, stored, table

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-3, 0.5
#: None: as many rounds as it takes; a number stops them early.
ROUNDS: int | None = None
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(rules: tuple[tuple[str, str], ...], what: int) -> Column:
    """The longest rule that fits columns host and path (what = 0), or its verdict (1); null if none fits."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r[0])):
        host, slash, path = rule[0].partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        out = F.when(fits, rule[what]) if out is None else out.when(fits, rule[what])
    return out if out is not None else F.lit(None).cast("string")


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, rank) by personalised PageRank of seeds (host, mass) along edges (src, dst, weight)."""
    seeds = stored(seeds)
    total = seeds.agg(F.sum("mass")).first()[0] or 0.0
    rank = seeds.select("host", F.col("mass").alias("rank"))
    if not total or edges.isEmpty():
        return rank
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    share = stored(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    for _ in count() if ROUNDS is None else range(ROUNDS):
        moved = share.join(rank.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host"))
        moved = stored(moved.agg((F.sum(F.col("rank") * F.col("share")) * DAMPING).alias("got")))
        back = (total - (moved.agg(F.sum("got")).first()[0] or 0.0)) / total
        new = moved.join(seeds, "host", "full").select("host", (F.coalesce("got", F.lit(0.0)) + F.coalesce("mass", F.lit(0.0)) * back).alias("rank"))
        new = stored(new)
        old = rank.withColumnRenamed("rank", "old")
        moves = F.when(F.col("old").isNull(), 1.0).when(F.col("rank") == F.col("old"), 0.0).otherwise(F.abs(F.col("rank") - F.col("old")) / F.greatest("rank", "old"))
        change = new.join(old, "host", "left").agg(F.max(moves)).first()[0]  # hosts once reached stay reached
        rank = new
        if change < TOLERANCE:
            break
    return rank


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust and distrust of its host."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = urls.select("*", _rule(rules, 0).alias("rule"), _rule(rules, 1).alias("by_rule"))
    counts = stored(ruled.groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").cast("double").alias("good"), F.count_if(F.col("by_rule") == "block").cast("double").alias("bad")))
    to = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: ascii_lower(x))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(to)).alias("dst")).where("src <> dst AND src <> ''")
    edges = stored(links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
    trust = propagate(counts.where("good > 0").select("host", F.col("good").alias("mass")), edges)
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(counts.where("bad > 0").select("host", F.col("bad").alias("mass")), reverse)
    scores = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full")
    out = ruled.join(small(stored(scores)), "host", "left").na.fill(0.0, ["trust", "distrust"])
    spam = F.col("distrust") > (F.col("trust") + F.col("distrust")) * THRESHOLD
    verdict = F.coalesce(F.col("by_rule"), F.when(spam, "block").otherwise("allow")).alias("verdict")
    return out.select("page_id", "host", "path", "rule", verdict, F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
