"""Twelve measures of each team from its matches: seven raw ones and five adjusted for opponents and home games."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import adjustment, ratings
from .lineage import stored

RAW = ("rpi", "win_pct", "own_hit_eff", "opp_hit_eff", "hit_eff_diff", "net_points_set", "sideout_proxy")
ADJUSTED = ("adj_net_points_set", "adj_hit_eff_diff", "adj_own_hit_eff", "adj_opp_hit_eff", "adj_sideout_proxy")
BOX = ("kills", "errors", "attempts", "reception_errors", "reception_attempts")


def with_boxes(sides: DataFrame, boxes: DataFrame) -> DataFrame:
    """sides (gid, team, opp, ...) with the box of the team and, as opp_<column>, of the opponent; all null unless both have one."""
    mine = boxes.select("gid", "team", *BOX, F.lit(True).alias("_mine"))
    theirs = boxes.select("gid", F.col("team").alias("opp"), *[F.col(c).alias(f"opp_{c}") for c in BOX], F.lit(True).alias("_theirs"))
    out = sides.join(mine, ["gid", "team"], "left").join(theirs, ["gid", "opp"], "left")
    both = F.col("_mine") & F.col("_theirs")
    return out.withColumns({c: F.when(both, F.col(c)) for name in BOX for c in (name, f"opp_{name}")}).drop("_mine", "_theirs")


def observations(rows: DataFrame) -> DataFrame:
    """(team, opp, home, pts, hit, rec): points a set, hitting efficiency and reception of a side's match, null without a denominator."""
    pts = F.when(F.col("sets") != 0, F.col("pf") / F.col("sets"))
    hit = F.when(F.col("attempts") != 0, (F.col("kills") - F.col("errors")) / F.col("attempts"))
    rec = F.when(F.col("reception_attempts") != 0, 1 - F.col("reception_errors") / F.col("reception_attempts"))
    return rows.select("team", "opp", "home", pts.alias("pts"), hit.alias("hit"), rec.alias("rec"))


def raw(rows: DataFrame) -> DataFrame:
    """(team, the raw measures but the rating): from sums over a team's sides with boxes; null without a denominator."""
    total = lambda c: F.sum(c)
    own = F.try_divide(total("kills") - total("errors"), total("attempts"))
    opp = F.try_divide(total("opp_kills") - total("opp_errors"), total("opp_attempts"))
    return rows.groupBy("team").agg(
        F.avg("won").alias("win_pct"), own.alias("own_hit_eff"), (-opp).alias("opp_hit_eff"), (own - opp).alias("hit_eff_diff"),
        F.try_divide(total(F.col("pf") - F.col("pa")), total("sets")).alias("net_points_set"), (1 - F.try_divide(total("reception_errors"), total("reception_attempts"))).alias("sideout_proxy"),
    )


def build(sides: DataFrame, boxes: DataFrame, edges: DataFrame, adjusted: bool = True) -> DataFrame:
    """(team and the measures): one row for each team that played."""
    rows = stored(with_boxes(sides, boxes))
    out = ratings.rpi(edges).select("team", "rpi").join(raw(rows), "team", "full").select("team", *RAW)
    if not adjusted:
        return out
    fit = adjustment.solve(observations(rows), ["pts", "hit", "rec"])
    adj = fit.select("team", (F.col("pts_off") + F.col("pts_def")).alias("adj_net_points_set"), (F.col("hit_off") + F.col("hit_def")).alias("adj_hit_eff_diff"), F.col("hit_off").alias("adj_own_hit_eff"), F.col("hit_def").alias("adj_opp_hit_eff"), F.col("rec_off").alias("adj_sideout_proxy"))
    return out.join(adj, "team", "left")
