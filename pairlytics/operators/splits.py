"""Measures judged on matches they haven't seen: all splits side by side in one job, told apart by a column.

Teams are keyed by (split, team) while measures are built, so that no row of one split meets one of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import matches as M
from . import metrics, models, ratings
from .lineage import stored

TOURNAMENT = "tournament"


def parts(rows: DataFrame, cutoffs: list[str]) -> DataFrame:
    """rows (date, championship) with split and part, once for each split they are in.

    tournament: championship rows are its test, all others fit it. A cutoff (ISO date): rows before it fit, those from it on are the
    test, those without a date in neither. A null championship is false.
    """
    champion = F.coalesce("championship", F.lit(False))
    by_date = [F.struct(F.lit(c).alias("split"), F.when(F.col("date") < F.lit(c).cast("date"), "fit").when(F.col("date") >= F.lit(c).cast("date"), "test").alias("part")) for c in cutoffs]
    every = F.array(F.struct(F.lit(TOURNAMENT).alias("split"), F.when(champion, "test").otherwise("fit").alias("part")), *by_date)
    return rows.withColumn("_s", F.explode(every)).select("*", "_s.split", "_s.part").drop("_s").where("part IS NOT NULL")


def fitted(matches: DataFrame, boxes: DataFrame, cutoffs: list[str]) -> DataFrame:
    """(split, team and the raw measures) from the matches that fit each split; boxes are joined once, before rows are dealt to splits."""
    sides = stored(metrics.with_boxes(M.sides(matches), boxes))
    keyed = lambda c: F.struct("split", F.col(c).alias("id"))
    fit = parts(sides, cutoffs).where("part = 'fit'").withColumns({"team": keyed("team"), "opp": keyed("opp")})
    edges = fit.where("won = 1").select(F.col("team").alias("winner"), F.col("opp").alias("loser"), "gid")
    out = ratings.rpi(edges).select("team", "rpi").join(metrics.raw(fit), "team", "full")
    return out.select("team.split", F.col("team.id").alias("team"), *metrics.RAW)


def standalone(matches: DataFrame, boxes: DataFrame, cutoffs: list[str], min_fit: int, min_test: int) -> DataFrame:
    """(split, metric, n_fit, n, accuracy, auc): how well each measure's difference tells the winner of the split's test matches.

    A match counts for a measure that both of its teams have; a difference of zero counts as a call against the first team. Accuracy
    and auc are null where a split has fewer than min_fit fitting matches or a measure fewer than min_test to be tested on.
    """
    values = stored(fitted(matches, boxes, cutoffs))
    side = lambda s: values.select("split", F.col("team").alias(f"team_{s}"), F.struct(*metrics.RAW).alias(s))
    dealt = parts(matches, cutoffs)
    test = dealt.where("part = 'test'").join(side("a"), ["split", "team_a"]).join(side("b"), ["split", "team_b"])
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(f"a.{m}") - F.col(f"b.{m}"), 10).alias("score")) for m in metrics.RAW])
    scored = test.select("split", (F.col("winner") == 0).cast("int").alias("y"), F.explode(each).alias("x")).where("x.score IS NOT NULL")
    scored = stored(scored.select(F.struct("split", "x.metric").alias("k"), "x.score", "y"))
    hit = ((F.col("score") > 0) == (F.col("y") == 1)).cast("int")
    out = scored.groupBy("k").agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy")).join(models.auc_by(scored, "k", "score", "y", scored), "k")
    sizes = dealt.groupBy("split").agg(F.count_if(F.col("part") == "fit").alias("n_fit"))
    out = out.select("k.*", "n", "accuracy", "auc").join(sizes, "split")
    enough = (F.col("n_fit") >= min_fit) & (F.col("n") >= min_test)
    return out.select("split", "metric", "n_fit", "n", *[F.when(enough, F.col(c)).alias(c) for c in ("accuracy", "auc")])


def stability(results: DataFrame, base: str) -> DataFrame:
    """results with rank (by auc in its split, then name; null without auc) and shift, its places below those in the base split."""
    place = F.row_number().over(Window.partitionBy("split").orderBy(F.round("auc", 8).desc_nulls_last(), "metric"))  # a row per measure
    ranks = results.withColumn("rank", F.when(F.col("auc").isNotNull(), place).cast("long"))
    first = F.max(F.when(F.col("split") == base, F.col("rank"))).over(Window.partitionBy("metric"))  # a row per split
    return ranks.withColumn("shift", F.col("rank") - first)
