"""Rally, set and match probabilities, and exact propagation through a bracket."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rallies in a set, bounds of a rally's probability, points that win a set and the last one.
RALLIES, LOW, HIGH, SET, LAST = 43.44, 0.10, 0.90, 25, 15


def rally(margin: Column) -> Column:
    """Probability of a rally from the expected margin per set."""
    return F.least(F.lit(HIGH), F.greatest(F.lit(LOW), 0.5 + margin / (2 * RALLIES)))


def set_win(p: Column, target: int) -> Column:
    """Probability to reach target first, two points ahead; closed form: wins before a deuce, and the deuce.

    p is bound once by a lambda, and the sum over the loser's points is taken by Horner's rule, so that the expression
    stays small however often its parts are used.
    """
    ways = F.array(*[F.lit(float(comb(target - 1 + b, b))) for b in reversed(range(target - 1))])

    def win(x: Column) -> Column:
        q = 1 - x
        early = F.aggregate(ways, F.lit(0.0), lambda a, c: a * q + c) * F.pow(x, F.lit(target))
        return early + F.lit(float(comb(2 * target - 2, target - 1))) * F.pow(x * q, F.lit(target - 1)) * x * x / (1 - 2 * x * q)

    return F.get(F.transform(F.array(p), win), 0)


def match_parts(p: Column) -> dict[str, Column]:
    """Probabilities to win a best-of-five match in three, four and five sets."""
    s, last = set_win(p, SET), set_win(p, LAST)
    return {"p30": s * s * s, "p31": 3 * s * s * s * (1 - s), "p32": 6 * s * s * (1 - s) * (1 - s) * last}


def match_win(margin: Column) -> Column:
    """Probability to win a best-of-five match at an expected margin per set; the parts are bound once, as in `set_win`."""

    def win(x: Column) -> Column:
        s, last = x["s"], x["last"]
        q = 1 - s
        return s * s * s * (1 + 3 * q) + 6 * s * s * q * q * last

    sets = F.transform(F.array(rally(margin)), lambda p: F.struct(set_win(p, SET).alias("s"), set_win(p, LAST).alias("last")))
    return F.get(F.transform(sets, win), 0)


def titles(slots: DataFrame, pairs: DataFrame, rounds: int) -> DataFrame:
    """(team, p): probability to win the bracket of 2**rounds slots (slot, team); pairs (team, opp, p) holds every matchup.

    A round joins each team to those of the neighbouring half: P(a) = P'(a) * sum of P'(b) p(a, b). A matchup that is missing counts one half.
    """
    now = slots.select("slot", "team", F.lit(1.0).alias("p"))
    for r in range(rounds):
        side = F.shiftright("slot", r)
        mine = now.withColumn("half", side)
        other = now.select(side.bitwiseXOR(1).alias("half"), F.col("team").alias("opp"), F.col("p").alias("po"))
        met = mine.join(other, "half").join(pairs.withColumnRenamed("p", "pm"), ["team", "opp"], "left")
        now = met.groupBy("slot", "team", "p").agg(F.sum(F.col("po") * F.coalesce("pm", F.lit(0.5))).alias("beat")).select("slot", "team", (F.col("p") * F.col("beat")).alias("p"))
    return now.select("team", "p")
