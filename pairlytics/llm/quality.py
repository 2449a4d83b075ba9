"""Quality rules with robust multivariate outliers (DataFrame functions only).

Base rules: a text with under `MIN_WORDS` words, or whose repeated 8-word windows cover over 30% of its words, fails.
Method: the statistics of every document are transformed (logarithms and shares) and, per language and source, their
minimum-covariance-determinant centre and scatter are estimated: from medians and median deviations, `C_STEPS`
concentration steps each keep the half of the documents that lie nearest and take mean and covariance anew, times
`CONSISTENCY`, so outliers (copies too) may make up any share under a half. Where the median squared distance is still
over that of a normal sample, the scatter is scaled up to it; it is never scaled down, which would undo the floors. A
document is rejected if its squared Mahalanobis distance is over `CUTOFF`. Every group's centre, scatter and scale are
shrunk to those of all documents together, with the weight n / (n + `PRIOR`) for its own n documents, so nothing jumps
at any size: a large group stands by itself, a tiny one (an outlier alone in its source) is judged by all. A squared
distance is convex in centre and scatter, so what both estimates accept their mean accepts too.

All sums, quantiles (mergeable sketches, relative rank error 1/10,000) and moments are partial aggregates, so a hot
group costs no more than its rows. Window equality is that of 64-bit hashes of words.

Cases: null text has no words and fails; null lang or source is a group of its own; repeated rows each get a row;
a constant statistic can't reject what equals it (each scale has the floor `FLOORS`); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, small, split_words, stored, table
from .decontaminate import kgram_hashes

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: Transformed statistics in order, each with the least standard deviation that is taken for it.
FLOORS = {"x1": 0.5, "x2": 0.15, "x3": 0.1, "x4": 0.05, "x5": 0.06}
SUBSET, C_STEPS, PRIOR = 0.5, 3, 50
#: Covariance of a 5-dimensional normal sample over that of its nearest half: 0.5 / P(chi-square with 7 degrees < MEDIAN).
CONSISTENCY = 1.9123
#: Chi-square with 5 degrees of freedom: median, and the 1 - 1e-9 quantile.
MEDIAN, CUTOFF = 4.3515, 53.0
X = list(FLOORS)
ALL = "all"  #: group of all documents; the names of the others are JSON objects
PAIRS = [(i, j) for i in range(len(X)) for j in range(i + 1)]
ACCURACY = 10_000


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the long counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = docs.select("doc_id", "lang", "source", text.alias("text"), split_words(F.col("text")).alias("words"), lines.alias("lines"))
    df = df.select(
        "doc_id", "lang", "source", "words",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
    )
    df = kgram_hashes(df, "words", WINDOW, "windows")
    whole = F.slice("windows", F.lit(1), F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)))
    df = df.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", whole.alias("windows"))
    # only texts with a repeated window are sorted: (hash, place), equal hashes side by side
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    df = df.withColumn("pairs", F.when(F.size("windows") > F.size(F.array_distinct("windows")), pairs).otherwise(none))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter("pairs", lambda x, i: same(x, F.get("pairs", i - 1)) | same(x, F.get("pairs", i + 1)))
    df = df.drop("windows").withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["p"])))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    longs = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")]
    return df.select("doc_id", "lang", "source", *longs, covered.cast("long").alias("n_repeat_words"))


def _transformed(stats: DataFrame) -> DataFrame:
    """stats with the vector x1..x5; shares are of words, so they don't grow with the text."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns({
        "x1": F.log1p("n_words"), "x2": F.log1p(F.col("word_chars") / n), "x3": F.sqrt(F.least(F.col("n_symbols") / n, F.lit(4.0))),
        "x4": F.col("n_dup_lines") / (n / 20 + 1), "x5": F.col("n_repeat_words") / n,
    })


def _distance(centre: dict[str, Column], factor: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor's columns."""
    y: list[Column] = []
    for i, x in enumerate(X):
        r = F.col(x) - centre[x]
        for j in range(i):
            r = r - factor[i, j] * y[j]
        y.append(r / factor[i, i])
    total = y[0] * y[0]
    for v in y[1:]:
        total = total + v * v
    return total


def _factor(moments: DataFrame) -> DataFrame:
    """group, m_x1.. and the Cholesky factor l_i_j of the covariance s_i_j, floored on its diagonal.

    The floor is added to the diagonal, which keeps the matrix positive definite whatever the data.
    """
    df = moments
    for i in range(len(X)):
        for j in range(i + 1):
            s = F.col(f"s_{i}_{j}")
            if i == j:
                s = F.greatest(s, F.lit(0.0)) + list(FLOORS.values())[i] ** 2
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(s, F.lit(1e-9))) if i == j else s / F.col(f"l_{j}_{j}"))
    return df.select("group", *[f"m_{x}" for x in X], *[f"l_{i}_{j}" for i, j in PAIRS])


def _weight() -> Column:
    """Share of a group's own estimate; that of all documents stands by itself."""
    return F.when(F.col("group") == ALL, F.lit(1.0)).otherwise(F.col("n") / (F.col("n") + PRIOR))


def _shrunk(moments: DataFrame) -> DataFrame:
    """moments (group, n, m_x1.., s_i_j) drawn to those of the group `ALL`, a single row that becomes literals."""
    every = moments.where(F.col("group") == ALL).first()
    drawn = [(_weight() * F.col(c) + (1 - _weight()) * F.lit(every[c])).alias(c) for c in moments.columns if c[:2] in ("m_", "s_")]
    return moments.select("group", *drawn)


def _with_distance(df: DataFrame, estimate: DataFrame) -> DataFrame:
    joined = df.join(estimate, "group")
    d = _distance({x: F.col(f"m_{x}") for x in X}, {p: F.col(f"l_{p[0]}_{p[1]}") for p in PAIRS})
    return joined.select(*df.columns, d.alias("d2"))


def outliers(stats: DataFrame) -> DataFrame:
    """stats (of documents that passed the base rules) with d2, the scaled squared robust distance."""
    df = _transformed(stats).withColumn("group", F.to_json(F.struct("lang", "source"))).select(*stats.columns, *X, "group")
    df = stored(df)
    if df.isEmpty():
        return stats.withColumn("d2", F.lit(None).cast("double"))
    fit = df.select(F.explode(F.array("group", F.lit(ALL))).alias("group"), *X)  # every document counts for its group and for all

    middle = fit.groupBy("group").agg(*[F.percentile_approx(x, 0.5, ACCURACY).alias(f"m_{x}") for x in X])
    spread = fit.join(small(middle := stored(middle)), "group").groupBy("group", *[f"m_{x}" for x in X])
    spread = spread.agg(F.count("*").alias("n"), *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, ACCURACY).alias(f"d_{x}") for x in X])
    estimate = stored(spread.select(
        "group", "n", *[f"m_{x}" for x in X],
        *[(F.pow(F.col(f"d_{X[i]}") * 1.4826, 2) if i == j else F.lit(0.0)).alias(f"s_{i}_{j}") for i, j in PAIRS],
    ))
    estimate = stored(_factor(_shrunk(estimate)))
    for _ in range(C_STEPS):
        near = _with_distance(fit, small(estimate))
        limit = stored(near.groupBy("group").agg(F.percentile_approx("d2", SUBSET, ACCURACY).alias("limit"), F.count("*").alias("n")))
        kept = near.join(small(limit), "group").where("d2 <= limit")
        moments = kept.groupBy("group", "n").agg(*[F.avg(x).alias(f"m_{x}") for x in X], *[(F.covar_pop(X[i], X[j]) * CONSISTENCY).alias(f"s_{i}_{j}") for i, j in PAIRS])
        estimate = stored(_factor(_shrunk(stored(moments))))
    medians = _with_distance(fit, small(estimate)).groupBy("group").agg(F.greatest(F.percentile_approx("d2", 0.5, ACCURACY) / MEDIAN, F.lit(1.0)).alias("own"), F.count("*").alias("n"))
    medians = stored(medians)
    every = medians.where(F.col("group") == ALL).first()["own"]
    scale = stored(medians.select("group", (F.pow("own", _weight()) * F.pow(F.lit(every), 1 - _weight())).alias("scale")))  # shrunk as a factor
    out = _with_distance(df, small(estimate)).join(small(scale), "group")
    return out.select(*stats.columns, (F.col("d2") / F.col("scale")).alias("d2"))


def judge(docs: DataFrame) -> DataFrame:
    """The statistics of every document, base_failed, d2 (null where the base rules fail) and kept."""
    stats = stored(statistics(docs))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    passed = outliers(stats.where(~failed))
    bad = stats.where(failed).withColumn("d2", F.lit(None).cast("double"))
    both = passed.withColumn("base_failed", F.lit(False)).unionByName(bad.withColumn("base_failed", F.lit(True)))
    return both.withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= CUTOFF))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2"]
    return judge(table(spark, sf_dir, "documents")).select(*columns)
