"""Logistic weights, composites, evaluation by resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import digests
from .lineage import stored

#: Penalty of all logistic weights, and bound of a sigmoid's argument.
L2, CLAMP = 1e-3, 30.0
#: Rows of a table that a range of scores of its resamples stands for, rows of a shuffle that are dealt with together, and places of a block of draws.
RANGE_SCORES, SORTED_ROWS, PLACES = 200_000, 10_000, 1 << 15
#: Deviations of a uniform digest's order statistic within which a shuffle's first group is looked for at first; all of the digest's range beyond.
DEVIATIONS = 5.0


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.lit(CLAMP), F.greatest(F.lit(-CLAMP), z))))


def logistic(rows: DataFrame, features: list[str], label: str, iterations: int = 12) -> list[float]:
    """Weights (intercept first) that minimise the mean log loss plus L2 / 2 times the squares of all of them.

    Newton steps: each is one aggregation of gradient and curvature, so rows stay where they are.
    """
    held = rows.select(F.lit(1.0).alias("_0"), *[F.col(f).cast("double") for f in features], F.col(label).cast("double").alias("_y")).dropna().persist()
    names, w = ["_0", *features], np.zeros(len(features) + 1)
    for _ in range(iterations):
        z = sum((F.lit(float(v)) * F.col(n) for v, n in zip(w[1:], names[1:], strict=True)), F.lit(float(w[0])))
        p = sigmoid(z)
        curve = [(i, j) for i in range(len(names)) for j in range(i + 1)]
        got = held.agg(*[F.avg((p - F.col("_y")) * F.col(n)) for n in names], *[F.avg(p * (1 - p) * F.col(names[i]) * F.col(names[j])) for i, j in curve]).first()
        if got[0] is None:
            break
        hess = np.zeros((len(names), len(names)))
        for (i, j), v in zip(curve, got[len(names) :], strict=True):
            hess[i, j] = hess[j, i] = v
        step = np.linalg.solve(hess + L2 * np.eye(len(names)), np.array(got[: len(names)]) + L2 * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    held.unpersist()
    return w.tolist()


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with z_<column>, by mean and population deviation over all rows (a deviation of 0 counts as 1)."""
    stats = rows.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    z = {f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return rows.join(F.broadcast(stats)).withColumns(z).drop(*stats.columns)  # stats is one row


def scaled_as(fit: DataFrame, rows: list[DataFrame], columns: list[str]) -> list[DataFrame]:
    """rows with z_<column> by mean and population deviation of fit (a deviation of 0 counts as 1); a driver-held row of statistics."""
    s = fit.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    z = {f"z_{c}": (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] or 1.0) for c in columns}
    return [r.withColumns(z) for r in rows]


def linear(weights: list[float], names: list[str]) -> Column:
    """Intercept and weighted sum, rounded so that equal rows tie."""
    return F.round(sum((F.lit(w) * F.col(n) for w, n in zip(weights[1:], names, strict=True)), F.lit(weights[0])), 10)


def incremental_auc(fit: DataFrame, test: DataFrame, base: list[str], extra: str, label: str, place: str, resamples: int) -> DataFrame:
    """One row (n, auc_base, auc_full, gain, low, high): what `extra` adds on test to a logistic model of the base columns.

    Both models are fitted on fit, whose means and deviations also scale test. The interval of the gain is that of
    resamples which draw the same rows for both models; `place` numbers test's rows from 0. Null where a class is empty.
    """
    columns = [*base, extra]
    fit, test = scaled_as(fit, [fit, test], columns)
    scores = {name: linear(logistic(fit, zs, label), zs) for name, zs in (("base", [f"z_{c}" for c in base]), ("full", [f"z_{c}" for c in columns]))}
    scored = test.select(F.col(place).alias("i"), F.col(label).alias("y"), *[v.alias(k) for k, v in scores.items()])
    scored = stored(scored)
    n = scored.count()
    both = resampled_aucs(scored, "i", ["base", "full"], "y", resamples)
    both = stored(both.withColumn("gain", F.col("auc_full") - F.col("auc_base")))  # one row a replicate
    low_high = interval(both.where("rep > 0 AND gain IS NOT NULL"), "gain").select("low", "high")
    return both.where("rep = 0").select(F.lit(n).cast("long").alias("n"), "auc_base", "auc_full", "gain").join(F.broadcast(low_high))  # one row each


def differences(matches: DataFrame, metrics: DataFrame, columns: list[str]) -> DataFrame:
    """matches with d_<column>, the first side's value less the second's, and y = 1 if the first won; rows lacking a value go."""
    a = metrics.select(F.col("team").alias("team_a"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = metrics.select(F.col("team").alias("team_b"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    d = {f"d_{c}": F.col(f"_a_{c}") - F.col(f"_b_{c}") for c in columns}
    out = matches.join(a, "team_a").join(b, "team_b").withColumns(d | {"y": (F.col("winner") == 0).cast("int")})
    return out.drop(*[x for c in columns for x in (f"_a_{c}", f"_b_{c}")]).dropna(subset=list(d))


def drawn(trial: Column, place: Column, n: Column) -> Column:
    """A number under n that md5 of trial and place gives."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", trial, place).cast("binary")), 1, 8), 16, 10).cast("long") % n


def auc_by(rows: DataFrame, by: str, score: str, label: str, scores: DataFrame | None = None) -> DataFrame:
    """(by, auc): Mann-Whitney per group, ties count half, null where a class is empty.

    Counts per group and score come first. Running sums over them are taken by group and range of scores, above the sums of the ranges before; the
    ranges are cut so that a range has some RANGE_SCORES rows of `scores`, the table that groups are drawn from (one range without it).
    """
    per = rows.groupBy(by, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    cut = per.withColumn("_r", _range_of(scores, score))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(by, "_r").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumn("_inside", inside)
    ranges = cut.groupBy(by, "_r").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("_inside") + F.col("n") / 2)).alias("w"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    total = F.sum(F.col("w") + F.col("p") * F.col("_before"))
    return ranges.withColumn("_before", before).groupBy(by).agg(F.try_divide(total, (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def _range_of(scores: DataFrame | None, score: str, size: int | None = None) -> Column:
    """Number of the range of a score, by cuts at approximate quantiles of a table; 0 if one range of `size` rows (RANGE_SCORES) will do."""
    n, size = 0 if scores is None else scores.count(), size or RANGE_SCORES
    if n <= size:
        return F.lit(0)
    parts = -(-n // size)
    cuts = scores.agg(F.percentile_approx(score, [i / parts for i in range(1, parts)], 10_000)).first()[0]
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(score)))


def _times(rows: DataFrame, name: str, count: int, n: int) -> DataFrame:
    """rows (n of them) with 1..count in column `name`. A small table may be one partition: it is dealt out by parts of the numbers before it grows."""
    if n > RANGE_SCORES:
        return rows.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(count))))
    parts = min(count, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.withColumn("_part", F.explode(F.sequence(F.lit(1), F.lit(parts)))).repartition(parts, "_part")
    return dealt.withColumn(name, F.explode(F.sequence(F.col("_part"), F.lit(count), F.lit(parts)))).drop("_part")


def resampled(rows: DataFrame, place: str, resamples: int) -> DataFrame:
    """(rep and rows' columns): each replicate from 1 on draws as many rows as there are, by md5 of its number and the place; `place` numbers rows from 0."""
    n = rows.count()
    draws = _times(rows.select(F.col(place).alias("_i")), "rep", resamples, n)
    return draws.select("rep", drawn(F.col("rep"), F.col("_i"), F.lit(n)).alias(place)).join(rows, place)


def resampled_aucs(rows: DataFrame, place: str, scores: list[str], label: str, resamples: int) -> DataFrame:
    """(rep, auc_<score> of each score): Mann-Whitney per replicate of `resampled` and, as replicate 0, of rows itself; ties count half, null where a class is empty.

    Draws travel packed. A task of some places makes their draws of all replicates, dealt by blocks of the places drawn, two bytes each; a block counts how often each
    of its rows is drawn in each replicate and sends that along with the row, to its range of scores. A range sums up by itself, above the sums of the ranges before.
    rows should be stored; `place` numbers them from 0.
    """
    n = rows.count()
    block = lambda c: F.floor(c / PLACES).cast("int")
    drawn_ = rows.select(F.col(place).cast("long").alias("i")).repartition(max(1, -(-n // PLACES)), block(F.col("i"))).mapInArrow(_draws(n, resamples), "block int, drawn binary")
    held = rows.select(block(F.col(place)).alias("block"), F.col(place).cast("long").alias("i"), F.col(label).cast("int").alias("y"), *[F.col(s).cast("double").alias(s) for s in scores])
    counts = stored(drawn_.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(_counts(resamples, scores), "s int, score double, y int, times binary"))
    cut = F.coalesce(*[F.when(F.col("s") == k, _range_of(rows.select(F.col(s).cast("double").alias("score")), "score", PLACES)) for k, s in enumerate(scores)])
    ranges = counts.withColumn("r", cut).groupBy("s", "r").applyInArrow(_range_sums(resamples), "s int, r int, rep int, p long, n long, w double")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s", "rep").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    auc = F.try_divide(F.sum(F.col("w") + F.col("p") * F.col("before")), (F.sum("p") * F.sum("n")).cast("double"))
    per = ranges.withColumn("before", before).groupBy("rep", "s").agg(auc.alias("auc"))
    return per.groupBy("rep").agg(*[F.max(F.when(F.col("s") == k, F.col("auc"))).alias(f"auc_{s}") for k, s in enumerate(scores)])


def _draws(n: int, resamples: int):
    """(block, drawn): the replicates' draws of the places given, by block of the places drawn: number of draws of each replicate, then their places in the block."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PLACES):
                texts = [b"%d" % i for i in batch.column(0).slice(at, PLACES).to_pylist()]
                keys = digests.Keys(texts)
                blocks = -(-n // PLACES)
                sizes, parts = np.zeros((blocks, resamples), np.uint32), [[] for _ in range(blocks)]
                for rep in range(1, resamples + 1):
                    i = np.sort(keys.first32(b"%d|" % rep) .astype(np.int64) % n)
                    ends = np.searchsorted(i, np.arange(1, blocks + 1) * PLACES)
                    sizes[:, rep - 1] = np.diff(ends, prepend=0)
                    small = (i % np.uint32(PLACES)).astype(np.uint16)
                    for b in np.flatnonzero(sizes[:, rep - 1]).tolist():
                        parts[b].append(small[ends[b] - sizes[b, rep - 1] : ends[b]])
                used = [b for b in range(blocks) if parts[b]]
                packed = [sizes[b].tobytes() + np.concatenate(parts[b]).tobytes() for b in used]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["block", "drawn"])

    return draw


def _counts(resamples: int, scores: list[str]):
    """For each score's number s: a block's scores and labels with how often their rows are drawn, replicate 0 once a row, packed in the least width that will do."""

    def count(drawn_: pa.Table, held: pa.Table) -> pa.Table:
        place, y = held.column("i").to_numpy() % PLACES, held.column("y").to_numpy()
        times = np.zeros((resamples + 1, PLACES), np.int32)
        times[0] = 1
        for raw in drawn_.column("drawn"):
            raw = raw.as_py()
            sizes = np.frombuffer(raw, np.uint32, resamples).astype(np.int64)
            at = np.frombuffer(raw, np.uint16, offset=4 * resamples)
            for rep, end in enumerate(np.cumsum(sizes).tolist(), 1):
                times[rep] += np.bincount(at[end - sizes[rep - 1] : end], minlength=PLACES).astype(np.int32)
        out = []
        for k, s in enumerate(scores):
            value = held.column(s).to_numpy()
            order = np.lexsort((y, value))
            v, u = value[order], y[order]
            starts = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (u[1:] != u[:-1])))
            summed = np.add.reduceat(times[:, place[order]], starts, axis=1)  # equal scores share a row, so a frequent one stays small
            packed = np.ascontiguousarray(summed.T.astype(np.min_scalar_type(int(summed.max()))))
            out.append(pa.table({"s": np.full(len(starts), k, np.int32), "score": v[starts], "y": u[starts].astype(np.int32), "times": pa.array([x.tobytes() for x in packed], pa.binary())}))
        return pa.concat_tables(out)

    return count


def _range_sums(resamples: int):
    """(s, r, rep, p, n, w) of a range of scores: positives and negatives drawn, and the pairs inside that are in order, ties half."""

    def sums(rows: pa.Table) -> pa.Table:
        score, y, times = rows.column("score").to_numpy(), rows.column("y").to_numpy(), rows.column("times")
        order = np.argsort(score, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(score[order]) != 0))
        cuts = np.unique(np.append(starts[np.minimum(np.searchsorted(starts, np.arange(0, len(order), 2048)), len(starts) - 1)], len(order)))
        p, n, w = (np.zeros(resamples + 1, k) for k in (np.int64, np.int64, np.float64))
        for a, b in zip(cuts, cuts[1:], strict=False):  # some whole scores at a time
            raw = times.take(order[a:b]).to_pylist()
            wide = np.stack([np.frombuffer(x, f"u{len(x) // (resamples + 1)}") for x in raw]).astype(np.int64)
            first = starts[(starts >= a) & (starts < b)] - a
            up, down = (np.add.reduceat(wide * (y[order[a:b]] == c)[:, None], first) for c in (1, 0))
            w += (up * (np.cumsum(down, axis=0) - down + n + down / 2)).sum(axis=0)
            p, n = p + up.sum(axis=0), n + down.sum(axis=0)
        same = lambda c: np.full(resamples + 1, rows.column(c)[0].as_py(), np.int32)
        return pa.table({"s": same("s"), "r": same("r"), "rep": np.arange(resamples + 1, dtype=np.int32), "p": p, "n": n, "w": w})

    return sums


def interval(values: DataFrame, value: str) -> DataFrame:
    """(n, low, high): the values at the places floor(.025 n) and floor(.975 n) - 1 of the sorted ones (resamples: a bounded number)."""
    v = F.array_sort(F.collect_list(value))
    at = lambda f, less: F.get("v", (F.floor(F.lit(f) * F.size("v")) - less).cast("int"))
    return values.agg(v.alias("v")).select(F.size("v").cast("long").alias("n"), at(0.025, 0).alias("low"), at(0.975, 1).alias("high"))


def permutation_gap(rows: DataFrame, key: str, group: str, value: str, trials: int) -> DataFrame:
    """(gap, p): difference of the means of group 1 and 0, and the share of shuffles at least as far apart, (hits + 1) / (trials + 1).

    A shuffle orders the keys by md5 of trial and key, and its first group are the first of them. It isn't sorted whole: sums are taken by trial and
    leading digits of the digest, and only the digits in which the first group ends are sorted. Rows without a group are left out, an empty
    group gives null.
    """
    pool = stored(rows.where(F.col(group).isNotNull()).select(F.col(key).alias("_key"), F.col(group).cast("int").alias("g"), F.col(value).cast("double").alias("x")))
    real = pool.agg((F.avg(F.when(F.col("g") == 1, F.col("x"))) - F.avg(F.when(F.col("g") == 0, F.col("x")))).alias("gap"), F.sum("g").alias("n1"), F.count("*").alias("n"), F.sum("x").alias("s")).first()
    if real["gap"] is None:
        return pool.sparkSession.createDataFrame([(None, None)], "gap double, p double")
    n, n1 = real["n"], real["n1"]
    one = _first_sums(pool, n, n1, trials)
    gap = F.col("s1") / n1 - (real["s"] - F.col("s1")) / (n - n1)
    hits = F.count_if(F.round(F.abs(gap), 12) >= round(abs(real["gap"]), 12))
    return one.agg(F.lit(real["gap"]).alias("gap"), ((hits + 1) / (trials + 1)).alias("p"))


def _first_sums(pool: DataFrame, n: int, n1: int, trials: int) -> DataFrame:
    """(trial, s1): the sum of x over the first n1 of pool (_key, x) in the order of md5 of trial and key.

    Digests are uniform, so the first group ends near the share n1 / n of their range. Rows surely before that are summed where they lie and only those
    within DEVIATIONS of it are sent to be sorted; trials whose group ends elsewhere, by the counts, are sorted over the whole range.
    """
    wide = DEVIATIONS * (n1 / n * (1 - n1 / n) / n) ** 0.5
    low, high = (min(1 << 32, max(0, int((n1 / n + d) * 2**32))) for d in (-wide, wide))
    keys = pool.select(F.col("_key").cast("string").cast("binary").alias("key"), "_key", "x")
    kept = stored(keys)
    parts = min(n, math.ceil(n / SORTED_ROWS))
    tasks = max(parts, min(trials, 4 * pool.sparkSession.sparkContext.defaultParallelism))
    slices = -(-tasks // parts)  # a small table is dealt out by parts of the trials
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = dealt.select("part", "slice", "key", "x").repartition(tasks, "part", "slice")
    kind = "trial int, low_n long, low_s double, near binary"
    told = stored(dealt.groupBy("part", "slice").applyInArrow(_told(trials, slices, low, high), kind))
    sums = told.groupBy("trial").applyInArrow(_placed(n1), "trial int, s1 double")
    sums = stored(sums)
    missed = sums.where("s1 IS NULL").select("trial")
    one = sums.where("s1 IS NOT NULL")
    if not missed.isEmpty():
        each = kept.crossJoin(F.broadcast(missed)).withColumn("h", F.md5(F.concat(F.col("trial").cast("string"), F.lit("|"), F.col("key").cast("string")).cast("binary")))
        place = F.row_number().over(Window.partitionBy("trial").orderBy("h", "_key"))
        one = one.unionByName(each.withColumn("place", place).where(F.col("place") <= n1).groupBy("trial").agg(F.sum("x").alias("s1")))
    return one


def _told(trials: int, slices: int, low: int, high: int):
    """Of some keys and each trial of a slice: how many digests are below `low`, the sum of their x, and digest, key and x of those up to `high`."""

    def tell(rows: pa.Table) -> pa.Table:
        first = rows.column("slice")[0].as_py() + 1
        texts = rows.column("key").to_pylist()
        x = rows.column("x").to_numpy()
        keys, out = digests.Keys(texts), []
        for trial in range(first, trials + 1, slices):
            words = keys.words(b"%d|" % trial)
            h = words[0].astype(np.int64)
            below, near = h < low, np.flatnonzero((h >= low) & (h <= high))
            found = words[:, near].astype(np.uint32)
            out.append((trial, int(below.sum()), float(x[below].sum()), found.tobytes() + x[near].tobytes()))
        t, c, s, b = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"trial": pa.array(t, pa.int32()), "low_n": pa.array(c, pa.int64()), "low_s": pa.array(s, pa.float64()), "near": pa.array(b, pa.binary())})

    return tell


def _placed(n1: int):
    """The sum of a trial's first n1; null where they don't end among those sent."""

    def place(rows: pa.Table) -> pa.Table:
        want = n1 - sum(rows.column("low_n").to_pylist())
        raw = rows.column("near").to_pylist()
        words = np.concatenate([np.frombuffer(b, np.uint32, len(b) // 24 * 4).reshape(4, -1) for b in raw], axis=1)
        x = np.concatenate([np.frombuffer(b, np.float64, offset=len(b) // 24 * 16) for b in raw])
        s1 = None
        if 0 <= want <= len(x):
            order = np.lexsort(words[::-1])[:want]
            s1 = sum(rows.column("low_s").to_pylist()) + float(x[order].sum())
        return pa.table({"trial": pa.array([rows.column("trial")[0].as_py()], pa.int32()), "s1": pa.array([s1], pa.float64())})

    return place
