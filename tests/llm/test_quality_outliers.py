"""Robust outliers where a third of a group are planted copies."""

import numpy as np

from pairlytics.llm import quality


def test_third_of_group_planted(spark):
    rng = np.random.default_rng(5)
    clean = [(i, int(rng.integers(80, 400))) for i in range(400)]
    rows = [(i, "en", "s", n, int(n * rng.normal(5, 0.2)), int(n * 0.01), 0, 0) for i, n in clean]
    rows += [(1000 + i, "en", "s", 9000, 9000 * 60, 9000 * 4, 9000, 2000) for i in range(200)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    d2 = {r["doc_id"]: r["d2"] for r in quality.outliers(stats).collect()}
    assert all(d2[i] > quality.CUTOFF for i in d2 if i >= 1000)
    assert all(d2[i] <= quality.CUTOFF for i in d2 if i < 1000)


SCHEMA = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def restated(rows):
    """Squared distances by the method of the docstring, in NumPy, with lower medians as the mergeable sketches give them."""
    floors = np.array(list(quality.FLOORS.values()))
    x = np.array([(np.log1p(n), np.log1p(c / max(n, 1)), np.sqrt(min(y / max(n, 1), 4.0)), d / (max(n, 1) / 20 + 1), r / max(n, 1)) for _, _, _, n, c, y, d, r in rows])
    names = [(lang, source) for _, lang, source, *_ in rows]
    groups = {"all": np.arange(len(rows)), **{g: np.array([i for i, k in enumerate(names) if k == g]) for g in set(names)}}
    low = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    weight = {g: 1.0 if g == "all" else len(i) / (len(i) + quality.PRIOR) for g, i in groups.items()}

    def shrunk(est):
        return {g: tuple(weight[g] * a + (1 - weight[g]) * b for a, b in zip(est[g], est["all"], strict=True)) for g in est}

    def distance(v, centre, scatter):
        e = v - centre
        return np.einsum("ij,ij->i", e, np.linalg.solve(scatter + np.diag(floors**2), e.T).T)

    est = {}
    for g, i in groups.items():
        m = low(x[i])
        est[g] = (m, np.diag((low(np.abs(x[i] - m)) * 1.4826) ** 2))
    est = shrunk(est)
    for _ in range(quality.C_STEPS):
        now = {}
        for g, i in groups.items():
            d = distance(x[i], *est[g])
            near = x[i][d <= low(d)]
            now[g] = (near.mean(0), np.cov(near.T, bias=True).reshape(5, 5) * quality.CONSISTENCY)
        est = shrunk(now)
    own = {g: max(1.0, low(distance(x[i], *est[g])) / quality.MEDIAN) for g, i in groups.items()}
    scale = {g: own[g] ** weight[g] * own["all"] ** (1 - weight[g]) for g in own}
    return {r[0]: float(distance(x[k : k + 1], *est[g])[0] / scale[g]) for k, (r, g) in enumerate(zip(rows, names, strict=True))}


def test_distances_against_restatement(spark):
    """Groups of many sizes, one of a single outlier, nulls as names, ties and repeated rows."""
    rng = np.random.default_rng(9)
    rows = []
    for lang, source, n in (("en", "a", 181), ("en", None, 61), (None, "b", 49), ("fr", "c", 7), ("fr", "d", 2)):
        rows += [(len(rows) + k, lang, source, int(w), int(w * rng.normal(5, 0.3)), int(w * rng.uniform(0, 0.05)), int(rng.integers(0, 3)), int(rng.integers(0, 9))) for k, w in enumerate(rng.integers(30, 500, n))]
    rows += [(900 + k, "en", "a", 100, 520, 1, 0, 0) for k in range(9)]
    rows += [(990, "xx", "alone", 9000, 9000 * 60, 9000 * 4, 9000, 2000)]
    d2 = {r["doc_id"]: r["d2"] for r in quality.outliers(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = restated(rows)
    assert d2.keys() == want.keys()
    for k, v in want.items():
        assert abs(d2[k] - v) <= 1e-6 * max(1.0, v), (k, d2[k], v)
    assert d2[990] > quality.CUTOFF


def test_no_rows(spark):
    assert quality.outliers(spark.createDataFrame([], SCHEMA)).collect() == []
