"""Centroid clustering of integer vectors: exact Lloyd rounds over packed blocks.

Vectors are scaled and packed once, and written; each round reads the blocks, expands the squared distances as
|x|^2 - 2 x.c + |c|^2 by float64 matrix products (integers where a bound on the magnitudes says that doubles could be
inexact, see `vectors`), and an RDD treeAggregate adds up each cluster's sums and count. Sums across blocks are Python
integers, so nothing overflows. The driver holds k centroids and their sums, of at most MAX_CELLS numbers.

Cases: vectors that are null, of another length, or with null or non-finite components are left out; repeated rows all
count; of equal hashes the smaller vector starts first; a vector without id takes part, but starts no cluster; fewer
vectors than k give fewer clusters, an empty table no rows; other columns aren't looked at. Ties go to the smaller
number. Distances and inertias beyond 64 bits are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import settings_of_jobs, stored, table

K, ROUNDS, WIDTH, SEED = 8, 10, 64, 3
MAX_CELLS = 1 << 20
LONG = 2**63


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """(ids, kind, data): packed blocks of rows (vec_id long, x array<double> of that width, usable)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, V.BLOCK):
                part = batch.slice(at, V.BLOCK)
                kind, data = V.pack(V.scaled(V.matrix(part.column(1), width)))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([kind]), pa.array([data], pa.binary())], names=["ids", "kind", "data"])

    return rows.select("vec_id", "x").mapInArrow(run, "ids array<long>, kind string, data binary")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, ties to the smaller, and the squared distance."""
    best, far = np.zeros(len(x), np.int32), np.zeros(len(x), object)
    for at, d in V.squared_distances(x, centroids):
        i = d.argmin(1)
        best[at] = i
        low = d[np.arange(len(d)), i]
        far[at] = low if low.dtype == object else low.astype(np.int64)
    return best, far


def cluster_sums(x: np.ndarray, best: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums of the rows of each cluster, as Python integers."""
    top = len(x) * V.magnitude(x)
    kind = "f8" if top < V.EXACT_DOUBLE else "i8" if top < V.EXACT_LONG else "O"
    member = (best[None, :] == np.arange(k)[:, None]).astype(np.int8)
    return V.whole(V.as_kind(member, kind) @ V.as_kind(x, kind))


def _totals(packed: DataFrame, centroids: np.ndarray, width: int) -> tuple:
    """(sums, counts, inertias) of each centroid's vectors, by a tree of partial sums."""
    k = len(centroids)

    def add(total, row):
        x = V.unpack(row["kind"], row["data"], width)
        best, far = nearest(x, centroids)
        counts = np.bincount(best, minlength=k)
        inertia = [sum(far[best == i].tolist()) for i in range(k)]
        return merge(total, (cluster_sums(x, best, k), counts.astype(object), np.array(inertia, object)))

    def merge(a, b):
        return b if a is None else a if b is None else tuple(p + q for p, q in zip(a, b, strict=True))

    return packed.select("kind", "data").rdd.treeAggregate(None, add, merge)


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id IS NOT NULL").select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return V.scaled(np.array([r["x"] for r in first], np.float64)) if first else np.zeros((0, 0))


def clusters(vectors: DataFrame, vector: str = "embedding", k: int = K, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every usable vector, after `rounds` rounds from hashed starts.

    centroid is the final one's components, joined by commas. Rounds end early once no centroid moves: later ones would change nothing.
    """
    if k * width > MAX_CELLS:
        raise ValueError(f"{k} centroids of {width} components: the driver holds {MAX_CELLS} at most")
    spark = vectors.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid string"
    good = V.usable(F.col(vector)) & (F.size(vector) == width)
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    centroids = starts(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    packed = stored(blocks(rows, width))
    with settings_of_jobs(spark):
        for _ in range(rounds):
            sums, counts, _ = _totals(packed, centroids, width)
            moved = [[int(v) // n for v in s] if n else [int(v) for v in c] for s, n, c in zip(sums, counts.tolist(), centroids, strict=True)]
            after = _integers(moved)
            if (after == centroids).all():
                break
            centroids = after
        inertia = [int(v) for v in _totals(packed, centroids, width)[2]]
    fits = lambda v: int(v) if -LONG <= v < LONG else None
    texts = [",".join(str(int(v)) for v in c) for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                best, far = nearest(V.unpack(row["kind"], row["data"], width), centroids)
                places = pa.array(best)
                values = [pa.array([fits(v) for v in inertia], pa.int64()).take(places), pa.array([fits(sum(inertia))] * len(best), pa.int64()), pa.array(texts).take(places)]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), places, pa.array([fits(v) for v in far], pa.int64()), *values], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    out = packed.mapInArrow(run, schema)
    out.stored_at = packed.stored_at
    return out


def _integers(rows: list[list[int]]) -> np.ndarray:
    """rows as 64-bit integers where they fit, else as Python's."""
    top = max((abs(v) for r in rows for v in r), default=0)
    return np.array(rows, np.int64 if top < V.EXACT_LONG else object)


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2("centroid", 256)).drop("centroid")


def _sql() -> str:
    """The rounds as one table expression each; integers throughout, floors for negative sums included."""
    near = "(SELECT vec_id, q, n, d FROM (SELECT vec_id, q, n, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, n) AS i FROM (SELECT v.vec_id, q, n, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, {c})) WHERE i = 1)"
    out = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
c0 AS MATERIALIZED (SELECT q AS c, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS n FROM v QUALIFY n < {K})"""
    for i in range(ROUNDS):
        out += f""",
m{i} AS (SELECT n, list(f ORDER BY j) AS c FROM (SELECT n, j, (s - ((s % w) + w) % w) // w AS f FROM (SELECT n, j, sum(q[j])::HUGEINT AS s, count(*)::HUGEINT AS w FROM {near.format(c=f"c{i}")}, range(1, {WIDTH + 1}) t(j) GROUP BY n, j)) GROUP BY n),
c{i + 1} AS MATERIALIZED (SELECT list_transform(coalesce(m.c, c{i}.c), lambda x: x::BIGINT) AS c, c{i}.n FROM c{i} LEFT JOIN m{i} m USING (n))"""
    return out + f""", a AS MATERIALIZED {near.format(c=f"c{ROUNDS}")}
SELECT vec_id, n::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a JOIN c{ROUNDS} USING (n)"""


OP11_SQL = _sql()
