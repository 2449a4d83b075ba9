"""Exact search for the largest inner products, as a Voronoi join of queries and data.

A bounded number of rows are pivots. Every row belongs to the cell of its nearest pivot; a task packs a cell's vectors,
sorted by their distance to the pivot, into blocks that carry their greatest distance. From the summaries of cells (number,
radius of the queries, least score that a query is sure to reach, as it reaches it with pivots) follows for each pair of cells
how far from its pivot a vector must lie to matter at all: a query q of cell i and a vector x of cell j have
q.x <= p_i.p_j + r_i |p_j| + (|p_i| + r_i) d(x, p_j). Blocks that end nearer aren't sent. Query cells are dealt into groups of bounded
size (a hot cell into several); the data of a group are dealt over several tasks, each of which reads the group's queries
first and then streams blocks past them, with each query's best rows so far as its only state. Spark merges the tasks' lists.

Pivots only decide what is sent, never the result. Products are exact (see `vectors`); bounds are doubles with a margin.

Cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded with
zeros; rows without id are candidates after all others of their score, never queries; a query's own row is known by its id, so
repeated rows of one id aren't candidates for each other, and a repeated query is answered once for each of its rows;
other columns aren't looked at; an empty table gives no rows. A score beyond 64 bits ranks by its value and is given as null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .common import settings_of_jobs, small, stored, table

TOP, EVERY = 10, 100
#: Pivots; queries of a group, whose vectors a task holds; vectors that a task streams, and tasks of a group up to which that number holds.
PIVOTS, GROUP_QUERIES, TASK_ROWS, TASKS = 64, 8192, 8192, 64
#: Queries multiplied with a block at once.
ASKED_AT_ONCE = 1024
#: Memory that a task may fill with vectors of a cell before it writes them out as blocks.
HELD_BYTES = 64 << 20
#: Relative margin of bounds in doubles.
MARGIN = 1e-6
DIGITS = 10**38 - 1


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _packed(rows: DataFrame, pivots: np.ndarray, pivot_ids: list[int], width: int, top: int) -> DataFrame:
    """Blocks (query, cell, part, ids, kind, data, n, radius, sure) of rows (vec_id, x, query); `sure` is a block's least score reached with pivots."""
    far = pivots.astype(np.float64)
    own = np.array(pivot_ids, np.int64)

    def block(query: bool, cell: int, part: int, ids: list, x: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        kind, data = V.pack(x)
        sure = -math.inf
        if query and len(own) > top:
            s = V.products(x, pivots).astype(np.float64)
            s[np.array([-1 if i is None else i for i in ids])[:, None] == own[None, :]] = -math.inf
            sure = float(np.partition(s, -top, axis=1)[:, -top].min())
        values = [[query], [cell], [part], [ids], [kind], [data], [len(ids)], [float(d.max())], [sure]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, BLOCKS, strict=True)], schema=BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[tuple[bool, int], list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for (query, cell), parts in sorted(held.items()):
                d = np.concatenate([p[2] for p in parts])
                order = np.argsort(d, kind="stable")
                x, ids = np.concatenate([p[1] for p in parts]), [i for p in parts for i in p[0]]
                for at in range(0, len(order), V.BLOCK):
                    pick = order[at : at + V.BLOCK]
                    yield block(query, cell, (task << 24) + made, [ids[i] for i in pick], x[pick], d[pick])
                    made += 1
            held.clear()

        for batch in batches:
            x = V.scaled(V.matrix(batch.column(1), width))
            with np.errstate(over="ignore", invalid="ignore"):
                a = x.astype(np.float64)
                near = np.nan_to_num((far * far).sum(1)[None, :] - 2 * (a @ far.T), nan=math.inf).argmin(1)
                d = np.nan_to_num(_norms(a - far[near]), nan=math.inf)
            ids, asked = batch.column(0).to_pylist(), np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            for cell in np.unique(near):
                at = np.flatnonzero(near == cell)
                held.setdefault((False, int(cell)), []).append(([ids[i] for i in at], x[at], d[at]))
                if (q := at[asked[at]]).size:
                    held.setdefault((True, int(cell)), []).append(([ids[i] for i in q], x[q], d[q]))
            size += x.nbytes
            if size > HELD_BYTES:
                yield from out()
                size = 0
        yield from out()

    schema = "query boolean, cell int, part long, ids array<long>, kind string, data binary, n long, radius double, sure double"
    return rows.select("vec_id", "x", "query").mapInArrow(run, schema)


BLOCKS = pa.schema([("query", pa.bool_()), ("cell", pa.int32()), ("part", pa.int64()), ("ids", pa.list_(pa.int64())), ("kind", pa.string()), ("data", pa.binary()), ("n", pa.int64()), ("radius", pa.float64()), ("sure", pa.float64())])


def least_distances(pivots: np.ndarray, radius: dict[int, float], sure: dict[int, float]) -> dict[tuple[int, int], float]:
    """(query cell, data cell) to the distance from its pivot that a vector must have to reach what the cell's queries surely do."""
    out = {}
    with np.errstate(over="ignore", invalid="ignore"):
        p = pivots.astype(np.float64)
        size, dots = _norms(p), p @ p.T
        for i, r in radius.items():
            for j in range(len(p)):
                rest = sure[i] - dots[i, j] - r * size[j]
                slack = MARGIN * (abs(sure[i]) + abs(dots[i, j]) + r * size[j] + 1)
                reach = size[i] + r
                least = (rest - slack) / reach if reach > 0 else (-math.inf if rest <= slack else math.inf)
                out[i, j] = -math.inf if math.isnan(least) else float(least * (1 - MARGIN) if least > 0 else least)
    return out


def _groups(cells: dict[int, int], pivots: np.ndarray, limit: int) -> list[list[tuple[int, int, int]]]:
    """Groups of (cell, share, shares of the cell) with about `limit` queries at most: neighbouring cells together, a larger cell in shares."""
    p = pivots.astype(np.float64)
    rest, out = dict(cells), []
    while rest:
        first = max(rest, key=lambda c: (rest[c], -c))
        if rest[first] > limit:
            shares = -(-rest.pop(first) // limit)
            out += [[(first, s, shares)] for s in range(shares)]
            continue
        group, n = [], 0
        for c in sorted(rest, key=lambda c: (float(np.nan_to_num(_norms((p[c] - p[first])[None, :]))[0]), c)):
            if n + rest[c] <= limit:
                group.append((c, 0, 1))
                n += rest.pop(c)
        out.append(group)
    return out


class Best:
    """The best rows so far of some queries: their rows' numbers, ids and vectors."""

    def __init__(self, top: int, asked: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.top, self.asked, self.own, self.x = top, asked, ids, x
        self.score, self.row = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), np.int64)

    def see(self, ids: np.ndarray, x: np.ndarray, missing: np.ndarray) -> None:
        """Take a block of rows into account; `missing` marks those without id."""
        row = np.where(missing, NO_ID, ids)
        order = np.argsort(row, kind="stable")
        row, s = row[order], V.products(self.x, x[order])
        s = s if s.dtype == object else s.astype(np.int64)
        mine = (row[None, :] == self.own[:, None]) & (row != NO_ID)[None, :]
        if s.dtype == object:
            pick = np.array([sorted(range(len(row)), key=lambda j: (m[j], -v[j], j))[: self.top] for v, m in zip(s, mine, strict=True)], np.int64).reshape(len(s), -1)
        elif len(row) <= self.top:
            pick = np.arange(len(row))[None, :].repeat(len(s), 0)
        elif V.magnitude(s) < PACKABLE:  # score and place in one number, so that ties fall as they must
            both = np.where(mine, LOWEST, s * V.BLOCK - np.arange(len(row)))
            pick = np.argpartition(both, -self.top, axis=1)[:, -self.top :]
        else:
            pick = np.argsort(~np.where(mine, LOWEST, s), axis=1, kind="stable")[:, : self.top]
        if s.dtype == object:
            self.score = self.score.astype(object)
        s = np.concatenate([self.score, np.take_along_axis(s, pick, 1).astype(self.score.dtype)], 1)
        row = np.concatenate([self.row, np.where(np.take_along_axis(mine, pick, 1), NONE, row[pick])], 1)
        if s.dtype == object:
            order = np.array([sorted(range(s.shape[1]), key=lambda j: (r[j] == NONE, -v[j], r[j]))[: self.top] for v, r in zip(s, row, strict=True)], np.int64).reshape(len(s), -1)
        else:
            order = np.lexsort((row, ~s, row == NONE), axis=1)[:, : self.top]
        self.score, self.row = np.take_along_axis(s, order, 1), np.take_along_axis(row, order, 1)

    def found(self) -> pa.RecordBatch:
        there = self.row != NONE
        query = np.repeat(np.arange(len(self.own)), there.sum(1))
        row, score = self.row[there], self.score[there]
        if score.dtype == object:
            score = pa.array([max(-DIGITS, min(DIGITS, int(v))) for v in score], pa.decimal128(38, 0))
        else:
            score = pa.array(score, pa.int64()).cast(pa.decimal128(38, 0))
        return pa.RecordBatch.from_arrays([pa.array(self.asked[query]), pa.array(self.own[query]), pa.array(row, pa.int64(), mask=row == NO_ID), score], names=["asked", "query_id", "vec_id", "score"])


#: Stand-ins in the place of ids: a row without id ranks after all others of its score; no row.
NO_ID, NONE = 2**63 - 2, 2**63 - 1
LOWEST, PACKABLE = -(2**63), 2**50


def _search(dealt: DataFrame, width: int, top: int) -> DataFrame:
    """(asked, query_id, vec_id, score) of each task's best rows; dealt has a group's queries before its data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, best = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch["grp"][i].as_py(), batch["task"][i].as_py())
                if key != at:
                    yield from (b.found() for b in best)
                    at, asked, best = key, [], []
                x, ids = V.unpack(batch["kind"][i].as_py(), batch["data"][i].as_buffer(), width), batch["ids"][i].values
                if not batch["data_side"][i].as_py():
                    asked.append((batch["part"][i].as_py() * V.BLOCK + np.arange(len(x)), np.asarray(ids), x))
                    continue
                if asked:
                    rows = [np.concatenate(v) for v in zip(*asked, strict=True)]
                    best = [Best(top, *[v[j : j + ASKED_AT_ONCE] for v in rows]) for j in range(0, len(rows[0]), ASKED_AT_ONCE)]
                    asked = []
                for b in best:  # a share of a hot cell may have no query
                    b.see(np.asarray(ids.fill_null(0)), x, np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool))
        yield from (b.found() for b in best)

    return dealt.mapInArrow(run, "asked long, query_id long, vec_id long, score decimal(38,0)")


def topk(vectors: DataFrame, is_query: Column, vector: str = "embedding", top: int = TOP, pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES, task_rows: int = TASK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` rows of the largest inner product with each query row, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    asked = F.coalesce(is_query & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.where(V.usable(F.col(vector))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"), asked.alias("query"))
    first = rows.where("vec_id IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(pivots).collect()
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if width is None or not first:
        return spark.createDataFrame([], schema)
    padded = np.array([[*r["x"], *[0.0] * (width - len(r["x"]))] for r in first], np.float64).reshape(len(first), width)
    pivot_ids = [r["vec_id"] for r in first]
    # repeated ids aren't candidates for each other, so each counts once towards what is sure
    once = [i for i, v in enumerate(pivot_ids) if v not in pivot_ids[:i]]
    at = V.scaled(padded)[once]
    packed = stored(_packed(rows, at, [pivot_ids[i] for i in once], width, top))
    cells = packed.groupBy("query", "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.min("sure").alias("sure")).collect()  # two rows a pivot
    asking = {r["cell"]: r for r in cells if r["query"]}
    if not asking:
        return spark.createDataFrame([], schema)
    least = least_distances(at, {c: r["radius"] for c, r in asking.items()}, {c: r["sure"] for c, r in asking.items()})
    groups = _groups({c: r["n"] for c, r in asking.items()}, at, group_queries)
    shares = spark.createDataFrame([(g, c, s, n) for g, group in enumerate(groups) for c, s, n in group], "grp int, cell int, share int, shares int")
    wanted = spark.createDataFrame([(g, j, min(least[c, j] for c, _, _ in group)) for g, group in enumerate(groups) for j in range(len(at))], "grp int, cell int, least double")
    data = packed.where("NOT query").join(small(wanted), "cell").where("radius >= least")
    # rows that a group's data have decide over how many tasks they are dealt
    load = data.groupBy("grp").agg(F.sum("n").alias("rows"))
    tasks = F.greatest(F.lit(1), F.least(F.ceil(F.col("rows") / task_rows), F.lit(TASKS)), F.ceil(F.col("rows") / (512 * task_rows))).cast("int")
    spread = stored(load.select("grp", tasks.alias("tasks")))
    columns = ["part", "ids", "kind", "data"]
    sent = data.join(small(spread), "grp").select("grp", F.pmod(F.xxhash64("part"), F.col("tasks")).cast("int").alias("task"), F.lit(True).alias("data_side"), *columns)
    queries = packed.where("query").join(small(shares), "cell").where(F.pmod(F.xxhash64("part"), F.col("shares")) == F.col("share"))
    queries = queries.join(small(spread), "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(False).alias("data_side"), *columns)
    dealt = sent.unionByName(queries).repartition("grp", "task").sortWithinPartitions("grp", "task", "data_side")
    with settings_of_jobs(spark):
        found = stored(_search(dealt, width, top))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", F.expr("try_cast(score AS long)").alias("score"))


def op13_exact_topk(spark, sf_dir: str) -> DataFrame:
    return topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP13_SQL = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= {TOP}"""
