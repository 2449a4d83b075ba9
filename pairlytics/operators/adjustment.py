"""Opponent adjustment as a sparse least-squares solve by conjugate gradients, several measures at once.

The model is y = mean + offence(team) - defence(opp) + h * (1 at home, else -1). Teams are dealt into blocks of about BLOCK_PAIRS pairs that met; a
block's row holds its part of the matrix and of the vectors as arrays. A round is one job with one shuffle: blocks move their vectors, send each other
the directions of the teams that met, and take the product with the matrix; scalar products are observed while the blocks are written, so the driver sees
a row of them a round. Rounds start at zero, so teams that no chain of games connects get the solution of least norm; offence and defence are then centred.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .lineage import drop, stored

#: Squared norm of a residual, relative to that of the right side, at which a measure is solved; rounds up to which it must be.
SOLVED, ROUNDS = 1e-24, 2_000
#: Pairs of teams that a block holds, a few dozen bytes each in its task (a team's pairs stay together).
BLOCK_PAIRS = 200_000
SIDES = ("off", "def")
DOTS = ("mean", "home", "pq", "rq", "qq", "rr")


def solve(observations: DataFrame, measures: Iterable[str]) -> DataFrame:
    """(team, and for each measure <m>_off, <m>_def, <m>_n) of observations (team, opp, home, and a column for each measure, null where it wasn't taken).

    A team without an observation of a measure has null there; rows without a team or opponent are left out. An empty table gives no rows; an error is raised if rounds run out.
    """
    ms = list(measures)
    sign = F.when(F.col("home"), 1.0).otherwise(-1.0)
    y = {m: F.col(m).cast("double") for m in ms}
    there = {m: F.col(m).isNotNull() for m in ms}
    sums = [x for m in ms for x in (F.count(m).cast("double").alias(f"{m}_n"), F.coalesce(F.sum(F.when(there[m], sign)), F.lit(0.0)).alias(f"{m}_s"), F.coalesce(F.sum(y[m]), F.lit(0.0)).alias(f"{m}_y"), F.coalesce(F.sum(sign * y[m]), F.lit(0.0)).alias(f"{m}_sy"))]
    met = stored(observations.where("team IS NOT NULL AND opp IS NOT NULL").groupBy("team", "opp").agg(*sums))  # a row per ordered pair that met
    zero = {f"{d}_{c}": F.lit(0.0) for d in ("out", "in") for c in _columns(ms)}
    out = met.select("team", "opp", *[F.col(c).alias(f"out_{c}") for c in _columns(ms)])
    back = met.select(F.col("opp").alias("team"), F.col("team").alias("opp"), *[F.col(c).alias(f"in_{c}") for c in _columns(ms)])
    both = out.withColumns({k: v for k, v in zero.items() if k.startswith("in_")}).unionByName(back.withColumns({k: v for k, v in zero.items() if k.startswith("out_")}))
    pairs = stored(both.groupBy("team", "opp").agg(*[F.sum(c).alias(c) for c in zero]))
    blocks = max(1, -(-pairs.count() // BLOCK_PAIRS))
    home = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    dealt = pairs.withColumns({"block": home("team"), "from": home("opp")})
    kind = "block int, to int, body binary, " + ", ".join(f"{m}_{k} double" for m in ms for k in DOTS)
    start = stored(dealt.repartition(blocks, "block").groupBy("block").applyInArrow(_begin(ms), kind))
    return _rounds(start, blocks, observations.schema["team"].dataType.simpleString(), ms, _totals(pairs, ms))


def _columns(ms: list[str]) -> list[str]:
    return [f"{m}_{c}" for m in ms for c in ("n", "s", "y", "sy")]


def _totals(pairs: DataFrame, ms: list[str]) -> dict[str, float]:
    return pairs.agg(*[F.coalesce(F.sum(f"out_{c}"), F.lit(0.0)).alias(c) for c in _columns(ms)]).first().asDict()


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts and sums of signs as integers of the least width."""
    low, high = (np.min_scalar_type(int(f(x))) if len(x) else np.int8 for f in (np.min, np.max))
    return x.astype(np.promote_types(low, high))


def _begin(ms: list[str]):
    def block(rows: pa.Table) -> pa.Table:
        col = lambda c: rows.column(c).to_numpy()
        teams, i = np.unique(col("team"), return_inverse=True)
        source = col("from")
        # a pair is there in both directions: the teams that met one of block b are known here, and b needs just these, in the same order
        body = {"teams": teams, "i": i.astype(np.int32), "needs": {}, "gives": {}, "j": np.zeros(len(i), np.int32)}
        at = 0
        for b in np.unique(source).tolist():
            here = source == b
            theirs, j = np.unique(col("opp")[here], return_inverse=True)
            body["j"][here] = at + j
            body["needs"][b] = (at, at + len(theirs))
            body["gives"][b] = np.unique(i[here]).astype(np.int32)
            at += len(theirs)
        for m in ms:
            for c in ("out_n", "in_n", "out_s"):
                body[f"{c}_{m}"] = _narrow(col(f"{c[:-2]}_{m}_{c[-1]}"))
            own = lambda c: np.bincount(i, col(c), len(teams))  # noqa: B023, E731
            for d in ("out", "in"):
                for c in ("n", "s"):
                    body[f"own_{d}_{c}_{m}"] = own(f"{d}_{m}_{c}")
            r = np.stack([own(f"out_{m}_y"), -own(f"in_{m}_y")])
            body |= {f"x_{m}": np.zeros_like(r), f"r_{m}": r, f"p_{m}": r, f"q_{m}": np.zeros_like(r)}
        return _row(rows.column("block")[0].as_py(), body, ms)

    return block


def _row(block: int, body: dict, ms: list[str], dots: dict | None = None) -> pa.Table:
    names = [f"{m}_{k}" for m in ms for k in DOTS]
    return pa.table({"block": pa.array([block], pa.int32()), "to": pa.array([block], pa.int32()), "body": pa.array([pickle.dumps(body, 5)], pa.binary())} | {n: pa.array([(dots or {}).get(n)], pa.float64()) for n in names})


def _moved(ms: list[str], change: dict[str, tuple[float, float, bool]]):
    """A block's row with its vectors moved by the last round's steps, and a row for each block that needs its directions."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = pickle.loads(raw)
                for m, (alpha, beta, turns) in change.items():
                    body[f"x_{m}"] = body[f"x_{m}"] + alpha * body[f"p_{m}"]
                    body[f"r_{m}"] = body[f"r_{m}"] - alpha * body[f"q_{m}"]
                    if turns:
                        body[f"p_{m}"] = body[f"r_{m}"] + beta * body[f"p_{m}"]
                sent = {b: pickle.dumps({m: body[f"p_{m}"][:, ids] for m in ms}, 5) for b, ids in body["gives"].items()}
                rows = [(block, block, pickle.dumps(body, 5), True), *[(block, b, x, False) for b, x in sent.items()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], names=["block", "to", "body", "own"])

    return move


def _multiplied(ms: list[str], shared: dict[str, list[float]]):
    """A block's row with q, the matrix times the directions, and its part of the scalar products; `shared` has the directions of the shared unknowns."""

    def multiply(rows: pa.Table) -> pa.Table:
        body, got = None, {}
        for block, raw, own in zip(rows.column("block").to_pylist(), rows.column("body").to_pylist(), rows.column("own").to_pylist(), strict=True):
            if own:
                body = pickle.loads(raw)
            else:
                got[block] = pickle.loads(raw)
        n, dots = len(body["teams"]), {}
        for m in ms:
            theirs = np.concatenate([got[b][m] for b in body["needs"]], axis=1)[:, body["j"]]
            add = lambda c, v: np.bincount(body["i"], body[f"{c}_{m}"] * v, n)  # noqa: B023, E731
            a, b, c = add("out_n", theirs[1]), add("in_n", theirs[0]), add("out_s", theirs[1])
            n_out, n_in, s_out, s_in = (body[f"own_{k}_{m}"] for k in ("out_n", "in_n", "out_s", "in_s"))
            (off, dfn), (mean, home), r = body[f"p_{m}"], shared[m], body[f"r_{m}"]
            p = body[f"p_{m}"]
            q = body[f"q_{m}"] = np.stack([n_out * off - a + n_out * mean + s_out * home, n_in * dfn - b - n_in * mean - s_in * home])
            # all observations' predictions without the shared part: their sum, and their sum by sign
            values = ((n_out * off - a).sum(), (s_out * off - c).sum(), (p * q).sum(), (r * q).sum(), (q * q).sum(), (r * r).sum())
            dots |= {f"{m}_{k}": float(v) for k, v in zip(DOTS, values, strict=True)}
        return _row(rows.column("to")[0].as_py(), body, ms, dots)

    return multiply


def _result(ms: list[str]):
    """(team, x and observations of each measure) of blocks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                body = pickle.loads(raw)
                cols = {"team": pa.array(body["teams"])}
                for m in ms:
                    cols |= {f"x_{m}_{s}": v for s, v in zip(SIDES, body[f"x_{m}"], strict=True)}
                for m in ms:
                    cols |= {f"{d}_{m}_n": body[f"own_{d}_n_{m}"] for d in ("out", "in")}
                yield pa.RecordBatch.from_pydict(cols)

    return unpack


def _rounds(now: DataFrame, blocks: int, key: str, ms: list[str], totals: dict[str, float]) -> DataFrame:
    kind = now.schema
    # the two unknowns that all observations share are on the driver: mean and home advantage
    x = {m: [0.0, 0.0] for m in ms}
    r = {m: [totals[f"{m}_y"], totals[f"{m}_sy"]] for m in ms}
    p = {m: list(r[m]) for m in ms}
    first: dict[str, float] = {}
    change: dict[str, tuple[float, float, bool]] = {}
    done: set[str] = set()
    for _ in range(ROUNDS):
        sent = now.select("block", "body").mapInArrow(_moved(ms, change), "block int, to int, body binary, own boolean")
        step = sent.repartition(blocks, "to").groupBy("to").applyInArrow(_multiplied(ms, p), kind)
        seen = Observation()
        before, now = now, stored(step.observe(seen, *[F.sum(f"{m}_{k}").alias(f"{m}_{k}") for m in ms for k in DOTS]))
        got = seen.get
        drop(before)
        change = {}
        for m in ms:
            if got[f"{m}_rr"] is None or m in done:
                done.add(m)
                continue
            n, s = totals[f"{m}_n"], totals[f"{m}_s"]
            shared = [got[f"{m}_mean"] + n * p[m][0] + s * p[m][1], got[f"{m}_home"] + s * p[m][0] + n * p[m][1]]
            dot = lambda u, v, k: got[f"{m}_{k}"] + sum(a * b for a, b in zip(u, v, strict=True))  # noqa: E731, B023
            pq, rq, qq, rr = dot(p[m], shared, "pq"), dot(r[m], shared, "rq"), dot(shared, shared, "qq"), dot(r[m], r[m], "rr")
            if rr <= SOLVED * first.setdefault(m, rr) or pq <= 0:
                done.add(m)
                continue
            alpha = rr / pq
            beta = max(0.0, (rr - 2 * alpha * rq + alpha * alpha * qq) / rr)
            change[m] = (alpha, beta, True)
            x[m] = [a + alpha * b for a, b in zip(x[m], p[m], strict=True)]
            r[m] = [a - alpha * b for a, b in zip(r[m], shared, strict=True)]
            p[m] = [a + beta * b for a, b in zip(r[m], p[m], strict=True)]
        if len(done) == len(ms):
            break
    else:
        raise ArithmeticError(f"{set(ms) - done} not solved after {ROUNDS} rounds")
    made = ", ".join([f"x_{m}_{s} double" for m in ms for s in SIDES] + [f"{d}_{m}_n double" for m in ms for d in ("out", "in")])
    now = stored(now.select("body").mapInArrow(_result(ms), f"team {key}, {made}"))
    seen = {m: F.col(f"out_{m}_n") + F.col(f"in_{m}_n") > 0 for m in ms}
    means = now.agg(*[F.avg(F.when(seen[m], F.col(f"x_{m}_{s}"))).alias(f"{m}_{s}") for m in ms for s in SIDES]).first()
    values = [F.when(seen[m], F.col(f"x_{m}_{s}") - (means[f"{m}_{s}"] or 0.0)).alias(f"{m}_{s}") for m in ms for s in SIDES]
    return now.select("team", *values, *[F.col(f"out_{m}_n").cast("long").alias(f"{m}_n") for m in ms])
