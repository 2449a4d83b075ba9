"""Vectors of integers in packed blocks, and products of blocks that are exact at any magnitude.

A component x becomes floor(1024 * x), taken in double precision. A block holds up to BLOCK vectors of one length in
the narrowest of int16, int32, int64 and double (doubles hold integers beyond 64 bits). Products run as float64 matrix
products while no partial sum can reach 2**53, so that each is exact; rows beyond go to 64-bit integers, and beyond
2**63 to Python's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE, BLOCK = 1024.0, 4096
EXACT_DOUBLE, EXACT_LONG = 2**53, 2**63
KINDS = ("<i2", "<i4", "<i8")


def usable(vector: Column) -> Column:
    """Whether vector isn't null and every component is there and finite, also when scaled."""
    finite = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & (F.abs(F.coalesce(x, F.lit(0.0)) * SCALE) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def magnitude(x: np.ndarray) -> int:
    """Largest absolute component."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(1024 * value), in the narrowest kind that holds all of them."""
    q = np.floor(SCALE * values)
    top = magnitude(q)
    for kind in KINDS:
        if top <= np.iinfo(kind).max:
            return q.astype(kind)
    return q


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls, as doubles, padded with zeros to `width`."""
    values = np.asarray(column.flatten()).astype(np.float64)
    sizes = np.diff(np.asarray(column.offsets))
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def pack(x: np.ndarray) -> tuple[str, bytes]:
    return x.dtype.str, np.ascontiguousarray(x).tobytes()


def unpack(kind: str, data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, width) if width else np.zeros((0, 0), kind)


def whole(x: np.ndarray) -> np.ndarray:
    """x as Python integers."""
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def tiers(x: np.ndarray, bound) -> Iterator[tuple[np.ndarray, str]]:
    """(row numbers, kind of number) by the bound, a function of a row's largest component: double, 64-bit or Python integers."""
    if bound(magnitude(x)) < EXACT_DOUBLE:
        yield np.arange(len(x)), "f8"
        return
    tops = np.array([magnitude(r) for r in x], object)
    kinds = np.array(["f8" if (b := bound(int(t))) < EXACT_DOUBLE else "i8" if b < EXACT_LONG else "O" for t in tops])
    for kind in ("f8", "i8", "O"):
        if (at := np.flatnonzero(kinds == kind)).size:
            yield at, kind


def as_kind(x: np.ndarray, kind: str) -> np.ndarray:
    return whole(x) if kind == "O" else x.astype(kind)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T, exact; doubles or integers of 64 bits, else Python integers."""
    top, parts = magnitude(y), list(tiers(x, lambda m: x.shape[1] * m * magnitude(y)))
    if len(parts) == 1 and parts[0][1] != "O":
        kind = parts[0][1]
        return x.astype(kind) @ y.astype(kind).T
    out = np.empty((len(x), len(y)), object if any(k == "O" for _, k in parts) else "i8")
    for at, kind in parts:
        out[at] = (as_kind(x[at], kind) @ as_kind(y, kind).T).astype(out.dtype if top < EXACT_LONG and kind != "O" else object)
        if out.dtype == object and kind == "f8":
            out[at] = whole(out[at])
    return out


def squared_distances(x: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, |x|^2 - 2 x.c + |c|^2 of these rows to all c), exact; one pair for each kind of number that the rows need."""
    top, d = magnitude(c), x.shape[1]
    for at, kind in tiers(x, lambda m: d * (m + top) ** 2):
        a, b = as_kind(x[at], kind), as_kind(c, kind)
        yield at, (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
