"""Leaderboards of several categories, merged into one row per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(boards: list[DataFrame], key: str, page: str) -> DataFrame:
    """(key, every field of the boards, conflicts): one row per non-null key, in one partially aggregated shuffle.

    Boards have the key, the page (an order) and fields of their own or shared ones. Of several values of a field the one
    on the last page stays (ties: the greatest); `conflicts` lists the fields that had different values, by name. A field
    that no board gives for a key is null.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), boards).where(F.col(key).isNotNull())
    fields = sorted(c for c in rows.columns if c not in (key, page))
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(page, f))).alias(f) for f in fields]
    differ = F.array_compact(F.array(*[F.when(F.min(f) < F.max(f), F.lit(f)) for f in fields])).alias("conflicts")
    return rows.groupBy(key).agg(*last, differ)
