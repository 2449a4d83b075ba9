"""Joins over prioritised sources; each says in `method` where a row's values come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "none"


def _one(source: DataFrame, key: str, columns: list[str], into: str) -> DataFrame:
    """A row per non-null key: struct `into` of the columns; of several rows the greatest."""
    return source.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*columns)).alias(into))


def overridden(base: DataFrame, official: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the columns of its official row, nulls included, wherever there is one; method is official or derived."""
    out = base.join(_one(official, key, columns, "_o"), key, "left")
    has = F.col("_o").isNotNull()
    return out.withColumns({c: F.when(has, F.col(f"_o.{c}")).otherwise(F.col(c)) for c in columns} | {"method": F.when(has, "official").otherwise("derived")}).drop("_o")


def first_source(base: DataFrame, sources: list[tuple[str, DataFrame]], key: str, columns: list[str]) -> DataFrame:
    """base with the columns of the first source that has a row whose first column isn't null, all from that one; method names it, or none."""
    out = base
    for i, (_, source) in enumerate(sources):
        out = out.join(_one(source.where(F.col(columns[0]).isNotNull()), key, columns, f"_s{i}"), key, "left")
    taken = F.coalesce(*[F.col(f"_s{i}") for i in range(len(sources))])
    method = F.coalesce(*[F.when(F.col(f"_s{i}").isNotNull(), name) for i, (name, _) in enumerate(sources)], F.lit(NONE))
    return out.withColumns({"_taken": taken, "method": method}).select("*", *[F.col(f"_taken.{c}") for c in columns]).drop("_taken", *[f"_s{i}" for i in range(len(sources))])


def plain(name: Column) -> Column:
    """Lower case without dots, single spaces; null gives an empty name."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("."), F.lit("")), r"\s+", " "))


def _keyed(rows: DataFrame) -> DataFrame:
    whole = plain(F.col("name"))
    return rows.withColumns({"_name": whole, "_last": F.element_at(F.split(whole, " "), -1), "_initial": F.left(whole, F.lit(1))}).where("_name <> ''")


def transfers(moved: DataFrame, pool: DataFrame) -> DataFrame:
    """moved (id, team, name) with the pool's (pool_id, team, name, points) row of that team: pool_id, points, method.

    The plain name decides, else the surname with the first letter; of several the smallest pool_id. Candidates are one per key
    before they are joined, so common names form no pairs. Without a hit, or a name, method is none.
    """
    had, rows = _keyed(pool), _keyed(moved)
    first = F.min(F.struct("pool_id", "points"))
    exact = had.groupBy("team", "_name").agg(first.alias("_e"))
    near = had.groupBy("team", "_last", "_initial").agg(first.alias("_n"))
    hit = rows.join(exact, ["team", "_name"], "left").join(near, ["team", "_last", "_initial"], "left")
    method = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_n").isNotNull(), "surname")
    found = hit.select("id", F.coalesce("_e", "_n").alias("_p"), method.alias("method"))
    out = moved.select("id", "team", "name").join(found, "id", "left")
    return out.select("id", "team", "name", "_p.pool_id", "_p.points", F.coalesce("method", F.lit(NONE)).alias("method"))
