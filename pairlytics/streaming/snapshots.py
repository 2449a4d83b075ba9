"""An upsert table of versioned snapshots: keyed batches are merged, a pointer file makes a version visible.

Rows lie in hash buckets of their key, each a folder of Parquet files; a pointer names the folder of every bucket, so a
merge rewrites only the buckets that its batch touches. Data are complete before the pointer is created, and the pointer
is created without overwriting: readers see the former version or the new one, and of two writers one fails. A pointer
that was torn by a crash is skipped by readers and its number isn't used again. What no pointer names is deleted by `vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lineage import delete
from ..operators.logs import dedupe_final_wins

BUCKET = "_bucket"


class Refused(Exception):
    """A version that would replace good data by worse; the table is left as it was."""


def no_loss(before: dict, after: dict) -> str | None:
    """Why a version is worse: it has fewer rows or fewer final rows. None if it isn't."""
    for what in ("rows", "finals"):
        if after[what] < before[what]:
            return f"{what} fall from {before[what]} to {after[what]}"
    return None


def at_least(share: float) -> Callable[[dict, dict], str | None]:
    """A guard that lets rows fall to a share of those before, as a repair that drops repeated rows needs."""
    return lambda before, after: f"rows fall from {before['rows']} to {after['rows']}" if after["rows"] < share * before["rows"] else None


@dataclass(frozen=True)
class SnapshotTable:
    """Table at path with the columns of schema (DDL), one row per key; `final` is a boolean column, `order` says which record is later.

    Rows with a null key are left out, a null `final` is false. Columns must be hashable (no maps). buckets is fixed for a
    table's life: choose it so that a bucket is some GB, since a merge reads and writes whole buckets, in as many tasks as the
    shuffle has for it. A pointer has one entry a bucket.
    """

    spark: SparkSession
    path: str
    schema: str
    key: str
    final: str
    order: str
    buckets: int = 64

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def pointer(self, version: int | None = None) -> dict | None:
        """The newest whole pointer, or that of a version; None if there is none."""
        for name in reversed(self._names("pointers")):
            if version is not None and int(name[:-5]) != version:
                continue
            fs, p = self._fs(f"{self.path}/pointers/{name}")
            stream = fs.open(p)
            try:
                return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except json.JSONDecodeError:
                continue
            finally:
                stream.close()
        return None

    def history(self) -> list[dict]:
        """All whole pointers, oldest first."""
        found = (self.pointer(int(name[:-5])) for name in self._names("pointers"))
        return [p for p in found if p is not None]

    def _publish(self, action: str, buckets: dict, meta: dict) -> dict:
        names = self._names("pointers")
        version = int(names[-1][:-5]) + 1 if names else 1
        pointer = {"version": version, "action": action, **totals(buckets), "meta": meta, "buckets": buckets}
        fs, p = self._fs(f"{self.path}/pointers/{version:012d}.json")
        out = fs.create(p, False)
        try:
            out.write(bytearray(json.dumps(pointer, sort_keys=True).encode()))
        finally:
            out.close()
        return pointer

    def _rows(self, pointer: dict | None, only: set[str] | None = None) -> DataFrame:
        paths = [b["path"] for k, b in (pointer["buckets"] if pointer else {}).items() if only is None or k in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of the newest version, or of an earlier one that vacuum has kept."""
        pointer = self.pointer(version)
        if version is not None and pointer is None:
            raise ValueError(f"no version {version}")
        return self._rows(pointer)

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.select(*self._columns()).where(F.col(self.key).isNotNull()).withColumn(BUCKET, F.pmod(F.hash(self.key), F.lit(self.buckets)))

    def _write(self, df: DataFrame) -> dict:
        """df by bucket in a new folder; per bucket its path, counts and the sum of its rows' hashes."""
        folder = f"data/{uuid.uuid4().hex}"
        self._bucketed(df).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(f"{self.path}/{folder}")
        prints = F.sum(F.xxhash64(*self._columns()).cast("decimal(20,0)")).cast("string")
        per = written.groupBy(BUCKET).agg(F.count("*").alias("rows"), F.count_if(self.final).alias("finals"), prints.alias("print"))
        return {str(r[BUCKET]): {"path": f"{folder}/{BUCKET}={r[BUCKET]}", "rows": r["rows"], "finals": r["finals"], "print": r["print"]} for r in per.collect()}  # a row a bucket

    def _commit(self, action: str, before: dict | None, buckets: dict, guard, meta: dict) -> dict:
        old = before["buckets"] if before else {}
        if before is not None and contents(buckets) == contents(old):
            return before
        reason = guard(totals(old), totals(buckets)) if guard is not None and before is not None else None
        if reason:
            raise Refused(f"{action}: {reason}")
        return self._publish(action, buckets, meta)

    def merge(self, batch: DataFrame) -> dict:
        """Upsert: a final record beats others, then the later one stays. The pointer that is current afterwards.

        The merge takes a maximum per key, so batches may come late, repeatedly and in any order; one that changes nothing
        makes no version.
        """
        before = self.pointer()
        staged = f"{self.path}/data/{uuid.uuid4().hex}"
        best = dedupe_final_wins(batch.select(*self._columns()), self.key, F.col(self.final), self.order)
        self._bucketed(best).write.parquet(staged)
        new = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(staged)
        touched = {str(r[0]) for r in new.select(BUCKET).distinct().collect()}  # at most one a bucket
        both = self._rows(before, touched).unionByName(new.drop(BUCKET))
        fresh = self._write(dedupe_final_wins(both, self.key, F.col(self.final), self.order)) if touched else {}
        delete(self.spark, staged)
        kept = before["buckets"] if before else {}
        # a bucket that the batch left as it was keeps its files
        changed = {k: b for k, b in fresh.items() if k not in kept or kept[k]["print"] != b["print"] or kept[k]["rows"] != b["rows"]}
        return self._commit("merge", before, {**kept, **changed}, no_loss, before["meta"] if before else {})

    def replace(self, df: DataFrame, guard: Callable[[dict, dict], str | None] | None = no_loss) -> dict:
        """A whole new content, unless guard finds it worse than the current one: then Refused is raised and the current one stays."""
        best = dedupe_final_wins(df.select(*self._columns()), self.key, F.col(self.final), self.order)
        return self._commit("replace", self.pointer(), self._write(best), guard, {})

    def repair(self, fix: Callable[[DataFrame], DataFrame], guard: Callable[[dict, dict], str | None] | None = no_loss) -> dict:
        """The current content through fix; where that changes nothing, as when a repair is run again, there is no new version."""
        before = self.pointer()
        if before is None:
            raise ValueError("nothing to repair")
        return self._commit("repair", before, self._write(fix(self._rows(before))), guard, before["meta"])

    def stamp(self, **meta) -> dict:
        """Metadata onto the current content, whose files stay; the same values again make no version."""
        before = self.pointer()
        if before is None:
            raise ValueError("nothing to stamp")
        new = {**before["meta"], **meta}
        return before if new == before["meta"] else self._publish("stamp", before["buckets"], new)

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the newest versions, and data that none of them names; the number of folders deleted. Not beside a running writer."""
        kept = self.history()[-keep:]
        for name in self._names("pointers"):
            if kept and int(name[:-5]) < kept[0]["version"]:
                delete(self.spark, f"{self.path}/pointers/{name}")
        named, gone = {b["path"] for p in kept for b in p["buckets"].values()}, 0
        for folder in self._names("data"):
            if not any(n.startswith(f"data/{folder}/") for n in named):
                delete(self.spark, f"{self.path}/data/{folder}")
                gone += 1
        return gone


def totals(buckets: dict) -> dict:
    return {what: sum(b[what] for b in buckets.values()) for what in ("rows", "finals")}


def contents(buckets: dict) -> dict:
    return {k: (b["rows"], b["finals"], b["print"]) for k, b in buckets.items()}


def upsert(log: DataFrame, into: SnapshotTable, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch of a streaming log is merged into the table.

    A stream that dies after a merge and before its checkpoint merges that batch again when it is restarted, which changes
    nothing; one that dies before the pointer leaves the former version.
    """
    writer = log.writeStream.foreachBatch(lambda batch, _: into.merge(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
