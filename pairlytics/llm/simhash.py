"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, connected components.

Fingerprint: A-Z lower-cased, words are runs without ASCII white space, shingles are `SHINGLE` words joined by a
space (fewer words: the whole sequence); a bit is set if it is set in over half of the shingles' XXH64 (seed 42).
Texts link if their fingerprints differ in at most `RADIUS` bits.

Work is done on distinct fingerprints, so groups of copies cost one row. Two fingerprints within 3 bits agree on
one of 4 blocks of 16 bits: each goes to the 4 shards of its blocks. A shard over `SHARD_ROWS` is cut again by the
blocks of its other bits (12, then 9 bits), so a shard stays small however many texts resemble each other. Inside
a shard, a BK-tree (children keyed by their Hamming distance to the parent) is built and searched along the edges
within the radius. A shard emits each member's link to its local root only: linear in members, whatever the pairs.
Trees are built where their shard lies instead of being broadcast: a tree of all fingerprints has no size bound.

Cases: null text counts as empty; an empty text has fingerprint zero, linked like any other; repeated rows each
get a row; a null doc_id is kept and never names a component unless all its ids are null; other columns aren't
looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored, table, unique_name

SHINGLE, RADIUS, SEED = 3, 3, 42
SHARD_ROWS = 512


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of one text."""
    words = (text or b"").lower().split()  # bytes: ASCII only, as wanted
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if n <= SHINGLE:
        hashes, m = digest(joined, SEED), 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = [0, *(ends[: n - SHINGLE] + 1).tolist()]
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)])
        m = n - SHINGLE + 1
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8))  # m rows of 64
    per = -(-m // 255)  # `per` rows side by side, at most 255 such lines: their sums fit bytes
    lines = -(-m // per)
    if pad := per * lines - m:
        bits = np.concatenate([bits, np.zeros(pad * 64, np.uint8)])
    counts = bits.reshape(lines, per * 64).sum(axis=0, dtype=np.uint8).reshape(per, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > m).view(">u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _without(x: Column, low: int, width: int) -> Column:
    """x without the bits low..low+width-1, the higher ones moved down."""
    high = F.shiftleft(F.shiftrightunsigned(x, low + width), low) if low + width < 64 else F.lit(0).cast("long")
    return high.bitwiseOR(x.bitwiseAND((1 << low) - 1)) if low else high


#: Bits left at each level of cutting, and the blocks that they are cut into.
LEVELS = ((64, 16), (48, 12), (36, 9))


def _shards(nodes: DataFrame) -> DataFrame:
    """(key, fp): every two fingerprints within the radius meet under some key; few keys exceed SHARD_ROWS."""
    level = nodes.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"))
    done = None
    for depth, (_, width) in enumerate(LEVELS):
        blocks = F.explode(
            F.array(*[F.struct(F.xxhash64("key", F.lit(depth), F.lit(b), F.shiftrightunsigned("rest", b * width).bitwiseAND((1 << width) - 1)).alias("key"), _without(F.col("rest"), b * width, width).alias("rest")) for b in range(4)])
        )
        cut = stored(level.select("fp", blocks.alias("b")).select("fp", "b.key", "b.rest"))
        large = cut.groupBy("key").count().where(F.col("count") > SHARD_ROWS).select("key")
        if depth + 1 < len(LEVELS) and not (large := stored(large)).isEmpty():
            ready = cut.join(small(large), "key", "left_anti").select("key", "fp")
            level = cut.join(small(large), "key", "left_semi").select("fp", "key", "rest")
        else:
            ready, level = cut.select("key", "fp"), None
        done = ready if done is None else done.unionByName(ready)
        if level is None:
            break
    return done


class BKTree:
    """Burkhard-Keller tree under Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        at = 0
        new = len(self.values)
        self.values.append(x)
        self.children.append({})
        while new:
            d = (x ^ self.values[at]).bit_count()
            if (below := self.children[at].get(d)) is None:
                self.children[at][d] = new
                return
            at = below

    def within(self, x: int, radius: int) -> list[int]:
        """Indexes of the values at most radius from x; only edges in d-radius..d+radius are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (x ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, root) for each member that isn't the root of its component in this shard."""
    if len(values) == 2:
        return [(values[1], values[0])] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, x in enumerate(values):
        for j in tree.within(x, radius):
            parent[root(i)] = root(j)
        tree.add(x)
    return [(values[i], values[r]) for i in range(len(values)) if (r := root(i)) != i]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) come sorted by key; a shard may span batches."""
    keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)

    def linked(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        unsigned = prints.view(np.uint64)
        out = [x for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1 for x in shard_links(np.unique(unsigned[a:b]).tolist())]
        both = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        prints = np.concatenate([prints, batch.column(1).to_numpy()])
        if len(keys) and keys[0] != keys[-1]:
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            yield linked(keys[:cut], prints[:cut])
            keys, prints = keys[cut:], prints[cut:]
    if len(keys):
        yield linked(keys, prints)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that can be reached.

    Alternates large-star and small-star steps (a node's larger, then smaller neighbours are hung on its smallest
    one) until nothing changes; each step is two aggregations and a join, stored in the shared folder.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large.where("u <> v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        edges = stored(moved.where("u <> v").distinct())
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _roots(nodes: DataFrame) -> DataFrame:
    """(fp, root) of every distinct fp in nodes; root is the component's smallest fingerprint."""
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded = _shards(nodes).repartition(partitions, "key").sortWithinPartitions("key")
    links = stored(sharded.mapInArrow(_links, "a long, b long"))
    roots = components(links)
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the smallest doc_id reachable over links."""
    prints = stored(fingerprints(docs))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    of_root = _roots(nodes).select("fp", "rep", "root")
    lowest = of_root.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = of_root.join(lowest, "root").select("fp", "component_id")
    return prints.join(small(stored(named)), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents (all columns), one row of each component: the first by doc_id (nulls last), then by the text's hash.

    A row's key is its doc_id and the SHA-256 of its text, so rows that share an id are judged by their own text. Rows
    alike in both are copies: the least of their other columns stays. All but the last step work on keys; the texts are
    shuffled once, whatever the size: a broadcast that gives way to a shuffle would make the bytes moved jump there.
    """
    sha = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    # a text's fingerprint and key come from one row: the key passes through in the id's place
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", sha.alias("sha"), F.col("text").isNull().alias("none")).alias("doc_id"), "text")
    prints = stored(fingerprints(keyed))
    counted = prints.groupBy("fp", "doc_id").agg(F.count("*").alias("n"))  # n: rows alike in id and text
    nodes = stored(counted.groupBy("fp").agg(F.min(F.struct("doc_id", "n")).alias("rep")))
    firsts = stored(_roots(nodes).groupBy("root").agg(F.min("rep").alias("k")).select("k.doc_id.*", "k.n"))
    k_id, k_sha, k_none, k_n, own_sha, whole = (unique_name(docs, c) for c in ("k_id", "k_sha", "k_none", "k_n", "own_sha", "least_of_row"))
    firsts = firsts.select(F.col("doc_id").alias(k_id), F.col("sha").alias(k_sha), F.col("none").alias(k_none), F.col("n").alias(k_n))
    mine = F.col("doc_id").eqNullSafe(F.col(k_id)) & (F.col(own_sha) == F.col(k_sha)) & (F.col("text").isNull() == F.col(k_none))
    kept = docs.withColumn(own_sha, sha).join(firsts.hint("merge"), mine)
    names = [F.col(f"`{c}`") for c in docs.columns]
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if firsts.where(F.col(k_n) > 1).isEmpty():
        return kept.select(*names)
    rest = kept.where(F.col(k_n) == 1).select(*names)
    copies = kept.where(F.col(k_n) > 1).groupBy("doc_id", "text")
    if not others:
        return rest.unionByName(copies.agg(F.lit(1)).select(*names))
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    ordered = all("map<" not in t and "variant" not in t for _, t in docs.dtypes)  # maps have no order: their JSON text has
    least = copies.agg((F.min(row) if ordered else F.min_by(row, F.to_json(row))).alias(whole))
    return rest.unionByName(least.select("doc_id", "text", f"{whole}.*").select(*names))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
