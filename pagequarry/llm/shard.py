"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows with equal texts) are sorted by size within a task and enter the
tightest bin that still holds them; the bins stand in a balanced search tree
ordered by remaining capacity.  One task packs one hash slice of the groups
into *blocks* of a fixed capacity, so no task sees more than its slice.  The
blocks, of which there are a bounded number per shard plus one or two per slice, are
then packed the same way into the shards: for a given number of shards the capacity is the level to which
they would fill like water (what is larger than that has a shard alone), and what
fits no longer enters the emptiest shard; for a given capacity the number of shards follows.

A group larger than a whole shard cannot be indivisible and the shards near
equal; only such a group is cut, into parts of block size by a hash of its row
numbers.  Groups up to a shard's size stay whole, however many rows they have: their
rows are numbered in salted lots, so no task orders a whole hot group.

Defined results: a null or empty text has size 1 and is one group with all
such texts; ties are ordered by the group's hash; an empty table gives no
rows.  Row ids may repeat or be null; each row gets its own slot.  A single row larger than a shard has one alone.  Equality of texts is that of
their SHA-256.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written

#: Groups that one task packs, about.
SLICE_GROUPS = 250_000
#: Blocks per shard, about; the imbalance of shards is below one part in so many.
BLOCKS_PER_SHARD = 256
#: Rows of a block that are numbered together.
LOT_ROWS = 50_000


class CapacityTree:
    """An AA tree (balanced by skew and split) of (remaining capacity, bin)."""

    class _Node:
        __slots__ = ("key", "left", "level", "right")

        def __init__(self, key):
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self):
        self._root = None

    @staticmethod
    def _skew(t):
        if t and t.left and t.left.level == t.level:
            left = t.left
            t.left, left.right = left.right, t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t.right and t.right.right and t.level == t.right.right.level:
            right = t.right
            t.right, right.left = right.left, t
            right.level += 1
            return right
        return t

    def add(self, key) -> None:
        self._root = self._add(self._root, key)

    def _add(self, t, key):
        if t is None:
            return self._Node(key)
        if key < t.key:
            t.left = self._add(t.left, key)
        else:
            t.right = self._add(t.right, key)
        return self._split(self._skew(t))

    def remove(self, key) -> None:
        self._root = self._remove(self._root, key)

    def _remove(self, t, key):
        if t is None:
            return None
        if key < t.key:
            t.left = self._remove(t.left, key)
        elif key > t.key:
            t.right = self._remove(t.right, key)
        elif t.left is None:
            return t.right
        elif t.right is None:
            return t.left
        else:
            low = t.right
            while low.left:
                low = low.left
            t.key = low.key
            t.right = self._remove(t.right, low.key)
        level = min(x.level if x else 0 for x in (t.left, t.right)) + 1
        if level < t.level:
            t.level = level
            if t.right and level < t.right.level:
                t.right.level = level
        t = self._skew(t)
        if t.right:
            t.right = self._skew(t.right)
            if t.right.right:
                t.right.right = self._skew(t.right.right)
        t = self._split(t)
        if t.right:
            t.right = self._split(t.right)
        return t

    def tightest(self, size: int):
        """The smallest key whose capacity is at least size, or None."""
        t, best = self._root, None
        while t:
            if t.key[0] >= size:
                best, t = t.key, t.left
            else:
                t = t.right
        return best


def best_fit(sizes, capacity: int, tree: CapacityTree | None = None, opened: int = 0) -> list[int]:
    """The bin of each size, in the given order.  A size above the capacity gets a bin of its own."""
    tree = tree or CapacityTree()
    bins = []
    for size in sizes:
        size = int(size)
        found = tree.tightest(size)
        if found is None:
            found, left = (capacity, opened), capacity - size
            opened += 1
        else:
            tree.remove(found)
            left = found[0] - size
        if left > 0:
            tree.add((left, found[1]))
        bins.append(found[1])
    return bins


def level(sizes: list[int], n_shards: int) -> int:
    """The mean of what is left for each shard when every size above it has a shard alone."""
    left, rest = n_shards, sum(sizes)
    for size in sorted(sizes, reverse=True):
        if left <= 1 or size * left <= rest:
            break
        left, rest = left - 1, rest - size
    return max(1, math.ceil(rest / max(1, left)))


def into_shards(sizes: list[int], n_shards: int) -> list[int]:
    """Best fit decreasing into shards filled up to their level; what then fits nowhere goes, still the largest first, to the emptiest."""
    capacity, out, fills = level(sizes, n_shards), [0] * len(sizes), [0] * n_shards
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    tree = CapacityTree()
    for b in range(n_shards):
        tree.add((capacity, b))
    empty = [(0, b) for b in range(n_shards)]  # fills, some of them out of date
    for i in order:
        found = tree.tightest(sizes[i])
        if found is None:
            while fills[empty[0][1]] != empty[0][0]:
                heapq.heapreplace(empty, (fills[empty[0][1]], empty[0][1]))
            found = (capacity - empty[0][0], empty[0][1])
        b = out[i] = found[1]
        if found[0] > 0:
            tree.remove(found)
        fills[b] += sizes[i]
        if capacity > fills[b]:
            tree.add((capacity - fills[b], b))
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32 and the group hash; no text goes on from here."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("text_hash"),
    )


def _packer(capacity: int):
    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, tree, opened = TaskContext.get().partitionId(), CapacityTree(), 0
        for part in parts:  # sorted by falling size; only the open bins are kept
            bins = best_fit(part["bytes"].tolist(), capacity, tree, opened)
            opened = max(opened, max(bins, default=-1) + 1)
            yield pd.DataFrame({"text_hash": part["text_hash"], "lot": part["lot"], "block": [(task << 32) + b for b in bins], "bytes": part["bytes"], "n_rows": part["n_rows"]})

    return pack


def shard_rows(
    docs: DataFrame,
    n_shards: int | None = 8,
    capacity: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: rows of equal texts
    share a shard.  With ``capacity`` (bytes) instead of ``n_shards``, as few shards
    of that capacity as best fit decreasing finds."""
    spark = docs.sparkSession
    rows = written(measured(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1)), F.approx_count_distinct("text_hash")).first()
    bytes_all, n_rows, n_groups = int(total[0]), int(total[1]), int(total[2])
    shard_bytes = max(1, capacity if capacity else math.ceil(bytes_all / n_shards))
    shards_about = n_shards or math.ceil(bytes_all / shard_bytes) or 1
    block_bytes = max(1, shard_bytes // BLOCKS_PER_SHARD)
    slices = max(1, math.ceil(n_groups / SLICE_GROUPS), min(32, math.ceil(n_groups / 10_000)))

    # A row of an oversized group gets a lot (part) of block size; every other group has the one lot 0.
    whole = rows.groupBy("text_hash").agg(F.sum("size").alias("group_bytes"))
    cut = whole.filter(F.col("group_bytes") > shard_bytes).select("text_hash", F.ceil(F.col("group_bytes") / block_bytes).alias("lots"))
    cut = {bytes(r["text_hash"]): int(r["lots"]) for r in cut.collect()}  # fewer than there are shards

    def lot(hash_col, row):
        out = F.lit(0).cast("long")
        for text_hash, lots in cut.items():
            out = F.when(hash_col == F.lit(text_hash), F.pmod(F.xxhash64(row), F.lit(lots))).otherwise(out)
        return out

    rows = rows.withColumn("lot", lot(F.col("text_hash"), F.col("row")))
    groups = rows.groupBy("text_hash", "lot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    packed = written(
        groups.repartition(slices, "text_hash", "lot")
        .sortWithinPartitions(F.desc("bytes"), "text_hash", "lot")
        .mapInPandas(_packer(block_bytes), "text_hash binary, lot long, block long, bytes long, n_rows long"),
        "shard-groups",
    )
    blocks = packed.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows")).orderBy("block")
    blocks = blocks.collect()  # about BLOCKS_PER_SHARD for each shard and one for each slice
    sizes = [int(b["bytes"]) for b in blocks]
    if capacity:
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
        shards = [0] * len(sizes)
        for i, b in zip(order, best_fit([sizes[i] for i in order], capacity), strict=True):
            shards[i] = b
    else:
        shards = into_shards(sizes, shards_about)
    # A block starts in its shard where the blocks before it end, and is numbered in lots.
    start, placed = {}, []
    for b, s in zip(blocks, shards, strict=True):
        placed.append((int(b["block"]), s, start.get(s, 0), max(1, math.ceil(int(b["n_rows"]) / LOT_ROWS))))
        start[s] = start.get(s, 0) + int(b["n_rows"])
    placed = spark.createDataFrame(placed, "block long, shard int, block_start long, block_lots int")

    home = packed.select("text_hash", "lot", "block").join(F.broadcast(placed), "block") if len(blocks) <= 200_000 else packed.select("text_hash", "lot", "block").join(placed, "block")
    kept = written(rows.join(home, ["text_hash", "lot"]).withColumn("sub", F.pmod(F.xxhash64("row", F.lit(3)), F.col("block_lots"))).select("doc_id", "size", "text_crc32", "shard", "block", "block_start", "sub"), "shard-placed")
    subs = kept.groupBy("block", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("block").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    subs = subs.select("block", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("sub_start"))
    order = Window.partitionBy("block", "sub").orderBy("doc_id", "text_crc32", "size")
    numbered = kept.withColumn("rank", F.row_number().over(order) - 1)
    return numbered.join(subs, ["block", "sub"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("block_start") + F.col("sub_start") + F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
