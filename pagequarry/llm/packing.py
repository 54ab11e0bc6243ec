"""Packing tokenised documents into sequences by the sum-of-squares rule.

Documents become ids of a public tokenizer and an end id; only those longer than a
sequence are cut.  Pieces are dealt by their row's number into slices of a bounded number, whatever their ids, each
packed by one task: longest first, a piece goes where the sum over gaps of the squared
number of open sequences with that gap becomes smallest (a new sequence counts as
gap ``capacity``).  Sequences that the rule leaves with much room are then opened again and
their pieces packed once more by best fit.  A piece's tokens don't travel: packing sees
lengths only.

Defined results: a null or empty text is the end id alone; ties in length are ordered by
document and piece; repeated rows, repeated and null ids are packed each for itself; an empty table gives no
rows; further columns are ignored.  Texts are tokenised whole.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written
from .word_tokens import WordTokens

#: Pieces that one task packs together, about.
SLICE_PIECES = 50_000
#: Rows between two record batches.
LOT = 512

_loaded: dict[str, WordTokens] = {}


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    width, tail = 4 * capacity, np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _loaded.get(path)
        if tokens is None:
            tokens = _loaded[path] = WordTokens(path)
        for batch in released(batches):
            for k in range(0, batch.num_rows, LOT):
                part = batch.slice(k, LOT)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), tokens.encode(part.column(1).cast(pa.binary()).to_pylist()), strict=True):
                    data = ids.astype("<u4").tobytes() + tail
                    for j in range(0, len(data), width):
                        own = data[j : j + width]
                        rows.append((doc, j // width, j // 4, len(own) // 4, zlib.crc32(own), *([own] if with_ids else [])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)

    return run


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as bytes) of every document."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), schema)


def sum_of_squares(lengths, capacity: int) -> tuple[list[int], int]:
    """The bin of each length, in the given order, and the number of bins.

    Moving a bin from gap g to g - s changes the sum of squares by
    2 * (N[g - s] - N[g]) + 2 (without the first term's part for a bin that fills).
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, opened = [], 0
    for s in lengths:
        s = int(s)
        gaps = np.flatnonzero(count[s:]) + s
        change = 2 * (count[gaps - s] - count[gaps]) + 2
        if len(gaps) and gaps[0] == s:
            change[0] = 1 - 2 * count[s]
        new = 2 * count[capacity - s] + 1 if s < capacity else 0
        if len(gaps) and change.min() <= new:
            gap = int(gaps[change.argmin()])  # the tightest of equals
            b = waiting[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, opened
            opened += 1
        if gap > s:
            waiting[gap - s].append(b)
            count[gap - s] += 1
        out.append(b)
    return out, opened


def _best_fit(lengths: list[int], capacity: int) -> tuple[list[int], int]:
    gaps: list[tuple[int, int]] = []
    out, opened = [], 0
    for s in lengths:
        k = bisect.bisect_left(gaps, (s, -1))
        if k < len(gaps):
            gap, b = gaps.pop(k)
        else:
            gap, b = capacity, opened
            opened += 1
        if gap > s:
            bisect.insort(gaps, (gap - s, b))
        out.append(b)
    return out, opened


def pack_slice(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of the lengths, which fall."""
    bins, opened = sum_of_squares(lengths, capacity)
    bins, lengths = np.array(bins, dtype=np.int64), np.asarray(lengths, dtype=np.int64)
    fill = np.bincount(bins, weights=lengths, minlength=opened)
    loose = (fill < capacity - capacity // 256)[bins] if len(bins) else np.zeros(0, dtype=bool)
    again, n = _best_fit(lengths[loose].tolist(), capacity)
    if n < len(np.unique(bins[loose])):
        bins[loose] = opened + np.array(again, dtype=np.int64)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    starts = ends - lengths[order]
    first = np.r_[True, np.diff(bins[order]) != 0] if len(bins) else np.zeros(0, dtype=bool)
    base = np.maximum.accumulate(np.where(first, starts, 0)) if len(bins) else starts
    offsets = np.empty_like(starts)
    offsets[order] = starts - base
    return bins, offsets


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = list(batches)  # a slice: a bounded number of pieces, without their ids
        if not parts:
            return
        slice_ = pa.Table.from_batches(parts)
        bins, offsets = pack_slice(slice_.column("length").to_numpy(), capacity)
        ids = bins + (TaskContext.get().partitionId() << 40)
        slice_ = slice_.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))
        yield from slice_.to_batches(max_chunksize=10_000)

    return run


def pack(pieces: DataFrame, capacity: int = 4096, slice_pieces: int = SLICE_PIECES) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    slices = max(1, math.ceil(pieces.count() / slice_pieces))
    # The row's number in the written table: ids may be null or repeat, so a hash of them could make one slice of all rows.
    dealt = pieces.withColumn("row", F.monotonically_increasing_id()).repartition(slices, F.xxhash64("row", F.lit(11)))
    ordered = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32", "row").drop("row")
    return ordered.mapInArrow(_pack(capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every piece of every document with its place: written once after tokenising, so that it is done once."""
    return pack(written(tokenized_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def sequences(packed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """sequence_id and its ids as bytes: the training rows, each of a sequence at most."""
    key = ("doc_id", "piece", "length", "ids_crc32")  # null and repeated ids as well: rows that agree in all four hold the same ids
    own = pieces_with_ids.select(*(F.col(c).alias(f"own_{c}") for c in key), "ids").dropDuplicates([f"own_{c}" for c in key])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"own_{c}"))
    joined = packed.join(own, same).groupBy("sequence_id").agg(parts.alias("parts"))
    return joined.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
