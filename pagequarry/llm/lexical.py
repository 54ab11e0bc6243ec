"""Ranked lexical search the other way round: the items stay, the documents stream by.

An inverted index over the items' terms (term to items and their multiplicities) is broadcast.  A first scan counts the
documents, their terms and, for the index's terms, the documents that hold them.  In a second scan each task looks each
document's term counts up in the index and adds to the scores of the items that share them; it keeps a heap of the k best for each item, and gives the heaps out at its end.
The heaps are merged, first in lots of tasks, then for each item.

Whatever a task holds is bounded: a lot of texts, the index, k rows for each item.  The index holds the terms of a block of items
with at most ``INDEX_TERMS`` occurrences; more items are searched block by block, each against all documents.

The score is in 64-bit integers: a term that an item holds counts, each time, w * ((10**9 * tf) div (1000 * tf + 8 * m)), with
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 25 + (75 * n * N) div L.

Defined results: null and empty texts have no terms, they are in no count and found by no item; an item without terms (null text
as well) finds nothing; equal scores are ranked by ascending id, null ids last; repeated rows are ranked each for itself, so are
repeated items (by rows of one item id: one ranking for each row would tie in rank, so they are one item with all their terms);
an empty table on either side gives no rows; further columns are ignored.  Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import released, text_lots, written
from .wordhash import ALPHANUMERIC, word_hashes

#: Term occurrences of the items in one broadcast index (some 100 MB of arrays at most).
INDEX_TERMS = 2_000_000
#: Texts, and bytes of them, that a task scores together.
LOT, LOT_BYTES = 256, 1 << 20
#: Heaps of so many lots of tasks are merged apart.
LOTS = 64
_LAST = (1 << 63) - 1


class Index:
    """Terms (hashes, ascending) with their items (numbers) and how often each item holds them."""

    def __init__(self, terms: np.ndarray, items: np.ndarray, times: np.ndarray, ids: list):
        order = np.lexsort((items, terms))
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.items, self.times = items[order].astype(np.int64), times[order].astype(np.int64)
        self.starts = np.append(starts, len(order)).astype(np.int64)
        self.ids = ids  # of the items

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms of the index, and their numbers."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == hashes)
        return hit, at[hit]


def _terms(texts: list[bytes | None]) -> list[np.ndarray]:
    return list(word_hashes(texts, is_word=ALPHANUMERIC))


def _item_terms(batches):
    for batch in released(batches):
        for item, terms in zip(batch.column(0).to_pylist(), _terms(batch.column(1).cast(pa.binary()).to_pylist()), strict=True):
            own, times = np.unique(terms, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(own.view(np.int64)), pa.array(times)], names=["item_id", "term", "times"])


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term, times: one row for each term that an item holds."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_item_terms, "item_id long, term long, times long")
    return rows.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _block_of(terms: DataFrame, bound: int) -> tuple[DataFrame, int]:
    """The terms with a block number for each item, so that a block holds about ``bound`` rows (one item more at most)."""
    total = terms.count()
    blocks = max(1, math.ceil(2 * total / bound)) if total > bound else 1
    return terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")), blocks


def _index(rows: DataFrame) -> Index:
    found = rows.select("item_id", "term", "times").toArrow()  # INDEX_TERMS rows, about
    ids = found.column("item_id").combine_chunks().dictionary_encode() if found.num_rows else pa.array([], pa.int64()).dictionary_encode()
    own = np.asarray(ids.indices.fill_null(len(ids.dictionary)), dtype=np.int64)
    names = [*ids.dictionary.to_pylist(), *([None] if ids.null_count else [])]
    return Index(np.asarray(found.column("term"), dtype=np.int64).view(np.uint64), own, np.asarray(found.column("times")), names)


def _counted(shared):
    def run(batches):
        index: Index = shared.value
        n_docs = n_terms = 0
        held = np.zeros(len(index.terms), dtype=np.int64)
        for _, texts in text_lots(batches, LOT, LOT_BYTES):
            texts = _terms(texts)
            sizes = np.array([len(t) for t in texts])
            n_docs += int((sizes > 0).sum())
            n_terms += int(sizes.sum())
            hit, term = index.find(np.concatenate(texts))
            doc = np.searchsorted(np.cumsum(sizes), hit, side="right")
            np.add.at(held, np.unique(doc * len(index.terms) + term) % len(index.terms), 1)
        used = np.flatnonzero(held)
        term = np.concatenate([[-1, -2], used])
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(np.concatenate([[n_docs, n_terms], held[used]]), pa.int64())], names=["term", "n"])

    return run


def statistics(texts: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """N, L and df of each term of the index; a task gives out a row for each term that it met."""
    index: Index = shared.value
    rows = texts.mapInArrow(_counted(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = np.asarray(rows.column("term"), dtype=np.int64), np.asarray(rows.column("n"), dtype=np.int64)
    df = np.zeros(len(index.terms), dtype=np.int64)
    df[term[term >= 0]] = n[term >= 0]
    total = lambda key: int(n[term == key].sum())
    return total(-1), total(-2), df


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def _scored(shared, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches):
        from pyspark import TaskContext

        index: Index = shared.value
        width, n_items = len(index.terms), len(index.ids)
        worth = index.times * np.repeat(weights, np.diff(index.starts))  # of a posting, for one unit of the document's part
        heaps: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]
        floor = np.ones(n_items, dtype=np.int64)
        for ids, texts in text_lots(batches, LOT, LOT_BYTES):
            ids, texts = ids.to_pylist(), _terms(texts)
            sizes = np.array([len(t) for t in texts])
            hit, term = index.find(np.concatenate(texts))
            doc = np.searchsorted(np.cumsum(sizes), hit, side="right")
            pair, tf = np.unique(doc * width + term, return_counts=True)
            doc, term = pair // width, pair % width
            m = np.array([25 + (75 * n * n_docs) // n_terms for n in sizes.tolist()], dtype=np.int64)[doc]
            part = 1_000_000_000 * tf // (1000 * tf + 8 * m)
            # The postings of all terms of all documents of the lot, one after the other.
            long = index.starts[term + 1] - index.starts[term]
            first = np.cumsum(long) - long
            posting = np.arange(long.sum()) + np.repeat(index.starts[term] - first, long)
            scores = np.zeros(len(texts) * n_items, dtype=np.int64)
            np.add.at(scores, np.repeat(doc, long) * n_items + index.items[posting], worth[posting] * np.repeat(part, long))
            scores = scores.reshape(len(texts), n_items)
            for row, item in zip(*(x.tolist() for x in np.nonzero(scores >= floor)), strict=True):
                heap, key = heaps[item], (int(scores[row, item]), -(_LAST if ids[row] is None else ids[row]))
                if len(heap) < k:
                    heapq.heappush(heap, key)
                else:
                    heapq.heappushpop(heap, key)
                if len(heap) == k:
                    floor[item] = heap[0][0]
        found = [(index.ids[item], None if -doc == _LAST else -doc, score) for item, heap in enumerate(heaps) for score, doc in heap]
        lot = TaskContext.get().partitionId() % LOTS
        columns = zip(*found, strict=True) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([lot] * len(found), pa.int32())], names=["item_id", "doc_id", "score", "lot"])

    return run


def merged(heaps: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of each item, of the k best of its lots."""
    best = (F.desc("score"), F.asc_nulls_last("doc_id"))
    lots = heaps.withColumn("at", F.row_number().over(Window.partitionBy("item_id", "lot").orderBy(*best))).filter(F.col("at") <= k)
    ranked = lots.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, index_terms: int = INDEX_TERMS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's k best documents."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    terms, blocks = _block_of(written(item_terms(items, item_id, item_text), "item-terms"), index_terms)
    found = None
    for block in range(blocks):
        shared = spark.sparkContext.broadcast(_index(terms.filter(F.col("block") == block)))
        if not len(shared.value.terms):
            continue
        n_docs, n_terms, df = statistics(texts, shared)
        heaps = texts.mapInArrow(_scored(shared, term_weights(n_docs, df), n_docs, max(n_terms, 1), k), "item_id long, doc_id long, score long, lot int")
        found = heaps if found is None else found.unionByName(heaps)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return merged(found, k)
