"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is coded relative to the nearest of a few centroids: its residual is rotated at random
and each component kept as a sign, packed into D bits, with two scalars, the residual's length and
the inner product of the residual's direction with its own code.  For a query, the inner
product with the code divided by that scalar estimates the true one, with an error of at most
``epsilon * sqrt((1 - c*c) / (c*c * (D - 1)))`` but for rare cases.  Vectors whose lower bound
on the distance exceeds the k-th smallest upper bound are left out; all others are compared
exactly, in double precision, with the original components.

Every vector is indexed; only rotation and centroids are fitted, on a bounded sample (mini-batches of it).  A query
looks into the lists of its nearest centroids.  How many it must look into is measured: for a bounded sample of the
queries the true neighbours are found by an exact scan of all rows, and the fewest lists that hold the wanted share
of them are probed (all lists, where the data have no clusters: then the estimates, not the vectors, are
all pairs of queries and rows).

The number of lists grows with the table: one for every ``LIST_ROWS`` vectors, from some millions on with the root of
their number, up to a quarter of the sample (beyond that, at about 270 million vectors, lists grow longer).  Lists are cut into
sub-lists and queries into blocks of bounded numbers, and a task joins one sub-list with one block
of queries; so a list with a third of all vectors is many tasks.  A vector travels once, beside its code; only lists that more than a block of
queries look into are sent once per block.  The exact comparison is made in the same task: to send codes alone and join the survivors
with their vectors costs more, as one-bit bounds leave many (see the README).  Within a task the bits are spread to signs, because a matrix
product over them is faster here than counting bits one query at a time.

Defined results: vectors that are null, zero, of another dimension than most, or hold null or
non-finite components take no part; equal distances go to the smaller id; repeated ids are
candidates each, and one query (the one of the least vector); a query is no candidate of its own (all rows of its id are left out); an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Vectors that the centroids are fitted on, at most.
SAMPLE = 1 << 18
#: Vectors in a list, about, in tables of up to some millions.
LIST_ROWS = 2_000
#: Vectors of a mini-batch, and passes over the sample.
BATCH, PASSES = 8_192, 8
#: Vectors in a sub-list and queries in a block, about.
SUB_ROWS, BLOCK_QUERIES = 8_000, 16_384
#: Queries whose bounds a task holds at once.
AT_ONCE = 64
#: Queries that the number of probed lists is measured on, at most, and the recall they must reach.
MEASURED, RECALL = 128, 0.98
#: Width of the error bound in standard deviations.
EPSILON = 3.0


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and vector (array of float as given) of those that take part, and their dimension."""
    one = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).filter(
        one.isNotNull()
        & F.col("vec_id").isNotNull()
        & F.forall(one, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(one, lambda x: x != 0)
    )
    most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = int(most["d"]) if most else 0
    return rows.filter(F.size("vector") == d), d


def _matrix(column, d: int, kind=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(-1, d)


def list_count(n: int) -> int:
    """Lists for n vectors."""
    return max(1, round(min(n / LIST_ROWS, 4 * math.sqrt(n), SAMPLE / 4)))


def fit(rows: DataFrame, d: int, n_lists: int, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """A random rotation, and centroids of the vectors whose ids hash lowest (SAMPLE at most)."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(min(SAMPLE, max(1_000, 128 * n_lists)))
    points = _matrix(sample.select("vector").toArrow().column(0), d, np.float32)
    points = points[rng.permutation(len(points))]
    centres = points[:n_lists].astype(np.float64)
    seen = np.zeros(len(centres))
    for turn in range(PASSES):
        seen[:] = 0 if len(points) <= BATCH else seen * 0.5  # earlier centres weigh less and less
        for k in range(0, len(points), BATCH):
            part = points[k : k + BATCH]
            own = nearest_lists(part, centres, 1)[:, 0]
            n = np.bincount(own, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, own, part)
            hit = n > 0
            seen[hit] += n[hit]
            centres[hit] += (sums[hit] - n[hit, None] * centres[hit]) / seen[hit, None]
    return rotation, centres


def nearest_lists(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each point, nearest first; a few megabytes of distances at a time."""
    out, n = [], min(n, len(centres))
    narrow, half = centres.astype(np.float32).T, ((centres**2).sum(axis=1) / 2).astype(np.float32)
    step = max(1, (1 << 22) // max(1, len(centres)))
    for k in range(0, len(points), step):
        away = half[None, :] - points[k : k + step].astype(np.float32) @ narrow
        if n == 1:
            out.append(away.argmin(axis=1)[:, None])
            continue
        best = np.argpartition(away, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(n), (len(away), 1))
        order = np.lexsort((best, np.take_along_axis(away, best, axis=1)), axis=1)
        out.append(np.take_along_axis(best, order, axis=1))
    return np.concatenate(out) if out else np.empty((0, n), dtype=np.int64)


def _encode(rotation: np.ndarray, centres: np.ndarray):
    d = len(rotation)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column(1), d)
            lists = nearest_lists(points, centres, 1)[:, 0]
            rest = points - centres[lists]
            norms = np.sqrt((rest**2).sum(axis=1))
            turned = (rest / np.where(norms > 0, norms, 1)[:, None]) @ rotation
            codes = np.packbits(turned > 0, axis=1)
            own = np.abs(turned).sum(axis=1) / math.sqrt(d)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(own)],
                names=["vec_id", "vector", "list", "code", "norm", "own"],
            )

    return run


def _probe(centres: np.ndarray, probes: int, held: np.ndarray, k: int):
    """Each query with the lists nearest to it: ``probes`` of them, and more where these hold fewer than k vectors beside its own."""
    d = centres.shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points, own = _matrix(batch.column(1), d), batch.column(2).to_numpy()
            lists = nearest_lists(points, centres, probes)
            rows, chosen = [np.repeat(np.arange(len(points)), lists.shape[1])], [lists.ravel()]
            for row in np.flatnonzero(held[lists].sum(axis=1) < k + own):
                order = nearest_lists(points[row : row + 1], centres, len(centres))[0]
                enough = np.searchsorted(np.cumsum(held[order]), k + own[row]) + 1
                rows.append(np.full(max(0, min(enough, len(order)) - probes), row))
                chosen.append(order[probes:enough])
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(chosen).astype(np.int32))], names=["query_id", "query", "list"])

    return run


def _nearest_of_sample(points: np.ndarray, ids: np.ndarray, k: int):
    d = points.shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, own, lists = _matrix(batch.column(1), d), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            away = (vectors**2).sum(axis=1)[None, :] - 2 * points @ vectors.T
            away[ids[:, None] == own[None, :]] = np.inf
            best = np.argsort(away, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(points), dtype=np.int32), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(away[q, best.ravel()]), pa.array(lists[best.ravel()])], names=["q", "away", "list"])

    return run


def measured_probes(index: DataFrame, asked: DataFrame, centres: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The fewest lists that hold this share of the true neighbours of a sample of the queries."""
    sample = asked.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(MEASURED).toArrow()
    if not sample.num_rows:
        return 1
    points, ids = _matrix(sample.column("vector"), centres.shape[1]), sample.column("vec_id").to_numpy()
    near = index.select("vec_id", "vector", "list").mapInArrow(_nearest_of_sample(points, ids, k), "q int, away double, list int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("away"))
    true = near.withColumn("rank", rank).filter((F.col("rank") <= k) & (F.col("away") < F.lit(float("inf")))).select("q", "list").toArrow()  # MEASURED * k rows
    place = np.argsort(nearest_lists(points, centres, len(centres)), axis=1)
    needed = np.sort(place[true.column("q").to_numpy(), true.column("list").to_numpy()] + 1)
    return int(needed[math.ceil(recall * len(needed)) - 1]) if len(needed) else 1


def estimates(codes: np.ndarray, norms: np.ndarray, own: np.ndarray, queries: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds on squared distances; queries: rotated residuals.

    codes: packed bits.  The rows are queries, the columns vectors.
    """
    d = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    length = np.sqrt((queries**2).sum(axis=1))
    inner = (queries.astype(np.float32) @ signs.T).astype(np.float64) / math.sqrt(d)  # with length still in it
    own = np.where(norms > 0, np.maximum(own, 1e-6), 1.0)
    centre = norms**2 + (length**2)[:, None] - 2 * norms * inner / own
    slack = 2 * norms * length[:, None] * epsilon * np.sqrt(np.maximum(0, 1 - own**2) / (own**2 * max(1, d - 1))) + 1e-5 * (norms**2 + (length**2)[:, None])
    return centre - slack, centre + slack


def _search(rotation: np.ndarray, centres: np.ndarray, k: int):
    """The k nearest of one sub-list for each query of one block."""
    d = len(rotation)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        if not index.num_rows or not asked.num_rows:
            return schema.empty_table()
        vectors, ids = _matrix(index.column("vector"), d), index.column("vec_id").to_numpy()
        codes = np.frombuffer(b"".join(index.column("code").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        norms, own = index.column("norm").to_numpy(), index.column("own").to_numpy()
        queries, query_ids = _matrix(asked.column("query"), d), asked.column("query_id").to_numpy()
        centre = centres[index.column("list")[0].as_py()]
        found = []
        for at in range(0, len(queries), AT_ONCE):
            some = query_ids[at : at + AT_ONCE]
            low, high = estimates(codes, norms, own, (queries[at : at + AT_ONCE] - centre) @ rotation)
            same = some[:, None] == ids[None, :]
            low[same] = high[same] = np.inf
            limit = np.partition(high, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(some), np.inf)
            for j, query in enumerate(queries[at : at + AT_ONCE]):
                chosen = np.flatnonzero((low[j] <= limit[j]) & ~same[j])
                away = np.sqrt(((vectors[chosen] - query) ** 2).sum(axis=1))
                best = np.lexsort((ids[chosen], away))[:k]
                found.append((np.full(len(best), some[j]), ids[chosen][best], away[best]))
        return pa.table([np.concatenate(c) for c in zip(*found, strict=True)], schema=schema)

    return run


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest vectors found for each query.

    queries: rows of the same columns; None takes the vectors whose id is divisible by 100.
    probes: lists that each query looks into; None measures how many are needed.
    """
    rows, d = usable(vectors, id_col, vector_col)
    asked = rows.filter(F.col("vec_id") % 100 == 0) if queries is None else usable(queries, id_col, vector_col)[0].filter(F.size("vector") == d)
    if not d:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = written(asked.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.count(F.lit(1)).alias("times")), "ann-asked")
    rotation, centres = fit(rows, d, list_count(rows.count()))
    kind = rows.schema["vector"].dataType.simpleString()
    index = written(rows.mapInArrow(_encode(rotation, centres), f"vec_id long, vector {kind}, list int, code binary, norm double, own double"), "ann-index")
    probes = min(len(centres), probes or measured_probes(index, asked, centres, k))
    counts = index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).toArrow()  # a row per list
    held = np.zeros(len(centres), dtype=np.int64)
    held[counts.column("list").to_numpy()] = counts.column("n").to_numpy()
    routed = written(asked.mapInArrow(_probe(centres, probes, held, k), f"query_id long, query {kind}, list int"), "ann-queries")

    sizes = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / SUB_ROWS).alias("subs"))
    sizes = sizes.join(routed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("blocks")), "list")
    sizes = F.broadcast(written(sizes, "ann-sizes"))  # a row per list, SAMPLE / 4 at most
    own_sub, own_block = F.pmod(F.xxhash64("vec_id", "code", F.lit(1)), "subs"), F.pmod(F.xxhash64("query_id", F.lit(2)), "blocks")
    index = index.join(sizes, "list").withColumn("sub", own_sub).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("subs", "blocks")
    routed = routed.join(sizes, "list").withColumn("block", own_block).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs", "blocks")
    keys = ["list", "sub", "block"]
    pairs = index.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(_search(rotation, centres, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
