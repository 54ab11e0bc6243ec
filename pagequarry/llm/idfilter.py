"""Bloom filters over ids, sized by their number up to a bound.

They spare a scan or a join the rows that certainly have no partner, so that texts are not
shuffled for an id's sake.  With 16 bits an id one row in 70 is suspected for nothing; above ``MOST_BITS``
(32 MB, which a task can hold: 16 million ids; with 100 million one row in four is) a filter spares less and less, and
what is left is a plain join, linear in the rows.  Results never depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import mix

#: Bits of the least and of the largest filter.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def _positions(ids: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of the filter for each id."""
    h = mix(ids.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return np.concatenate([h % np.uint64(bits), (h >> np.uint64(32)) % np.uint64(bits)]).astype(np.int64)


def _bits(bits: int):
    def run(batches):
        field = np.zeros(bits // 64, dtype=np.int64)
        for batch in batches:
            at = _positions(np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64), bits)
            np.bitwise_or.at(field, at >> 6, np.left_shift(np.int64(1), at & 63))
        used = np.flatnonzero(field)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(field[used])], names=["at", "bits"])

    return run


def id_filter(ids: DataFrame) -> np.ndarray:
    """The filter of the (non-null, long) ids in the only column, which are counted first."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * ids.count()).bit_length()))
    rows = ids.mapInArrow(_bits(bits), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    field = np.zeros(bits // 64, dtype=np.int64)
    field[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return field


def may_hold(field: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _positions(ids, 64 * len(field))
    hit = ((field[at >> 6] >> (at & 63)) & 1).astype(bool)
    return hit[: len(ids)] & hit[len(ids) :]


def suspects(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose id is certainly not in the only column of ids (rows with null ids among them), and the others."""
    field = id_filter(ids.filter(F.col(ids.columns[0]).isNotNull()))

    @F.arrow_udf("boolean")
    def suspected(values: pa.Array) -> pa.Array:
        return pa.array(may_hold(field, np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.int64)))

    flag = suspected(F.coalesce(F.col(id_col).cast("long"), F.lit(-1))) & F.col(id_col).isNotNull()
    return docs.filter(~flag), docs.filter(flag)
