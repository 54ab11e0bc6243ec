"""What the operators share: reading, fresh column names, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: White space that separates words in every contract here: blank, tab, line feed, VT, FF, CR.
WS_CLASS = r"[\x20\x09-\x0D]+"


#: Bytes for each core below which a table of few files is dealt over the cores: its one row group would be one task.
SMALL = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def spread(df: DataFrame) -> DataFrame:
    """A small table of few files over all cores; any other as its files are split, without an exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < SMALL * cores and len(df.inputFiles()) < cores else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of df's, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; what Arrow holds unused is given back after each, as it else stays with a Python worker for its next tasks."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def text_lots(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    """First column and texts (the second, as UTF-8) of up to ``rows`` rows with ``size`` bytes of text, or of one longer text."""
    for batch in released(batches):
        texts = batch.column(1).cast(pa.binary())
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            before = int(ends[low - 1]) if low else 0
            high = min(low + rows, max(low + 1, int(np.searchsorted(ends, before + size))))
            high = min(high, batch.num_rows)
            yield batch.column(0).slice(low, high - low), texts.slice(low, high - low).to_pylist()
            low = high


_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, as spark.checkpoint.dir names it; where it isn't set, one of this machine, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _local[context.applicationId]


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder (with a folder for each value of ``by``), read back: its lineage ends here,
    and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
