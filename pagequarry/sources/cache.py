"""Result caches: an append log of snapshots with compaction by key.

A cache is a folder of ``snapshot=N`` folders of Parquet.  Saving adds a snapshot, so a run can save after every few batches and a
lost one leaves the earlier snapshots as they are.  Reading takes the latest row of each key.  ``compact`` writes these as one more snapshot
and drops the ones before it; what is read in between is the same.  Missing is empty; files that can't be read are set aside: their keys are misses.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTENT_CACHE = "cache_key string, result string"
LINK_CACHE = "cache_key string, is_relevant boolean, relevance_score double, reason string, method string"
#: Snapshots after which saving compacts.
SNAPSHOTS = 32


def _folder(spark: SparkSession, path: str):
    """The file system of a path and the path on it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete snapshots, ascending."""
    files, at = _folder(spark, path)
    if not files.exists(at) or not files.getFileStatus(at).isDirectory():
        return []
    found = []
    for status in files.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("snapshot=") and name[9:].isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name[9:]))
    return sorted(found)


def load(spark: SparkSession, path: str, schema: str = CONTENT_CACHE) -> DataFrame:
    """The latest row of each key."""
    numbers = snapshots(spark, path)
    if not numbers:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(f"{schema}, snapshot long").option("basePath", path).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    try:
        rows = reader.parquet(*[f"{path}/snapshot={n}" for n in numbers])
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if len(numbers) == 1:  # one save has each key once
        return rows.drop("snapshot")
    columns = [c for c in rows.columns if c not in ("cache_key", "snapshot")]
    return rows.groupBy("cache_key").agg(F.max_by(F.struct(*columns), "snapshot").alias("r")).select("cache_key", "r.*")


def append(rows: DataFrame, path: str) -> None:
    """One more snapshot, of rows with each key once (of several any)."""
    spark = rows.sparkSession
    numbers = snapshots(spark, path)
    rows.dropDuplicates(["cache_key"]).write.mode("overwrite").parquet(f"{path}/snapshot={max(numbers, default=0) + 1}")
    if len(numbers) + 1 >= SNAPSHOTS:
        compact(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))


def compact(spark: SparkSession, path: str, schema: str = CONTENT_CACHE) -> None:
    """All snapshots as one; the ones before it are dropped only when it is complete."""
    numbers = snapshots(spark, path)
    if len(numbers) < 2:
        return
    load(spark, path, schema).write.mode("overwrite").parquet(f"{path}/snapshot={numbers[-1] + 1}")
    files, _ = _folder(spark, path)
    for n in numbers:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot={n}"), True)


def clear(spark: SparkSession, path: str, schema: str = CONTENT_CACHE) -> None:
    files, at = _folder(spark, path)
    for n in snapshots(spark, path):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(at, f"snapshot={n}"), True)
