"""Streams of pages: incremental extraction, live metrics, and a visited set as state.

``first_visits`` keeps the URLs already seen, so a stream of discovered links yields each
once; its state is an entry for each URL in the engine's state store.  ``extract_stream`` is the
micro-batch form of the page pass; ``enrich_stream`` works on new rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.operators import pages

def extract_stream(stream: DataFrame, mode: str = "generic") -> DataFrame:
    """Extraction of a stream of (page_id, url, html), with processed and failed counts as observed metrics."""
    out = pages.extract(stream, mode)
    return out.observe("extraction", F.count_if(F.col("success")).alias("processed"), F.count_if(~F.col("success")).alias("failed"))


def first_visits(links: DataFrame, max_depth: int = 5) -> DataFrame:
    """host, url, depth of every URL's first arrival in a stream of (url, depth).

    The state is one small entry for each URL, dealt by URL: a large site is no group, and a micro-batch touches only its own
    URLs.  The depth is that of the arrival, of several in one batch any; ``least_depths`` gives the least over all that was written.
    """
    near = links.filter(F.col("depth") <= max_depth).select(urls.netloc("url").alias("host"), "url", "depth")
    return near.dropDuplicates(["url"])


def least_depths(arrivals: DataFrame) -> DataFrame:
    """host, url and the least depth of each URL, from a stream of (url, depth); for update or complete output."""
    return arrivals.groupBy(urls.netloc("url").alias("host"), "url").agg(F.min("depth").alias("depth"))


def enrich_stream(stream: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Each micro-batch of new rows through ``process`` into a Parquet table.

    The batch id names the folder, which is overwritten, so a batch that runs twice is written once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
