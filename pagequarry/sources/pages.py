"""Pages: tables of them, and a live source that fetches URLs.

The live source is a Python data source: a partition per host, whose URLs are fetched in batches one after the other, so that a host's minimum
delay holds over all of them.  Fetching is a plain HTTP GET, or any callable given by
import path (a browser, a test double).  A page never fails its task: errors have status 500.
"""

from __future__ import annotations

import importlib
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

USER_AGENT = "Mozilla/5.0 (compatible; pagequarry)"
#: What a fetch never asks for: images, styles and fonts.
PRUNED = r"(?i)\.(png|jpe?g|gif|webp|css|woff2?|ttf|otf)([?#]|$)"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html of a Parquet table."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def worth_fetching(urls: DataFrame, column: str = "url") -> DataFrame:
    return urls.filter(~F.col(column).rlike(PRUNED))


def split_status(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fetched, failed): html that isn't empty with a status below 400, and the rest."""
    ok = F.coalesce((F.col("html") != "") & (F.col("status") < 400), F.lit(False))
    return pages.filter(ok), pages.filter(~ok)


def http_get(url: str, timeout: float) -> tuple[str, int]:
    try:
        request = urllib.request.Request(url, headers={"User-Agent": USER_AGENT})
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            charset = reply.headers.get_content_charset() or "utf-8"
            return reply.read().decode(charset, "replace"), reply.status
    except urllib.error.HTTPError as error:
        return "", error.code
    except (OSError, ValueError):
        return "", 500


@dataclass
class _Host(InputPartition):
    urls: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.batch, self.delay = int(options.get("batchSize", "20")), float(options.get("delay", "0.5"))
        self.timeout, self.fetcher = float(options.get("timeout", "30")), options.get("fetcher", "")

    def partitions(self):
        by_host: dict[str, list[str]] = {}
        for url in self.urls:
            by_host.setdefault(urlparse(url).netloc, []).append(url)
        return [_Host(tuple(v)) for v in by_host.values()]

    def read(self, partition: _Host) -> Iterator[tuple]:
        fetch = http_get
        if self.fetcher:
            module, _, name = self.fetcher.rpartition(".")
            fetch = getattr(importlib.import_module(module), name)
        for k, url in enumerate(partition.urls):
            if k:  # a longer pause between batches
                time.sleep((1 if k % self.batch else 2) * self.delay + random.uniform(0, self.delay))
            html, status = fetch(url, self.timeout)
            yield url, html, status


class LivePages(DataSource):
    """``spark.read.format("live_pages").option("urls", "\\n".join(urls))``; also batchSize, delay, timeout, fetcher."""

    @classmethod
    def name(cls) -> str:
        return "live_pages"

    def schema(self) -> str:
        return "url string, html string, status int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetch(spark: SparkSession, urls: list[str], **options) -> DataFrame:
    """url, html, status of each of the URLs that is worth fetching."""
    spark.dataSource.register(LivePages)
    urls = [u for u in urls if not re.search(PRUNED, u)]
    return spark.read.format("live_pages").option("urls", "\n".join(urls)).options(**{k: str(v) for k, v in options.items()}).load()
