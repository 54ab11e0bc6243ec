"""A crawl that fetches as it goes: URL, page, links, and the URLs these lead to, level by level.

A fetch stage is a function from a frontier (url, ...) to (url, html, status, started, ended).  ``fetching`` makes one of any
callable (a plain GET, a browser, a test double): the frontier is dealt by host, and a task fetches the URLs of a host one after the other with the host's
delay between them; ``reading`` makes one of a table of pages.  Between two fetches stands an anti-join with what was visited,
so each URL is fetched once in a run, whichever pages link to it and however often.

Each level is one table (folder ``level=N`` in the shared folder): every page of it with its status, its content and its links, and
the failed ones with their errors.  The visited set, the log, the statistics and the pages of the run are reads of that one folder, so
no plan grows with the depth, and a lost executor costs no page that an earlier level has fetched.
"""

from __future__ import annotations

import importlib
import random
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry import schemas
from pagequarry.functions import urls
from pagequarry.sources import pages as page_source

from . import crawl, pages
from .relevance import numbered
from .shared import shared_folder

Fetch = Callable[[str, float], tuple[str, int]]
FetchStage = Callable[[DataFrame], DataFrame]

#: A fetched page of a crawl, where no level says so.
PAGE = f"url string, depth int, parent string, place long, html string, status int, started timestamp, ended timestamp, ok boolean, fetch_error string, page_id long, {schemas.CONTENT}, followed array<struct<seq:int,url:string>>"
FETCHED = "url string, html string, status int, started timestamp, ended timestamp"


@dataclass(frozen=True)
class Pace:
    """How a host is asked: seconds between two requests and a random part more, a longer pause after each batch, a limit for each request,
    tries after an error of the server, and lanes (requests of one host at a time)."""

    delay: float = 0.5
    jitter: float = 0.5
    batch: int = 20
    timeout: float = 30.0
    retries: int = 0
    lanes: int = 1


def _callable(fetch: Fetch | str) -> Fetch:
    if callable(fetch):
        return fetch
    module, _, name = fetch.rpartition(".")
    return getattr(importlib.import_module(module), name)


def _fetch_rows(fetch: Fetch | str, pace: Pace):
    zone = timezone.utc

    def one(get: Fetch, url: str) -> tuple[str, int]:
        for attempt in range(pace.retries + 1):
            try:
                html, status = get(url, pace.timeout)
            except Exception:  # a page never fails its task
                html, status = "", 500
            if status < 500 or attempt == pace.retries:
                break
            time.sleep(pace.delay)
        return html, status

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, last, done, now = _callable(fetch), None, 0, lambda: datetime.now(zone)
        for batch in batches:
            for host, lane, url in zip(*(batch.column(c).to_pylist() for c in ("host", "lane", "url")), strict=True):
                if (host, lane) != last:
                    last, done = (host, lane), 0
                elif pace.delay > 0:
                    time.sleep((1 if done % pace.batch else 2) * pace.delay + random.uniform(0, pace.jitter))
                done += 1
                began = now()
                html, status = one(get, url)
                columns = [pa.array([url]), pa.array([html], pa.string()), pa.array([status], pa.int32()), *(pa.array([t], pa.timestamp("us", "UTC")) for t in (began, now()))]
                yield pa.RecordBatch.from_arrays(columns, names=["url", "html", "status", "started", "ended"])

    return run


def fetching(fetch: Fetch | str = page_source.http_get, pace: Pace = Pace(), tasks: int | None = None) -> FetchStage:
    """A fetch stage of a callable (url, timeout) -> (html, status), or its import path.

    A host's URLs (of each lane) are of one task, in order; ``tasks`` says into how many the hosts are dealt.
    """

    def stage(frontier: DataFrame) -> DataFrame:
        n = tasks or 4 * frontier.sparkSession.sparkContext.defaultParallelism
        asked = frontier.select("url", urls.netloc("url").alias("host")).withColumn("lane", F.pmod(F.xxhash64("url"), F.lit(max(1, pace.lanes))))
        asked = page_source.worth_fetching(asked)
        return asked.repartition(n, "host", "lane").sortWithinPartitions("host", "lane", "url").mapInArrow(_fetch_rows(fetch, pace), FETCHED)

    return stage


def reading(table: DataFrame) -> FetchStage:
    """A fetch stage that finds pages (url, html, optional status) in a table; a URL that isn't there has status 404."""

    def stage(frontier: DataFrame) -> DataFrame:
        status = F.coalesce(F.col("status"), F.lit(200)) if "status" in table.columns else F.lit(200)
        found = table.select(F.col("url").alias("_at"), "html", status.cast("int").alias("_status"))
        asked = page_source.worth_fetching(frontier.select("url"))
        both = asked.join(found, asked["url"] == found["_at"], "left").dropDuplicates(["url"])
        now = F.current_timestamp()
        return both.select("url", "html", F.coalesce("_status", F.lit(404)).alias("status"), now.alias("started"), now.alias("ended"))

    return stage


@dataclass
class Crawl:
    """What a crawl has left: its folder of levels, and how far it came."""

    spark: SparkSession
    path: str
    schema: str
    levels: int = 0
    counts: dict = field(default_factory=lambda: {"processed": 0, "failed": 0, "queued": 0})

    def table(self) -> DataFrame:
        """All fetched pages, failed ones too: url, depth, parent, place, page_id, status, ok, error, started, ended, content columns, links."""
        if not self.levels:  # no seeds, or canceled before the first fetch
            return self.spark.createDataFrame([], PAGE).drop("html")
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/level={n}" for n in range(self.levels)])

    def pages(self) -> DataFrame:
        """The pages that were fetched and extracted."""
        return self.table().filter("ok AND success")

    def log(self) -> DataFrame:
        """url, ok, error, depth, started, ended of every fetch."""
        table = self.table()
        done = table["ok"] & F.coalesce(table["success"], F.lit(False))
        return table.select("url", done.alias("ok"), F.when(~table["ok"], F.col("fetch_error")).when(~done, F.col("error")).alias("error"), "depth", "started", "ended")

    def links(self) -> DataFrame:
        """src, dst, link_seq of the links that were followed or could have been."""
        return self.table().select(F.col("url").alias("src"), F.explode("followed").alias("l")).select("src", F.col("l.url").alias("dst"), F.col("l.seq").alias("link_seq"))


def crawl_site(
    seeds: DataFrame,
    stage: FetchStage,
    mode: str = "generic",
    max_depth: int | None = 5,
    max_pages: int | None = None,
    choose: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    on_level: Callable[[dict], None] | None = None,
    canceled: Callable[[], bool] | None = None,
) -> Crawl:
    """Fetch the seeds (url) and what they lead to, breadth first, until a level finds nothing new or a limit is reached.

    Links of pages at max_depth are not followed.  With max_pages the pages first in the order of a queue are fetched: by depth, their
    parent's place, and their link's place in it.  choose: which links (page_id, page_url, url, text, seq, ...) of which
    pages to follow, beside the strategy's own rule.  on_level is told processed, failed, queued, progress (percent) and the level after each level.
    """
    spark = seeds.sparkSession
    pages.select_strategy(mode)
    folder = f"{shared_folder(spark)}/crawl-{uuid.uuid4().hex}"
    out = Crawl(spark, f"{folder}/pages", "")
    named = urls.with_scheme(F.trim("url")).alias("url")
    first = seeds.select(named).filter("url IS NOT NULL").distinct()
    first = first.select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.struct(F.lit(-1).cast("long").alias("parent_place"), F.lit(0).alias("seq"), "url").alias("queue"))

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    frontier, level, fetched = written(first, "frontier/0"), 0, 0
    waiting = frontier.count()
    while waiting and (max_pages is None or fetched < max_pages) and not (canceled and canceled()):
        if max_pages is None:  # no order is needed
            todo = frontier.withColumn("place", F.lit(0).cast("long"))
        else:
            todo = numbered(frontier, "queue").withColumn("place", F.col("row_ix") + fetched).filter(F.col("place") < max_pages).drop("row_ix")
        got = stage(todo.select("url"))
        ok = (F.coalesce(F.col("html"), F.lit("")) != "") & (F.coalesce(F.col("status"), F.lit(500)) < 400)
        failed = F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status"))).otherwise("no content")
        # The table of fetched pages is written before they are parsed: a failed parse fetches nothing again.
        whole = todo.select("url", "depth", "parent", "place").join(got, "url", "left").withColumn("ok", F.coalesce(ok, F.lit(False)))
        whole = written(whole.withColumn("fetch_error", F.when(~F.col("ok"), failed)).withColumn("page_id", F.xxhash64("url")), f"fetched/{level}")
        found = pages.extract(whole.filter("ok"), mode)
        links = found if max_depth is None or level < max_depth else found.withColumn("links", F.slice("links", 1, 0))
        links = pages.links_of(pages.candidates(links), mode)
        links = choose(links, found) if choose else links
        by_page = links.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "url"))).alias("followed"))
        record = found.drop("url", "links").join(by_page, "page_id", "left")
        table = whole.drop("html").join(record, "page_id", "left").withColumn("followed", F.coalesce("followed", F.array().cast("array<struct<seq:int,url:string>>")))
        table.write.parquet(f"{out.path}/level={level}")
        out.schema = out.schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
        out.levels = level = level + 1
        own = spark.read.schema(out.schema).parquet(f"{out.path}/level={level - 1}")
        done = own.agg(F.count_if(F.col("ok") & F.col("success")).alias("processed"), F.count(F.lit(1)).alias("n")).first()
        out.counts["processed"] += done["processed"]
        out.counts["failed"] += done["n"] - done["processed"]
        fetched += done["n"]
        new = own.select(F.col("url").alias("parent"), "place", F.explode("followed").alias("l"))
        new = new.groupBy(F.col("l.url").alias("url")).agg(F.min(F.struct("place", "l.seq", "parent")).alias("f"))
        new = new.join(out.table().select("url"), "url", "left_anti")
        new = new.select("url", F.lit(level).alias("depth"), F.col("f.parent").alias("parent"), F.struct(F.col("f.place").alias("parent_place"), F.col("f.seq").alias("seq"), "url").alias("queue"))
        frontier = written(new, f"frontier/{level}")
        waiting = frontier.count()
        left = waiting if max_pages is None else min(waiting, max_pages - fetched)
        out.counts["queued"] = left
        if on_level:
            on_level(out.counts | {"level": level - 1, "progress": 100.0 * fetched / max(1, fetched + left)})
    return out


def statistics(found: Crawl) -> DataFrame:
    """discovered, processed, failed, duration_s, pages_per_second of a crawl."""
    return crawl.stats(found.log())
