"""Breadth-first walks over a link graph, level by level, with depth and page limits.

``frontier`` and ``visited`` are tables: a level is an equi-join of the frontier with the links, an anti-join with
what was visited, and a deduplication by first discovery.  Each level is checkpointed in the
shared folder, so lineage doesn't grow with depth.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut


#: Levels after which the visited nodes become one table.
UNITED = 16


def walk(seeds: DataFrame, edges: DataFrame, max_depth: int | None = 5, max_pages: int | None = None) -> DataFrame:
    """node, depth, parent of every node reached; links of nodes at max_depth are not followed;
    without one the walk ends where a level finds nothing new.

    seeds: (node); edges: (src, dst[, link_seq]).  A node's depth is that of its first
    discovery, its parent the least one of that level.  With max_pages the nodes first in (depth, parent, link_seq,
    node) order stay: the order of a queue.
    """
    if "link_seq" not in edges.columns:
        edges = edges.withColumn("link_seq", F.lit(0))
    edges = edges.select("src", "dst", "link_seq")
    kind = seeds.schema["node"].dataType
    frontier = cut(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("link_seq")))
    visited, n = frontier, frontier.count()
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        if max_pages is not None and n >= max_pages:
            break
        found = frontier_links(frontier, edges, depth)
        first = found.groupBy("node").agg(F.min(F.struct("parent", "link_seq")).alias("f")).select("node", F.lit(depth).alias("depth"), "f.parent", "f.link_seq")
        frontier = cut(first.join(visited.select("node"), "node", "left_anti"))
        new = frontier.count()
        if not new:
            break
        visited, n = visited.unionByName(frontier), n + new
        if depth % UNITED == 0:
            visited = cut(visited)  # one scan in place of as many as there are levels
    if max_pages is not None:
        visited = visited.orderBy("depth", F.asc_nulls_first("parent"), "link_seq", "node").limit(max_pages)
    return visited.select("node", "depth", "parent")


def unvisited(frontier: DataFrame, visited: DataFrame, key: str = "url") -> DataFrame:
    """What is to be fetched: the frontier, each key once, without what was visited."""
    return frontier.dropDuplicates([key]).join(visited.select(key), key, "left_anti")


def fetched(frontier: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frontier rows with their page, and the failed ones: no page, no html, or a status from 400."""
    status = F.coalesce(F.col("status"), F.lit(200)) if "status" in pages.columns else F.lit(200)
    both = frontier.join(pages.withColumn("status", status), "url", "left")
    ok = F.coalesce(F.col("html"), F.lit("")) != ""
    ok = ok & (F.col("status") < 400)
    return both.filter(ok), both.filter(~F.coalesce(ok, F.lit(False))).select("url", F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status"))).otherwise("no content").alias("error"))


def frontier_links(frontier: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """node, depth, parent, link_seq: where the links of the frontier (node) lead, one level down."""
    ends = edges.select(F.col("src").alias("parent"), F.col("dst"), F.col("link_seq").alias("seq"))
    found = frontier.select(F.col("node").alias("parent")).join(ends, "parent")
    return found.select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), "parent", F.col("seq").alias("link_seq"))


def stats(log: DataFrame) -> DataFrame:
    """discovered, processed, failed, duration_s and pages_per_second from (url, ok, started, ended)."""
    seconds = F.coalesce((F.unix_micros(F.max("ended")) - F.unix_micros(F.min("started"))) / 1e6, F.lit(0.0))
    return log.agg(
        F.count_distinct("url").alias("discovered"), F.count_if(F.col("ok")).alias("processed"), F.count_if(~F.col("ok")).alias("failed"), seconds.alias("duration_s")
    ).withColumn("pages_per_second", F.col("processed") / F.greatest(F.lit(1.0), F.col("duration_s")))


def run_stats(log: DataFrame, enriched: DataFrame) -> DataFrame:
    """``stats`` with what the models did: ai_processed, batches_processed and cache_hits of enriched (processed, cached, batch_id)."""
    asked = F.col("processed") & ~F.col("cached")
    done = enriched.agg(F.count_if(asked).alias("ai_processed"), F.count_distinct(F.when(asked, F.col("batch_id"))).alias("batches_processed"), F.count_if(F.col("cached")).alias("cache_hits"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  (a row on either side)
    return one(stats(log)).join(one(done), "_one").drop("_one")


def progress(visited: DataFrame, discovered: DataFrame, elapsed_s: float, max_pages: int | None = None) -> DataFrame:
    """visited, queued, progress_percent, rate, eta_s, is_complete."""
    seen = visited.select("url", F.lit(1).alias("v"), F.lit(0).alias("d")).union(discovered.select("url", F.lit(0), F.lit(1)))
    each = seen.groupBy("url").agg(F.max("v").alias("v"), F.max("d").alias("d"))
    both = each.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("visited"), F.coalesce(F.sum("d"), F.lit(0)).alias("discovered"))
    queued = F.greatest(F.lit(0), F.col("discovered") - F.col("visited"))
    rate = F.col("visited") / F.lit(max(elapsed_s, 1e-9))
    done = (queued == 0) | (F.col("visited") >= F.lit(max_pages) if max_pages is not None else F.lit(False))
    return both.select(
        "visited", queued.alias("queued"), (F.col("visited") / F.greatest(F.lit(1), F.col("visited") + queued) * 100).alias("progress_percent"), rate.alias("rate"),
        F.when(rate > 0, queued / F.greatest(F.lit(0.1), rate)).alias("eta_s"), done.alias("is_complete"),
    )


def parallel_progress(log: DataFrame) -> DataFrame:
    """Percent of discovered pages that are done, at most 99.9 until all are."""
    done = F.count_if(F.col("ok").isNotNull())
    share = done / F.greatest(F.lit(1), F.count(F.lit(1))) * 100
    return log.agg(F.when(done == F.count(F.lit(1)), 100.0).otherwise(F.least(F.lit(99.9), share)).alias("progress_percent"))


def errors(log: DataFrame) -> DataFrame:
    """The failed pages with their errors, one row each."""
    return log.filter(~F.col("ok")).select("url", "error")


def levels(reached: DataFrame) -> DataFrame:
    return reached.groupBy("depth").agg(F.count(F.lit(1)).alias("n_pages"))


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_nth = 1").drop("_nth")
