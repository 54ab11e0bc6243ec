"""Queries over link graphs and crawl logs that Spark derives from the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.operators import crawl
from pagequarry.operators.shared import shared_folder
from pagequarry.sources import derived
from pagequarry.streaming import frontier

from .registry import Registry, part, read

query = Registry()
QUERIES, SQL = query.queries, query.sql

_EDGES = "e AS (SELECT p.page_id AS src, t.dst FROM pages p, LATERAL (SELECT unnest([2 * p.page_id + 1, 2 * p.page_id + 2, p.page_id // 3]) AS dst) t WHERE t.dst IN (SELECT page_id FROM pages))"


#: The walk to its fixed point.  SQL has no visited set, so its recursion ends at a depth that no walk over such ids reaches: they at least
#: double from level to level.
_WALK = (
    f"{_EDGES}, seeds AS (SELECT min(page_id) AS node FROM pages GROUP BY {part('url', 2)}), "
    "w AS (SELECT node, 0 AS depth FROM seeds UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 64), "
    "first AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1)"
)


@query(
    f"WITH RECURSIVE {_WALK} "
    "SELECT f.node, f.depth::INTEGER AS depth, (SELECT min(e.src) FROM e JOIN first g ON g.node = e.src WHERE e.dst = f.node AND g.depth = f.depth - 1) AS parent FROM first f"
)
def crawl_bfs(spark, sf_dir):
    """Breadth-first from the least page of every host, over a graph with cycles and repeated edges, until a level finds nothing new."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    seeds = pages.groupBy(urls.netloc("url").alias("host")).agg(F.min("page_id").alias("node"))
    return crawl.walk(seeds, derived.page_edges(pages), max_depth=None)


@query(
    f"WITH RECURSIVE {_WALK}, p AS (SELECT f.node, f.depth, (SELECT min(e.src) FROM e JOIN first g ON g.node = e.src WHERE e.dst = f.node AND g.depth = f.depth - 1) AS parent FROM first f WHERE f.depth <= 5), "
    "q AS (SELECT *, CASE WHEN parent IS NULL THEN 0 WHEN node = 2 * parent + 1 THEN 0 WHEN node = 2 * parent + 2 THEN 1 ELSE 2 END AS seq FROM p), "
    "n AS (SELECT ceil(count(*) * 0.8)::BIGINT AS n FROM first WHERE depth <= 5), r AS (SELECT *, row_number() OVER (ORDER BY depth, parent NULLS FIRST, seq, node) AS nth FROM q) "
    "SELECT node, depth::INTEGER AS depth, parent FROM r, n WHERE nth <= n.n"
)
def crawl_limited(spark, sf_dir):
    """The same walk to depth 5, and of what that reaches the first four fifths in the order of a queue."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    seeds, edges = pages.groupBy(urls.netloc("url").alias("host")).agg(F.min("page_id").alias("node")), derived.page_edges(pages)
    near = crawl.walk(seeds, edges, max_depth=5).count()
    return crawl.walk(seeds, edges, max_depth=5, max_pages=-(-near * 8 // 10))


_LOG = "log AS (SELECT url, page_id % 7 <> 0 AS ok, TIMESTAMP '2024-01-01' + to_seconds(page_id) AS started, TIMESTAMP '2024-01-01' + to_seconds(page_id + 1) AS ended FROM pages)"


def _log(spark, sf_dir):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = lambda k: F.timestamp_seconds(F.unix_seconds(base) + F.col("page_id") + k)
    return read(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 7 != 0).alias("ok"), at(0).alias("started"), at(1).alias("ended"), F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("HTTP "), F.lit(400) + F.col("page_id") % 100)).alias("error"))


@query(
    f"WITH {_LOG}, a AS (SELECT count(DISTINCT url) AS discovered, count_if(ok)::BIGINT AS processed, count_if(NOT ok)::BIGINT AS failed, epoch(max(ended)) - epoch(min(started)) AS s FROM log) "
    "SELECT discovered, processed, failed, s::DOUBLE AS duration_s, round(processed / greatest(1.0, s), 9)::DOUBLE AS pages_per_second FROM a"
)
def crawl_stats(spark, sf_dir):
    return crawl.stats(_log(spark, sf_dir)).withColumn("pages_per_second", F.round("pages_per_second", 9))


@query(
    "WITH v AS (SELECT count(DISTINCT url) AS visited FROM pages WHERE page_id % 7 <> 0), d AS (SELECT count(DISTINCT url) AS discovered FROM pages) "
    "SELECT visited, discovered - visited AS queued, round(visited / greatest(1, discovered) * 100, 6)::DOUBLE AS progress_percent, round(visited / 60.0, 6)::DOUBLE AS rate, round((discovered - visited) / greatest(0.1, visited / 60.0), 6)::DOUBLE AS eta_s, discovered = visited AS is_complete FROM v, d"
)
def crawl_progress(spark, sf_dir):
    log = _log(spark, sf_dir)
    out = crawl.progress(log.filter("ok").select("url"), log.select("url"), elapsed_s=60.0)
    return out.select("visited", "queued", *[F.round(c, 6).alias(c) for c in ("progress_percent", "rate", "eta_s")], "is_complete")


@query("SELECT url, 'HTTP ' || (400 + page_id % 100) AS error FROM pages WHERE page_id % 7 = 0")
def crawl_errors(spark, sf_dir):
    return crawl.errors(_log(spark, sf_dir))


@query(f"WITH RECURSIVE {_WALK} SELECT depth::INTEGER AS depth, count(*) AS n_pages FROM first GROUP BY 1")
def crawl_levels(spark, sf_dir):
    return crawl.levels(crawl_bfs(spark, sf_dir))


@query("SELECT url, min(page_id % 5)::BIGINT AS depth FROM pages GROUP BY 1")
def stream_first_visits(spark, sf_dir):
    """A stream of discovered URLs through the stateful frontier, to its end; the least depth of each, whatever the batches."""
    folder = shared_folder(spark)
    import uuid

    folder = f"{folder}/stream-{uuid.uuid4().hex}"
    pages = read(spark, sf_dir, "pages")
    stream = spark.readStream.schema(pages.schema).parquet(f"{sf_dir}/page[s].parquet")
    links = stream.select("url", (F.col("page_id") % 5).cast("long").alias("depth"))
    visits = frontier.first_visits(links).drop("depth").writeStream.format("parquet").option("path", f"{folder}/visits").option("checkpointLocation", f"{folder}/visited")
    visits.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    depths = frontier.least_depths(links)
    last = lambda batch, batch_id: batch.write.parquet(f"{folder}/out/batch={batch_id}", mode="overwrite")
    run = depths.writeStream.foreachBatch(last).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    # A URL that several batches saw has a row in each; the later ones are no deeper.
    written = spark.read.schema("host string, url string, depth long, batch long").parquet(f"{folder}/out")
    least = written.groupBy("url").agg(F.min("depth").alias("depth"))
    return spark.read.schema("host string, url string").parquet(f"{folder}/visits").select("url").join(least, "url")
