"""Queries over what runs are made of: a crawl that fetches, pacing, events, caches with snapshots, calls in flight, table functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.operators import control, enrich, live, udtf
from pagequarry.operators import pages as page_pass
from pagequarry.operators.shared import shared_folder
from pagequarry.sources import cache, derived
from pagequarry.streaming import pacing

from .registry import NAV, Registry, decoded, part, read, stripped
from .varied import _V

query = Registry()
QUERIES, SQL = query.queries, query.sql

_SITE = "s AS (SELECT page_id, page_id % 4 AS h, page_id // 4 AS i, CASE WHEN page_id % 11 = 10 THEN 404 ELSE 200 END AS status FROM pages)"


@query(
    f"WITH RECURSIVE {_SITE}, w AS (SELECT h, 0::BIGINT AS i, 0 AS depth FROM s WHERE i = 0 UNION SELECT w.h, t.dst, w.depth + 1 FROM w JOIN s ON s.h = w.h AND s.i = w.i AND s.status = 200, "
    "LATERAL (SELECT unnest([2 * w.i + 1, 2 * w.i + 2, w.i // 3]) AS dst) t WHERE w.depth < 40), f AS (SELECT h, i, min(depth) AS depth FROM w GROUP BY 1, 2) "
    "SELECT 'https://h' || f.h || '.example.org/p' || f.i AS url, f.depth::INTEGER AS depth, coalesce(s.status, 404)::INTEGER AS status, coalesce(s.status, 404) = 200 AS ok, "
    "CASE WHEN coalesce(s.status, 404) = 200 THEN 'Page ' || page_id END AS title FROM f LEFT JOIN s ON s.h = f.h AND s.i = f.i"
)
def live_crawl(spark, sf_dir):
    """From the first page of every host: fetch, parse, follow, fetch, until nothing new is found; missing and failed pages are rows."""
    site = derived.site_pages(read(spark, sf_dir, "pages"))
    found = live.crawl_site(site.filter(F.col("url").endswith("/p0")).select("url"), live.reading(site), max_depth=None)
    return found.table().select("url", "depth", "status", "ok", "title")


@query(f"SELECT {part('url', 2)} AS host, count(*) AS n_urls, true AS kept_apart FROM pages WHERE {part('url', 2)} <> '' GROUP BY 1")
def stream_pacing(spark, sf_dir):
    """When each URL of a stream may be fetched: a host's at least half a second apart."""
    folder = f"{shared_folder(spark)}/pacing-{uuid.uuid4().hex}"
    schema = read(spark, sf_dir, "pages").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/page[s].parquet").filter(urls.netloc("url") != "")
    run = pacing.paced(stream.select("url"), delay=0.5).writeStream.format("parquet").option("path", f"{folder}/slots").option("checkpointLocation", f"{folder}/state")
    run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    slots = spark.read.schema(pacing.SLOTS).parquet(f"{folder}/slots")
    # The slots of a host are as many as its URLs, none the same, and span the delays between them.
    span = F.unix_micros(F.max("not_before")) - F.unix_micros(F.min("not_before"))
    apart = (F.count_distinct("not_before") == F.count(F.lit(1))) & (span >= (F.count(F.lit(1)) - 1) * 499_999)
    return slots.groupBy("host").agg(F.count(F.lit(1)).alias("n_urls"), apart.alias("kept_apart"))


_STATES = ("pending", "running", "running", "completed")


@query("SELECT 'ex_' || page_id AS operation_id, list_extract(['pending', 'running', 'running', 'completed'], (page_id % 4 + 1)::BIGINT) AS status, (25 * (page_id % 4))::DOUBLE AS progress, page_id % 4 + 1 AS events FROM pages")
def operation_states(spark, sf_dir):
    """The latest state of an operation for every page, by the events that it has left so far."""
    events = read(spark, sf_dir, "pages").select(F.concat(F.lit("ex_"), "page_id").alias("operation_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("page_id") % 4)).alias("seq"))
    states = F.array(*map(F.lit, _STATES))
    events = events.withColumn("status", F.element_at(states, (F.col("seq") + 1).cast("int"))).withColumn("progress", (25 * F.col("seq")).cast("double"))
    return control.latest_states(events).select("operation_id", "status", "progress", "events")


@query(
    "SELECT doc_id AS page_id, coalesce(f, 'unknown') AS framework, CASE WHEN f IS NULL THEN 0 ELSE 0.9 END::DOUBLE AS confidence, coalesce('name:' || f || '|generator:' || f, '') AS indicators FROM "
    "(SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'mkdocs' WHEN 1 THEN 'docusaurus' WHEN 2 THEN 'sphinx' WHEN 3 THEN 'hugo' END AS f FROM documents WHERE doc_id IS NOT NULL)"
)
def framework_confidence(spark, sf_dir):
    """Framework, confidence and indicators of varied pages."""
    pages = derived.varied_pages(read(spark, sf_dir, "documents")).select("page_id", control.framework_evidence().alias("e"))
    return pages.select("page_id", "e.framework", "e.confidence", F.array_join("e.indicators", "|").alias("indicators"))


@query("SELECT 'd' || doc_id AS cache_key, CASE WHEN doc_id % 3 = 0 THEN 'new ' ELSE 'old ' END || coalesce(text, '') AS result FROM documents WHERE doc_id IS NOT NULL")
def cache_snapshots(spark, sf_dir):
    """A cache of two snapshots, compacted into one: the later row of a key."""
    path = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    for word, rows in (("old ", docs), ("new ", docs.filter("doc_id % 3 = 0"))):
        cache.append(rows.select(F.concat(F.lit("d"), "doc_id").alias("cache_key"), F.concat(F.lit(word), F.coalesce("text", F.lit(""))).alias("result")), path)
    cache.compact(spark, path)
    return cache.load(spark, path)


def _answers(contents, mode, kind):
    """A stand-in model that refuses what begins with a number that ends in 3."""
    if any(c.split(" ", 1)[0].endswith("3") for c in contents):
        raise ValueError("refused")
    return [f"{mode}: {c}" for c in contents]


@query(
    "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN '' ELSE 'clean: ' END || doc_id || ' ' || coalesce(text, '') AS result, doc_id % 10 <> 3 AS processed, CASE WHEN doc_id % 10 = 3 THEN 'refused' END AS error FROM documents WHERE doc_id IS NOT NULL"
)
def calls_in_flight(spark, sf_dir):
    """Contents given to a model with four calls of a task under way; one call in ten fails, for itself."""
    docs = read(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("content"))
    return enrich.process(docs, _answers, batch_size=1, at_once=4).select("doc_id", "result", "processed", "error")


def _nav_anchors(tree, url):
    """A user's strategy: the anchors of the page's nav as they stand."""
    nav = tree.find("nav")
    return [] if nav is None else [{"url": a.get("href"), "text": a.stripped()} for a in nav.find_all("a") if a.get("href")]


@query(f"WITH {NAV} SELECT page_id, href AS url, {decoded(stripped('text'))} AS text FROM anchors WHERE href <> ''")
def lateral_links(spark, sf_dir):
    """A strategy as a table function in SQL."""
    udtf.register(spark, "nav_anchors", _nav_anchors)
    view = f"pages_{uuid.uuid4().hex}"
    read(spark, sf_dir, "pages").createOrReplaceTempView(view)
    return spark.sql(f"SELECT p.page_id, l.url, l.text FROM {view} p, LATERAL nav_anchors(p.html, p.url, 'url, text') l")


_HOST = f"lower({part('url', 1)}) || '://' || {part('url', 2)}"


@query(
    f"SELECT page_id, 0 AS kind, {_HOST} || '/a/c' || page_id AS resolved FROM pages UNION ALL SELECT page_id, 1, {_HOST} || {part('url', 3)} || '?v=' || page_id FROM pages "
    f"UNION ALL SELECT page_id, 2, {_HOST} || regexp_replace({part('url', 3)}, '[^/]*$', '') || 'x' || page_id || '#y' FROM pages UNION ALL SELECT page_id, 3, 'https://other.example/' || page_id FROM pages"
)
def resolved_references(spark, sf_dir):
    """References of four kinds resolved against every page."""
    i = F.col("page_id").cast("string")
    kinds = [F.concat(F.lit("/a/./b/../c"), i), F.concat(F.lit("?v="), i), F.concat(F.lit("./x"), i, F.lit("#y")), F.concat(F.lit("https://other.example/"), i)]
    rows = read(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.array(*kinds)).alias("kind", "href"))
    return rows.select("page_id", "kind", urls.join("url", "href").alias("resolved"))


@query(
    f"WITH {_V} SELECT page_id, '# ' || head || CASE WHEN body = '' THEN '' ELSE chr(10) || chr(10) || body END || chr(10) || chr(10) || trim(repeat('filling words of the page ', 10)) "
    "|| CASE extra WHEN 0 THEN chr(10) || chr(10) || '* one' || chr(10) || chr(10) || '  * deep ' || i || chr(10) || '* two' "
    "WHEN 1 THEN chr(10) || chr(10) || '```' || chr(10) || 'bare ' || i || chr(10) || '```' WHEN 2 THEN chr(10) || chr(10) || '```sql' || chr(10) || 'set ' || i || chr(10) || '```' "
    "WHEN 3 THEN chr(10) || chr(10) || 'kept' ELSE CASE WHEN box = 3 THEN chr(10) || chr(10) || '### More' || chr(10) || chr(10) || '[Related ' || i || '](/docs/r' || i || ')' ELSE '' END END AS markdown FROM v"
)
def varied_markdown(spark, sf_dir):
    """Markdown of the contents of varied pages: headings, paragraphs, nested lists, code, links."""
    return page_pass.page_markdown(derived.varied_pages(read(spark, sf_dir, "documents")))
