"""Queries over what connects the operators: fetching, contexts for models, follow rules, requests, caches, statistics of a run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagequarry.functions import rules, text, urls, validation
from pagequarry.operators import control, crawl, relevance
from pagequarry.operators import pages as page_pass
from pagequarry.operators.shared import kept, shared_folder
from pagequarry.sources import cache, derived
from pagequarry.sources import pages as page_source

from .crawling import _EDGES, _LOG, _log
from .native import nav_firsts
from .registry import NAV, Registry, any_of, likely, part, read
from .varied import _LINK_URL, _V

query = Registry()
QUERIES, SQL = query.queries, query.sql

_P, _H = part("url", 3), part("url", 2)
#: Links of the navigation as they are, at another host, with barred paths and as bare fragments.
_SPREAD = f"""WITH {NAV}, l AS (SELECT page_id, page_url, text, CASE (page_id + pos) % 5 WHEN 0 THEN url WHEN 1 THEN replace(url, {_H}, 'elsewhere.example') || '/docs/' WHEN 2 THEN url || '/edit/1' WHEN 3 THEN '#part' ELSE replace(url, {_H}, 'elsewhere.example') END AS url FROM firsts)"""


@query(
    f"{_SPREAD}, x AS (SELECT *, regexp_matches(url, '{any_of(rules.WIKI_EXCLUDED_LINKS)}') AS barred, {_H} = '' OR {_H} = {part('page_url', 2)} AS inside, "
    f"regexp_matches(url, '{any_of(rules.WIKI_DOC_LINKS)}') OR regexp_matches(text, '(?i){any_of(rules.WIKI_DOC_TEXTS)}') AS outside FROM l) "
    f"SELECT page_id, url, NOT barred AND inside AND NOT ({_P} = '' AND {part('url', 5)} <> '' AND {part('page_url', 3)} = '') AND CASE WHEN inside THEN NOT starts_with(url, '#') AND NOT barred ELSE outside END AS followed FROM x"
)
def wiki_follow(spark, sf_dir):
    """The wiki strategy's own follow rule."""
    k = (F.col("page_id") + F.col("pos") + 1) % 5
    away = F.replace("url", urls.netloc("url"), F.lit("elsewhere.example"))
    moved = F.when(k == 0, F.col("url")).when(k == 1, F.concat(away, F.lit("/docs/"))).when(k == 2, F.concat("url", F.lit("/edit/1"))).when(k == 3, F.lit("#part")).otherwise(away)
    links = nav_firsts(read(spark, sf_dir, "pages")).withColumn("url", moved)
    return links.select("page_id", "url", urls.wiki_should_follow("url", "page_url", "text").alias("followed"))


@query(f"WITH {NAV} SELECT page_id, url || '|' || page_url AS cache_key FROM firsts")
def link_cache_keys(spark, sf_dir):
    return nav_firsts(read(spark, sf_dir, "pages")).select("page_id", text.link_cache_key("url", "page_url").alias("cache_key"))


_SUFFIXES = (" - Documentation", " | Documentation", "  |  Documentation", " Documentation", "")


@query(
    "SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN source || ' Documentation' ELSE source END AS title FROM documents"
)
def titles_without_suffix(spark, sf_dir):
    """The name of a documentation site goes where a dash or bar sets it off."""
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", text.without_suffix(F.concat("source", suffix)).alias("title"))


_CONTEXT = "CASE WHEN text <> '' AND p > 0 THEN substr(html, greatest(1, p - 100)::BIGINT, length(text) + 100 + least(100, p - 1)::BIGINT) END"


@query(
    f"WITH {NAV}, t AS (SELECT f.page_id, f.pos, f.text, g.html, strpos(g.html, f.text) AS p FROM firsts f JOIN pages g USING (page_id)) "
    f"SELECT page_id, (pos - 1)::INTEGER AS pos, {_CONTEXT} AS context, CASE WHEN length(html) > 1000 THEN left(html, 1000) || '...' ELSE html END AS sample FROM t"
)
def link_contexts(spark, sf_dir):
    """What a model is shown of a link: the text around it and the start of its page."""
    pages = read(spark, sf_dir, "pages")
    links = nav_firsts(pages).join(pages.select("page_id", "html"), "page_id")
    return links.select("page_id", "pos", relevance.context_of("html", "text").alias("context"), relevance.content_sample("html").alias("sample"))


@query(
    f"WITH {_V}, l AS (SELECT page_id, {_LINK_URL} AS url, 'A' AS link_text FROM v UNION ALL SELECT page_id, site || '/guide/' || i, 'B' FROM v UNION ALL SELECT page_id, site || '/docs/' || i, 'D' FROM v) "
    f"SELECT page_id, url, link_text, 1.0::DOUBLE AS relevance_score, 'pattern_matching' AS method FROM l WHERE {likely('url')}"
)
def filtered_link_chain(spark, sf_dir):
    """References as they stand in varied pages, resolved against their page, of its site, judged with their text, context and sample."""
    pages = derived.varied_pages(read(spark, sf_dir, "documents"))
    nav = F.regexp_extract("html", "(?s)<nav[^>]*>(.*?)</nav>", 1)
    links = pages.select("page_id", F.col("url").alias("page_url"), F.col("html").alias("page_content"), F.explode(F.array_distinct(F.regexp_extract_all(nav, F.lit('<a href="([^"]*)"'), F.lit(1)))).alias("url"))
    return relevance.filter_links(links, F.col("page_url")).select("page_id", "url", "link_text", "relevance_score", "method")


_STATUS = "CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 500 ELSE 200 END"
_FRONTIER = f"{NAV}, u AS (SELECT DISTINCT url FROM firsts UNION SELECT url FROM pages), g AS (SELECT url, html, {_STATUS} AS status FROM pages), b AS (SELECT u.url, g.status, coalesce(g.html, '') <> '' AND g.status < 400 AS ok FROM u LEFT JOIN g USING (url))"


@query(
    f"WITH {_FRONTIER} SELECT url, coalesce(ok, false) AS fetched, CASE WHEN coalesce(ok, false) THEN NULL WHEN status >= 400 THEN 'HTTP ' || status ELSE 'no content' END AS error FROM b"
)
def fetched_frontier(spark, sf_dir):
    """The frontier with its pages; a page that is missing or failed is a row with its error."""
    pages = read(spark, sf_dir, "pages")
    status = F.when(F.col("page_id") % 11 == 0, 404).when(F.col("page_id") % 13 == 0, 500).otherwise(200)
    frontier = nav_firsts(pages).select("url").union(pages.select("url")).distinct()
    ok, failed = crawl.fetched(frontier, pages.select("url", "html", status.alias("status")))
    return ok.select("url", F.lit(True).alias("fetched"), F.lit(None).cast("string").alias("error")).unionByName(failed.select("url", F.lit(False).alias("fetched"), "error"))


@query(f"WITH {_EDGES} SELECT DISTINCT dst AS node, 1 AS depth, src AS parent FROM e WHERE src % 2 = 0")
def frontier_depths(spark, sf_dir):
    """Where the links of a frontier, here every other page, lead one level down."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    frontier = pages.filter("page_id % 2 = 0").select(F.col("page_id").alias("node"))
    return crawl.frontier_links(frontier, derived.page_edges(pages).withColumn("link_seq", F.lit(0)), 1).select("node", "depth", "parent").distinct()


@query(
    f"WITH {_LOG}, a AS (SELECT count(DISTINCT url) AS discovered, count_if(ok)::BIGINT AS processed, count_if(NOT ok)::BIGINT AS failed FROM log), "
    "d AS (SELECT count_if(page_id % 3 <> 0)::BIGINT AS ai_processed, count(DISTINCT CASE WHEN page_id % 3 <> 0 THEN page_id // 10 END) AS batches_processed, count_if(page_id % 3 = 0)::BIGINT AS cache_hits FROM pages WHERE page_id % 7 <> 0) SELECT * FROM a, d"
)
def run_statistics(spark, sf_dir):
    """Counts of a run, with what its models did."""
    log = _log(spark, sf_dir)
    done = log.filter("ok").select(F.lit(True).alias("processed"), (F.col("page_id") % 3 == 0).alias("cached"), F.floor(F.col("page_id") / 10).alias("batch_id"))
    return crawl.run_stats(log, done).select("discovered", "processed", "failed", "ai_processed", "batches_processed", "cache_hits")


@query("SELECT CASE WHEN n = d THEN 100.0 ELSE least(99.9, d / greatest(1, n) * 100) END::DOUBLE AS progress_percent FROM (SELECT count(*) AS n, count_if(page_id % 5 <> 0) AS d FROM pages)")
def run_progress(spark, sf_dir):
    log = read(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 5 != 0, F.col("page_id") % 7 != 0).alias("ok"))
    return crawl.parallel_progress(log)


_MODES = ", ".join(f"'{m}'" for m in (*rules.MODES, "other"))


@query(
    f"WITH r AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace(url, '://', ':/') ELSE url END AS url, list_extract([{_MODES}], (page_id % {len(rules.MODES) + 1} + 1)::BIGINT) AS mode, page_id % 13 AS d, page_id % 12 AS c FROM pages) "
    "SELECT page_id, coalesce(regexp_matches(url, '^https?://[^/]') AND mode <> 'other' AND d BETWEEN 1 AND 10 AND c BETWEEN 1 AND 10, false) AS valid, coalesce(starts_with(url, 'http') AND "
    f"{_H} <> '', false) AS valid_key FROM r"
)
def extract_requests(spark, sf_dir):
    """Which requests, and which keys of a content map, are valid."""
    modes = F.array(*map(F.lit, (*rules.MODES, "other")))
    rows = read(spark, sf_dir, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 4 == 0, F.replace("url", F.lit("://"), F.lit(":/"))).otherwise(F.col("url")).alias("url"),
        F.element_at(modes, (F.col("page_id") % (len(rules.MODES) + 1) + 1).cast("int")).alias("mode"),
        (F.col("page_id") % 13).alias("max_depth"),
        (F.col("page_id") % 12).alias("concurrency"),
    )
    return rows.select("page_id", validation.valid_extract().alias("valid"), validation.valid_content_map("url").alias("valid_key"))


@query("SELECT count(*) AS n, count(*) AS n_distinct, count(*) AS n_well_formed FROM pages")
def operation_ids(spark, sf_dir):
    """An operation's id for every page: all different, all of the form that requests demand."""
    ids = read(spark, sf_dir, "pages").select(control.operation_id_column().alias("id"))
    ids = kept(ids, "ids")  # random, so every count must see the same ones
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_distinct"), F.count_if(F.col("id").rlike("^ex_[0-9a-f]{12}$") & F.col("id").rlike(validation.OPERATION_ID)).alias("n_well_formed"))


@query("SELECT page_id, url, (contains(url, '.example.org/') OR contains(url, '/en/')) AND NOT ends_with(url, '#top') AS kept FROM pages")
def user_url_globs(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", "url", urls.glob_filter("url", ["*.example.org/*", "*/en/*"], ["*#top"]).alias("kept"))


@query("SELECT 'd' || doc_id AS cache_key, CASE WHEN doc_id % 2 = 0 THEN 'even ' ELSE 'odd ' END || text AS result FROM documents")
def cache_round_trip(spark, sf_dir):
    """A cache that isn't there is empty; what two saves appended is read back."""
    path = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    missing = cache.load(spark, path)
    for rest, kind in enumerate(("even ", "odd ")):
        rows = docs.filter(F.col("doc_id") % 2 == rest)
        cache.append(rows.select(F.concat(F.lit("d"), "doc_id").alias("cache_key"), F.concat(F.lit(kind), "text").alias("result")), path)
    return missing.unionByName(cache.load(spark, path))


_FAILED = "CASE page_id % 4 WHEN 0 THEN 'Empty HTML provided' WHEN 1 THEN 'Could not find content container' END"


@query(f"SELECT page_id, page_id % 4 > 1 AS success, {_FAILED} AS error FROM pages")
def failed_pages(spark, sf_dir):
    """Pages without html, and those without any container, are rows with their error."""
    html = F.when(F.col("page_id") % 4 == 0, F.lit(None)).when(F.col("page_id") % 4 == 1, F.lit("plain words")).otherwise(F.col("html"))
    return page_pass.extract(read(spark, sf_dir, "pages").withColumn("html", html), "generic", with_links=False).select("page_id", "success", "error")


@query("SELECT page_id, url || CASE page_id % 4 WHEN 2 THEN '.html' ELSE '' END AS url FROM pages WHERE page_id % 4 > 1")
def pruned_resources(spark, sf_dir):
    """URLs but for images, styles and fonts, which a fetch never asks for."""
    suffix = F.when(F.col("page_id") % 4 == 0, ".png").when(F.col("page_id") % 4 == 1, ".woff2").when(F.col("page_id") % 4 == 2, ".html").otherwise("")
    return page_source.worth_fetching(read(spark, sf_dir, "pages").select("page_id", F.concat("url", suffix).alias("url")))
