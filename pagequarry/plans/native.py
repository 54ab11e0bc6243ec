"""Queries over pages that are Catalyst expressions from the scan to the result."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.functions import rules, text, urls
from pagequarry.operators import control, crawl, export, relevance
from pagequarry.sources import pages as page_source

from .registry import NAV, Registry, any_of, decoded, depth, follow, likely, part, read, stripped

query = Registry()
QUERIES, SQL = query.queries, query.sql
ANCHOR = '<a href="([^"]*)">([^<]*)</a>'


def nav_candidates(pages):
    """page_id, page_url, pos, text, url of the navigation's anchors, which here are root-relative."""
    nav = F.regexp_extract("html", "(?s)<nav[^>]*>(.*?)</nav>", 1)
    hrefs, texts = (F.regexp_extract_all("h", F.lit(ANCHOR), F.lit(k)) for k in (1, 2))
    rows = pages.select("page_id", F.col("url").alias("page_url"), nav.alias("h")).select("page_id", "page_url", F.posexplode(F.arrays_zip(hrefs.alias("href"), texts.alias("text"))).alias("pos", "a"))
    rows = rows.select("page_id", "page_url", "pos", "a.href", "a.text").filter("href <> '' AND href <> '#' AND NOT startswith(href, 'javascript:')")
    return rows.select("page_id", "page_url", "pos", text.decoded(text.stripped("text")).alias("text"), urls.join_rooted("page_url", "href").alias("url"))


def nav_firsts(pages):
    """Each URL of a page once, before any filter."""
    return nav_candidates(pages).groupBy("page_id", "page_url", "url").agg(F.min(F.struct("pos", "text")).alias("f")).select("page_id", "page_url", "url", "f.pos", "f.text")


@query(f"WITH {NAV} SELECT {part('page_url', 2)} AS host, count(DISTINCT page_id) AS n_pages, count(*) AS n_links, count(DISTINCT url) AS n_urls FROM firsts WHERE {follow('url', 'page_url', 'text')} GROUP BY 1")
def site_doc_links(spark, sf_dir):
    links = nav_firsts(read(spark, sf_dir, "pages")).filter(urls.should_follow("url", "page_url", "text"))
    return links.groupBy(urls.netloc("page_url").alias("host")).agg(F.count_distinct("page_id").alias("n_pages"), F.count(F.lit(1)).alias("n_links"), F.count_distinct("url").alias("n_urls"))


@query(f"WITH {NAV} SELECT page_id, url, text, 1.0::DOUBLE AS priority, {depth('url')} AS depth FROM firsts WHERE {follow('url', 'page_url', 'text')}")
def nav_links(spark, sf_dir):
    links = nav_firsts(read(spark, sf_dir, "pages")).filter(urls.should_follow("url", "page_url", "text"))
    return links.select("page_id", "url", "text", F.lit(1.0).alias("priority"), urls.path_depth("url").alias("depth"))


@query(f"WITH {NAV}, u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, url FROM firsts) SELECT page_id, url, {likely('url')} AS is_documentation FROM u")
def doc_url_filter(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    both = pages.select("page_id", "url").unionByName(nav_firsts(pages).select("page_id", "url"))
    return both.select("page_id", "url", urls.likely_documentation("url").alias("is_documentation"))


@query(
    f"SELECT page_id, {part('url', 1)} AS scheme, {part('url', 2)} AS authority, {part('url', 3)} AS path, {part('url', 4)} AS query_part, {part('url', 5)} AS fragment_part, {depth('url')} AS depth FROM pages"
)
def url_parts(spark, sf_dir):
    u = "url"
    return read(spark, sf_dir, "pages").select(
        "page_id", urls.scheme(u).alias("scheme"), urls.netloc(u).alias("authority"), urls.path(u).alias("path"), urls.query(u).alias("query_part"), urls.fragment(u).alias("fragment_part"), urls.path_depth(u).alias("depth")
    )


_SITE = f"array_to_string(list_slice(string_split({part('url', 2)}, '.'), -2, -1), '.')"


@query(f"SELECT page_id, {_SITE} AS site, count(*) OVER (PARTITION BY {_SITE}) - 1 AS n_same_site FROM pages")
def same_site_pages(spark, sf_dir):
    """How many other pages share a page's site: counted by key, never paired."""
    pages = read(spark, sf_dir, "pages").select("page_id", urls.site_key("url").alias("site"))
    sizes = pages.groupBy("site").agg((F.count(F.lit(1)) - 1).alias("n_same_site"))
    return pages.join(sizes, "site").select("page_id", "site", "n_same_site")


@query(
    f"WITH {NAV}, r AS (SELECT *, {likely('url')} AS rel FROM firsts) SELECT page_id, url, text AS link_text, rel AS is_relevant, CASE WHEN rel THEN 1.0 ELSE 0.0 END::DOUBLE AS relevance_score, 'pattern_matching' AS method FROM r WHERE rel"
)
def relevant_links(spark, sf_dir):
    """Same-site links whose verdict reaches the threshold; the patterns are the judge."""
    links = nav_firsts(read(spark, sf_dir, "pages"))
    return relevance.relevant(links).select("page_id", "url", F.col("text").alias("link_text"), "is_relevant", "relevance_score", "method")


@query(
    f"WITH {NAV} SELECT c.page_id, f.pos::INTEGER AS pos, {decoded('c.t')} AS link_text FROM (SELECT page_id, pos FROM firsts) f JOIN (SELECT a.page_id, a.pos, regexp_replace((SELECT b.text FROM anchors b WHERE b.page_id = a.page_id AND ends_with(b.href, a.href) ORDER BY b.pos LIMIT 1), '^\\s+|\\s+$', '', 'g') AS t FROM anchors a) c ON c.page_id = f.page_id AND c.pos = f.pos"
)
def link_texts(spark, sf_dir):
    """The text of each navigation URL looked up in the page again, by a pattern made from the URL."""
    pages = read(spark, sf_dir, "pages")
    firsts = nav_firsts(pages).join(pages.select("page_id", "html"), "page_id")
    href = F.concat(urls.path("url"), F.when(urls.query("url") != "", F.concat(F.lit("?"), urls.query("url"))).otherwise(""), F.when(urls.fragment("url") != "", F.concat(F.lit("#"), urls.fragment("url"))).otherwise(""))
    return firsts.select("page_id", (F.col("pos") + 1).alias("pos"), text.decoded(relevance.link_text("html", href)).alias("link_text"))


_TITLE = decoded(stripped("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"))
_CUT = "CASE WHEN contains(t, ' | ') THEN string_split(t, ' | ')[1] ELSE string_split(t, ' - ')[1] END"


@query(
    f"WITH titles AS (SELECT page_id, {_TITLE} AS t FROM pages), s AS (SELECT *, left({stripped("regexp_replace(t, '[<>:\"/\\\\|?*]', '_', 'g')")}, 100) AS x FROM titles) "
    f"SELECT page_id, {stripped(_CUT)} AS clean_title, CASE WHEN x = '' THEN 'untitled' ELSE x END AS file_name, "
    r"regexp_replace(regexp_replace(regexp_replace(replace(lower(t), ' ', '-'), '[^\p{L}\p{N}_-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS anchor FROM s"
)
def page_names(spark, sf_dir):
    """Cleaned title, file name and anchor of every page's title."""
    t = text.decoded(text.stripped(F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1)))
    rows = read(spark, sf_dir, "pages").select("page_id", t.alias("t"))
    return rows.select("page_id", text.clean_title("t").alias("clean_title"), text.sanitized_filename("t").alias("file_name"), text.anchor("t").alias("anchor"))


_CAP = "upper(left(x, 1)) || lower(substr(x, 2))"
_PATH = f"regexp_replace({part('url', 3)}, '^/+|/+$', '', 'g')"


@query(
    f"WITH p AS (SELECT page_id, {_PATH} AS p, {part('url', 2)} AS h FROM pages), q AS (SELECT *, list_filter(regexp_split_to_array(translate(string_split(p, '/')[-1], '-_', '  '), '\\s+'), lambda x: x <> '') AS words, string_split(h, '.') AS labels FROM p) "
    f"SELECT page_id, CASE WHEN p = '' THEN (SELECT {_CAP} FROM (SELECT labels[1] AS x)) ELSE array_to_string(list_transform(words, lambda x: {_CAP}), ' ') END AS title, "
    f"(SELECT {_CAP} FROM (SELECT CASE WHEN labels[1] = 'www' AND len(labels) > 1 THEN labels[2] ELSE labels[1] END AS x)) AS project FROM q"
)
def titles_from_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.title_from_url("url").alias("title"), urls.project_name("url").alias("project"))


@query("WITH n AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS k FROM pages) SELECT page_id, CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS page_number FROM n")
def page_numbering(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("seq"), F.lit("").alias("title"))
    return export.numbered_pages(pages).select("page_id", "page_number")


@query("SELECT sum(strlen(html))::BIGINT AS total_size, count(*) AS file_count, count(DISTINCT url) AS url_count FROM pages")
def export_manifest(spark, sf_dir):
    """Sizes of an export that writes a file for each page."""
    rendered = read(spark, sf_dir, "pages").select(F.concat("page_id", F.lit(".html")).alias("file_name"), F.col("html").alias("text"), "url")
    return export.totals(export.manifest(rendered))


_LOOK = "regexp_matches(c, '^\\s*<') AND contains(c, '</')"


@query(
    "WITH r AS (SELECT 'd' || doc_id AS k, text AS c FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages) "
    f"SELECT k, length(coalesce(c, '')) BETWEEN 1 AND 100000 AS valid, coalesce({_LOOK}, false) AS is_html, "
    f"coalesce({_LOOK} AND NOT contains(lower(c), '<html') AND NOT contains(lower(c), '<body'), false) AS fragment, coalesce(NOT contains(c, chr(10)) AND length(c) > 500, false) AS single_line FROM r"
)
def content_validation(spark, sf_dir):
    from pagequarry.functions import validation

    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("k"), F.col("text").alias("content"))
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("k"), F.col("html").alias("content"))
    checked = validation.content_checks(docs.unionByName(pages))
    has = lambda w: F.coalesce(F.array_contains("warnings", w), F.lit(False)).alias(w)
    return checked.select("k", "valid", "is_html", has("fragment"), has("single_line"))


@query(
    "WITH s AS (SELECT page_id, url, html, CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 500 ELSE 200 END AS status FROM pages) "
    "SELECT page_id, status::INTEGER AS status, coalesce(html <> '' AND status < 400, false) AS fetched FROM s"
)
def status_filter(spark, sf_dir):
    status = F.when(F.col("page_id") % 11 == 0, 404).when(F.col("page_id") % 13 == 0, 500).otherwise(200)
    ok, failed = page_source.split_status(read(spark, sf_dir, "pages").withColumn("status", status))
    return ok.select("page_id", "status", F.lit(True).alias("fetched")).unionByName(failed.select("page_id", "status", F.lit(False).alias("fetched")))


@query(f"WITH {NAV} SELECT DISTINCT f.url FROM firsts f WHERE f.url NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)")
def crawl_frontier_antijoin(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return crawl.unvisited(nav_firsts(pages).select("url"), pages.select("url"))


@query(f"WITH {NAV} SELECT page_id, url, count(*) AS n FROM cand GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_links(spark, sf_dir):
    return nav_candidates(read(spark, sf_dir, "pages")).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(
    "WITH f AS (SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(html, '{mark}') THEN '{name}'" for name, mark in control.FRAMEWORK_MARKS) + " ELSE 'unknown' END AS framework FROM pages) SELECT framework, count(*) AS n FROM f GROUP BY 1"
)
def frameworks(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(control.detect_framework().alias("framework")).agg(F.count(F.lit(1)).alias("n"))


_WIKI = any_of(rules.WIKI_EXCLUDED_LINKS)


@query(
    f"WITH {NAV}, e AS (SELECT page_id, page_url, url, text FROM firsts UNION ALL SELECT page_id, page_url, replace(url, {part('url', 2)}, 'elsewhere.example') || CASE WHEN page_id % 3 = 0 THEN '.md' WHEN page_id % 3 = 1 THEN '/edit/1' ELSE '' END, CASE WHEN page_id % 4 = 0 THEN 'How  To' ELSE text END FROM firsts) "
    f"SELECT page_id, url, regexp_matches(url, '{_WIKI}') AS excluded, CASE WHEN {part('url', 2)} = '' OR {part('url', 2)} = {part('page_url', 2)} THEN NOT starts_with(url, '#') AND NOT regexp_matches(url, '{_WIKI}') "
    f"ELSE regexp_matches(url, '{any_of(rules.WIKI_DOC_LINKS)}') OR regexp_matches(text, '(?i){any_of(rules.WIKI_DOC_TEXTS)}') END AS doc_link FROM e"
)
def wiki_link_predicates(spark, sf_dir):
    links = nav_firsts(read(spark, sf_dir, "pages")).select("page_id", "page_url", "url", "text")
    suffix = F.when(F.col("page_id") % 3 == 0, ".md").when(F.col("page_id") % 3 == 1, "/edit/1").otherwise("")
    away = links.select("page_id", "page_url", F.concat(F.replace("url", urls.netloc("url"), F.lit("elsewhere.example")), suffix).alias("url"), F.when(F.col("page_id") % 4 == 0, "How  To").otherwise(F.col("text")).alias("text"))
    both = links.unionByName(away)
    return both.select("page_id", "url", urls.excluded("url").alias("excluded"), urls.looks_like_doc("url", "text", "page_url").alias("doc_link"))


@query(
    f"WITH {NAV}, r AS (SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth, count(*) OVER (PARTITION BY page_id) AS n FROM firsts) SELECT page_id, (pos - 1)::INTEGER AS pos, nth::INTEGER AS nth, n AS n_links FROM r"
)
def first_seen_order(spark, sf_dir):
    w = Window.partitionBy("page_id")
    return nav_firsts(read(spark, sf_dir, "pages")).select("page_id", "pos", F.row_number().over(w.orderBy("pos")).alias("nth"), F.count(F.lit(1)).over(w).alias("n_links"))
