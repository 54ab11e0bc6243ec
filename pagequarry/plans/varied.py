"""Queries over documentation pages whose parts come and go from page to page.

Spark derives them from documents (``derived.varied_pages``): the container, nested lists, related sections, admonitions, edit
links, framework marks and links depend on the row, and headings and paragraphs are the document's own words.  The SQL works out from
the same row what each branch of the strategies must give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.operators import control, relevance
from pagequarry.operators import pages as page_pass
from pagequarry.sources import derived

from .registry import Registry, likely, read

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: The columns of a varied page in SQL: the words between letters of the text (title and body) and the row's switches.
_V = (
    "v AS (SELECT doc_id AS page_id, doc_id::VARCHAR AS i, doc_id % 4 AS box, doc_id % 3 AS links, doc_id % 5 AS extra, "
    "'https://s' || (doc_id % 7) || '.example.org' AS site, w, coalesce(w[1], 'none') AS head, array_to_string(w, ' ') AS body "
    "FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[^a-zA-Z]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL))"
)
#: Text of the content, long enough for the wiki strategy's limits in every row.
_FILL = "repeat('filling words of the page ', 10)"


def _varied(spark, sf_dir, mode="generic"):
    return page_pass.extract(derived.varied_pages(read(spark, sf_dir, "documents")), mode, with_links=False)


def _links(spark, sf_dir, mode="generic"):
    return page_pass.page_links(derived.varied_pages(read(spark, sf_dir, "documents")), mode)


@query(
    f"WITH {_V} SELECT page_id, CASE box WHEN 0 THEN 'priority_selector:article' WHEN 1 THEN 'priority_selector:div.content' WHEN 2 THEN 'content_scoring' ELSE 'full_body_fallback' END AS extraction_method, head AS title FROM v"
)
def varied_select_method(spark, sf_dir):
    """Selector by priority, the best-scored div, the body: as the page has them."""
    return _varied(spark, sf_dir).select("page_id", "extraction_method", "title")


@query(
    f"WITH {_V} SELECT page_id, CASE box WHEN 0 THEN 'selector:article' WHEN 1 THEN 'heuristic:content_size' WHEN 2 THEN 'heuristic:content_size' ELSE 'fallback:body' END AS extraction_method, head AS title FROM v"
)
def varied_wiki_select_method(spark, sf_dir):
    """The wiki strategy's selectors need text, its divs a class, text and few links; else the body."""
    return _varied(spark, sf_dir, "wiki").select("page_id", "extraction_method", "title")


_INNER = (
    "'<h1>' || head || '</h1><p>' || body || '</p><p>' || trim(" + _FILL + ") || '</p>'"
    " || CASE WHEN extra = 0 THEN '<ul><li>one<ul><li>deep ' || i || '</li></ul></li><li>two</li></ul>' ELSE '' END"
    " || CASE WHEN extra = 1 THEN '<pre><code>bare ' || i || '</code></pre>' WHEN extra = 2 THEN '<pre><code class=\"lang-sql\">set ' || i || '</code></pre>' ELSE '' END"
    " || CASE WHEN extra = 3 THEN '<p data-lang=\"en\">kept</p>' ELSE '' END"
)


@query(
    f"WITH {_V} SELECT page_id, CASE box WHEN 0 THEN '<article>' || {_INNER} || '</article>' WHEN 1 THEN '<div class=\"content\">' || {_INNER} || '</div>' WHEN 2 THEN '<div class=\"page\">' || {_INNER} || '</div>' "
    f"ELSE '<body>' || {_INNER} || CASE WHEN extra = 4 THEN '<section class=\"related-links\"><h3>More</h3><a href=\"/docs/r' || i || '\">Related ' || i || '</a></section>' ELSE '' END || '</body>' END AS content FROM v"
)
def varied_cleaned_content(spark, sf_dir):
    """The whole markup after cleaning: noise, empty blocks, handlers and data attributes are gone, bare pre is wrapped."""
    return _varied(spark, sf_dir).select("page_id", "content")


@query(
    f"WITH {_V} SELECT page_id, 'ul' AS kind, t.list_ix::INTEGER AS list_ix, t.items FROM v, LATERAL (SELECT unnest([0, 1]) AS list_ix, unnest(['onedeep ' || i || '|deep ' || i || '|two', 'deep ' || i]) AS items) t WHERE extra = 0"
)
def varied_nested_lists(spark, sf_dir):
    """Nested lists give the inner items in the outer list and the inner list of its own."""
    rows = _varied(spark, sf_dir).select("page_id", F.posexplode("elements.lists").alias("list_ix", "l"))
    return rows.select("page_id", F.col("l.type").alias("kind"), "list_ix", F.array_join("l.items", "|").alias("items"))


@query(
    f"WITH {_V} SELECT page_id, site || '/docs/r' || i AS url, 'Related ' || i AS text, CASE WHEN box < 2 THEN 'related' ELSE 'related,content' END AS source_type, 7.0::DOUBLE AS priority, 'More' AS section_title FROM v WHERE extra = 4"
)
def varied_related_links(spark, sf_dir):
    """Links of a related section, with its title; where the area is the whole body they were content first, with a lower priority."""
    return _links(spark, sf_dir, "wiki").filter("type = 'related'").select("page_id", "url", "text", "source_type", "priority", "section_title")


_LINK_URL = "site || CASE links WHEN 0 THEN '/Docs/' || i WHEN 1 THEN '/a/LOGIN' ELSE '/p' || i END"
_FOLLOWED = f"SELECT page_id, {_LINK_URL} AS url FROM v UNION ALL SELECT page_id, site || '/guide/' || i FROM v"


@query(
    f"WITH {_V}, l AS ({_FOLLOWED}), r AS (SELECT *, {likely('url')} AS rel FROM l) SELECT page_id, url, rel AS is_relevant, 1.0::DOUBLE AS relevance_score, 'pattern_matching' AS method FROM r WHERE rel"
)
def varied_relevant_links(spark, sf_dir):
    """Links of the pages' navigation that the patterns take for documentation; others of the same pages are not."""
    found = _links(spark, sf_dir).filter("type = 'navigation'")
    return relevance.relevant(found).select("page_id", "url", "is_relevant", "relevance_score", "method")


@query(
    f"WITH {_V} SELECT CASE doc_id % 9 WHEN 0 THEN 'mkdocs' WHEN 1 THEN 'docusaurus' WHEN 2 THEN 'sphinx' WHEN 3 THEN 'hugo' ELSE 'unknown' END AS framework, count(*) AS n FROM (SELECT page_id AS doc_id FROM v) GROUP BY 1"
)
def varied_frameworks(spark, sf_dir):
    return derived.varied_pages(read(spark, sf_dir, "documents")).groupBy(control.detect_framework().alias("framework")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {_V} SELECT page_id, 'Note: Mind ' || i AS note, 'plain ' || i AS plain FROM v WHERE box = 0"
)
def varied_wiki_cleaned(spark, sf_dir):
    """Admonitions get their kind in front; edit links, comments and sidebars inside the content are gone."""
    c = F.col("content")
    text = lambda name: F.regexp_replace(F.regexp_extract(c, f'<div class="{name}">(.*?)</div>', 1), "<[^>]*>", "")
    gone = ~c.rlike("deepwiki-sidebar|edit-page|<!--|github.com|<script|toc-wrapper")
    rows = _varied(spark, sf_dir, "wiki").filter(F.col("extraction_method") == "selector:article").filter(gone)
    return rows.select("page_id", text("note").alias("note"), text("plain-box").alias("plain"))
