"""Queries through the DOM pass: given pages, and documentation pages that Spark derives from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.operators import pages as page_pass
from pagequarry.sources import derived

from .registry import NAV, Registry, decoded, depth, follow, read

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _pages(spark, sf_dir, mode="generic"):
    return page_pass.extract(read(spark, sf_dir, "pages"), mode, with_links=False)


def _rich(spark, sf_dir, mode="generic"):
    return page_pass.extract(derived.rich_pages(read(spark, sf_dir, "documents")), mode, with_links=False)


def _links(spark, sf_dir, mode="generic"):
    return page_pass.page_links(derived.rich_pages(read(spark, sf_dir, "documents")), mode)


_H1 = decoded("trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1))")
_D = "d AS (SELECT doc_id AS page_id, doc_id::VARCHAR AS i, (doc_id + 1)::VARCHAR AS n, coalesce(lang, 'xx') AS lang, coalesce(source, 'none') AS source FROM documents WHERE doc_id IS NOT NULL), u AS (SELECT *, 'https://' || source || '.example.org' AS site FROM d)"


def _values(rows: list[str], columns: str) -> str:
    """One row per derived page and listed row, over the columns of u."""
    return f"WITH {_D} " + " UNION ALL ".join(f"SELECT page_id, {r} FROM u" if k else f"SELECT page_id, {', '.join(f'{v} AS {c}' for v, c in zip(_split(r), columns.split(), strict=True))} FROM u" for k, r in enumerate(rows))


def _split(row: str) -> list[str]:
    out, level, quoted, start = [], 0, False, 0
    for k, ch in enumerate(row):
        quoted ^= ch == "'"
        if not quoted:
            level += (ch in "([") - (ch in ")]")
            if ch == "," and not level:
                out.append(row[start:k])
                start = k + 1
    return [*out, row[start:]]


@query(f"SELECT page_id, {_H1} AS title FROM pages")
def page_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "title")


@query("SELECT page_id, CASE WHEN contains(html, '<article') THEN 'priority_selector:article' WHEN contains(html, '<body') THEN 'full_body_fallback' ELSE 'extraction_failed' END AS extraction_method, true AS success FROM pages")
def content_select_method(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "extraction_method", "success")


@query(f"SELECT page_id, 1 AS level, {_H1} AS heading FROM pages")
def headings(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.inline("elements.headings")).select("page_id", "level", F.col("text").alias("heading"))


_STRIPPED = decoded(r"trim(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '\s*<[^>]*>\s*', '', 'g'))")


@query(f"SELECT page_id, length({_STRIPPED})::BIGINT AS text_chars FROM pages")
def article_text(spark, sf_dir):
    """get_text(strip=True) of the article as an expression: strings stripped one by one."""
    from pagequarry.functions import text

    article = F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1)
    return read(spark, sf_dir, "pages").select("page_id", F.length(text.stripped_text(article)).cast("long").alias("text_chars"))


@query(f"WITH {NAV} SELECT page_id, url, text, 'navigation' AS type, 1.0::DOUBLE AS priority, {depth('url')} AS depth FROM firsts WHERE {follow('url', 'page_url', 'text')}")
def generic_page_links(spark, sf_dir):
    """The generic link strategy on the given pages, through the tree; the SQL reads them with patterns."""
    return page_pass.page_links(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "type", "priority", "depth")


_DAY = "'2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0')"


@query(_values(["'title', 'Named ' || i", "'lang', lang", f"'last-modified', {_DAY}", f"'last_modified', {_DAY}", "'canonical_url', site || '/docs/' || i"], "key value"))
def page_metadata(spark, sf_dir):
    return _rich(spark, sf_dir).select("page_id", F.explode("metadata").alias("key", "value"))


@query(_values(["1, 'Doc' || i, ''", "2, 'Usage', 'use-' || i", "2, 'API Reference ' || i, ''", "2, 'End', ''", "3, 'Detail', ''"], "level heading anchor_id"))
def rich_headings(spark, sf_dir):
    return _rich(spark, sf_dir).select("page_id", F.inline("elements.headings")).select("page_id", "level", F.col("text").alias("heading"), F.col("id").alias("anchor_id"))


@query(_values(["'ol', 0, 'one'", "'ol', 1, 'two ' || i"], "kind pos item"))
def lists_items(spark, sf_dir):
    rows = _rich(spark, sf_dir).select("page_id", F.inline("elements.lists"))
    return rows.select("page_id", F.col("type").alias("kind"), F.posexplode("items").alias("pos", "item"))


@query(_values(["lang, 'run(' || i || ')' || chr(10)", "'', 'plain ' || i"], "language code"))
def code_blocks(spark, sf_dir):
    return _rich(spark, sf_dir).select("page_id", F.inline("elements.code_blocks")).select("page_id", "language", "code")


@query(_values(["0, 'key', 'lang'", "0, 'value', lang", "1, 'key', 'id'", "1, 'value', i"], "row_ix header cell"))
def tables(spark, sf_dir):
    rows = _rich(spark, sf_dir).select("page_id", F.inline("elements.tables"))
    rows = rows.select("page_id", "headers", F.posexplode("rows").alias("row_ix", "cells"))
    return rows.select("page_id", "row_ix", F.inline(F.arrays_zip(F.col("headers").alias("header"), F.col("cells").alias("cell"))))


@query(_values(["'/img/' || i || '.png', source, ''"], "src alt title"))
def images(spark, sf_dir):
    return _rich(spark, sf_dir).select("page_id", F.inline("elements.images"))


_GENERIC = [
    "site || '/docs/' || i, 'Overview ' || i, 'navigation', 1.0::DOUBLE, 2", "site || '/docs/' || n, 'Part' || n, 'navigation', 1.0::DOUBLE, 2",
    "site || '/docs/guide/' || i, 'guide ' || i, 'content', 11.0::DOUBLE, 3", "site || '/docs/' || n || '?v=2', 'Next page', 'pagination_next', 5.0::DOUBLE, 2",
    "site || '/docs/p' || i, '← ' || i, 'pagination_previous', 8.0::DOUBLE, 2", "site || '/feedback/' || i, 'Send feedback', 'pagination_previous', 8.0::DOUBLE, 2",
]


@query(_values(_GENERIC, "url text type priority depth"))
def generic_rich_links(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "url", "text", "type", "priority", "depth")


@query(_values(_GENERIC[3:], "url text type priority depth"))
def pagination_links(spark, sf_dir):
    return _links(spark, sf_dir).filter("type LIKE 'pagination%'").select("page_id", "url", "text", "type", "priority", "depth")


@query("SELECT doc_id AS page_id, 2::BIGINT AS navigation, 1::BIGINT AS content, 1::BIGINT AS pagination_next, 2::BIGINT AS pagination_previous FROM documents WHERE doc_id IS NOT NULL")
def link_type_counts(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("page_id").pivot("type", ["navigation", "content", "pagination_next", "pagination_previous"]).agg(F.count(F.lit(1)))


@query(
    f"WITH {_D} SELECT page_id, 'Doc' || i AS title, 'selector:main.content-wrapper' AS extraction_method, 2 AS code_block_count, 1 AS api_section_count FROM u"
)
def wiki_content(spark, sf_dir):
    m = lambda k: F.col("metadata")[k].cast("int").alias(k)
    return _rich(spark, sf_dir, "wiki").select("page_id", "title", "extraction_method", m("code_block_count"), m("api_section_count"))


@query(_values(["lang, 'run(' || i || ')' || chr(10), 'pre_code'", "lang, 'mark ' || i, 'div_code'"], "language code origin"))
def wiki_code_blocks(spark, sf_dir):
    return _rich(spark, sf_dir, "wiki").select("page_id", F.inline("elements.code_blocks")).select("page_id", "language", "code", F.col("source").alias("origin"))


@query(_values(["'API Reference ' || i, 2, '<p>call_' || i || '</p><h3>Detail</h3><hr/><p>more</p>'"], "title level content"))
def wiki_sections(spark, sf_dir):
    return _rich(spark, sf_dir, "wiki").select("page_id", F.inline("api_sections"))


_ACTIVE = "CASE WHEN page_id % 2 = 0 THEN 13.0 ELSE 10.0 END::DOUBLE"


@query(
    _values(
        [
            f"site || '/docs/' || i, 'Overview ' || i, 'navigation', {_ACTIVE}, 0, false, 1", "site || '/blog/' || i, 'Blog', 'navigation', 8.0::DOUBLE, 0, false, 2",
            "site || '/docs/' || n, 'Part' || n, 'navigation', 7.0::DOUBLE, 1, false, 3", "site || '/docs/guide/' || i, 'guide ' || i, 'content', 3.0::DOUBLE, 0, false, 4",
            "'https://other.example.net/wiki/' || lang, 'wiki', 'content', 3.0::DOUBLE, 0, true, 5",
        ],
        "url text source_type priority depth is_external rank",
    )
)
def wiki_link_order(spark, sf_dir):
    """The wiki link strategy: three groups, merged by priority, documentation only, in order."""
    rows = _links(spark, sf_dir, "wiki")
    return rows.select("page_id", "url", "text", "source_type", "priority", "depth", F.coalesce("is_external", F.lit(False)).alias("is_external"), "rank")


@query(
    "WITH l AS (SELECT doc_id, 0 AS g, (doc_id % 5 + 1)::DOUBLE AS p, 'navigation' AS t FROM documents UNION ALL SELECT doc_id, 1, (doc_id % 3 + 2)::DOUBLE, 'content' FROM documents UNION ALL SELECT doc_id, 2, (doc_id % 7)::DOUBLE, 'related' FROM documents), "
    "b AS (SELECT *, max(p) OVER (PARTITION BY doc_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l) "
    "SELECT doc_id AS page_id, max(p) AS priority, string_agg(t, ',' ORDER BY g DESC) AS source_type, arg_max(t, g) AS type FROM b WHERE before IS NULL OR p > before GROUP BY 1"
)
def wiki_link_merge(spark, sf_dir):
    """One URL per page found by all three groups with priorities that differ by page."""
    from pagequarry.operators import links

    i = F.col("doc_id")
    groups = F.array(
        F.struct(F.lit(0).alias("group_ix"), (i % 5 + 1).cast("double").alias("priority"), F.lit("navigation").alias("type"), F.lit(0).alias("seq")),
        F.struct(F.lit(1).alias("group_ix"), (i % 3 + 2).cast("double").alias("priority"), F.lit("content").alias("type"), F.lit(1).alias("seq")),
        F.struct(F.lit(2).alias("group_ix"), (i % 7).cast("double").alias("priority"), F.lit("related").alias("type"), F.lit(2).alias("seq")),
    )
    rows = read(spark, sf_dir, "documents").select(i.alias("page_id"), F.lit("https://x.example/").alias("url"), F.inline(groups))
    return links.merge_wiki(rows).select("page_id", "priority", "source_type", "type")


@query()
def html_to_markdown(spark, sf_dir):
    """Markdown of the extracted content (no SQL: it is emitted from the tree)."""
    return page_pass.page_markdown(derived.rich_pages(read(spark, sf_dir, "documents")))


@query()
def json_export_rows(spark, sf_dir):
    """The JSON file of every page, as rows."""
    from pagequarry.operators import export

    rows = _pages(spark, sf_dir).select(F.col("page_id").alias("seq"), "url", "title", "content", F.lit(0).alias("depth"), "metadata", "elements")
    return export.json_pages(rows, "site").select("file_name", "url", "page_number", F.length("text").cast("long").alias("n_chars"))
