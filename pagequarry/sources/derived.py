"""Tables that Spark derives from the given ones, for operators whose cases those lack.

``rich_pages`` makes of each document a documentation page with metadata, headings, lists, code,
tables, images, navigation and pagination; ``page_edges`` makes of the pages a link graph with cycles and repeated edges.
Both grow with their inputs and are functions of ids and plain columns, so SQL can state the expected results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _s(x):
    return F.col(x).cast("string") if isinstance(x, str) else F.lit(x) if not hasattr(x, "cast") else x.cast("string")


def _text(template: str, **values) -> F.Column:
    """A template whose {names} are columns."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if k % 2 == 0 else values[p] for k, p in enumerate(parts)])


RICH = """<!DOCTYPE html><html lang="{lang}"><head><title>Doc {id} | {source}</title><meta charset="utf-8"><meta property="og:title" content="Og {id}"><meta property="og:lang" content="{lang}"><meta name="title" content="Named {id}"><meta name="last-modified" content="2024-01-{day}"><meta name="empty" content=""><link rel="canonical" href="https://{source}.example.org/docs/{id}"><script>var a = "<p>no</p>";</script></head><body><nav class="sidebar"><ul><li class="{active}"><a href="/docs/{id}">Overview {id}</a><ul><li><a href="/docs/{next}">Part <b>{next}</b></a></li></ul></li><li><a href="/blog/{id}">Blog</a></li><li><a href="/docs/{id}">Again</a></li><li><a href="#">Top</a></li><li><a href="javascript:void(0)">Script</a></li></ul></nav><main class="content-wrapper"><!-- c{id} --><h1>Doc <i>{id}</i></h1><p onclick="x()" data-x="1">Text of {source} with <a href="guide/{id}">guide {id}</a> and <a href="https://other.example.net/wiki/{lang}">wiki</a>, long enough that the wiki strategy takes this element for the content of the page.</p><p></p><h2 id="use-{id}">Usage</h2><ol><li>one</li><li>two {id}</li></ol><pre><code class="language-{lang}">run({id})
</code></pre><pre>plain {id}</pre><div class="highlight" data-lang="{lang}">mark {id}</div><table><thead><tr><th>key</th><th>value</th></tr></thead><tbody><tr><td>lang</td><td>{lang}</td></tr><tr></tr><tr><td>id</td><td>{id}</td></tr></tbody></table><img src="/img/{id}.png" alt="{source}"><div class="note">Mind {id}</div><h2>API Reference {id}</h2><p>call_{id}</p><h3>Detail</h3><hr><p>more</p><h2>End</h2><p>last</p></main><div class="see-also"><h4>See also</h4><a href="/docs/{next}">Related {next}</a></div><a class="next" href="/docs/{next}?v=2">Next page</a><a rel="prev" href="/docs/p{id}">&larr; {id}</a><a href="/feedback/{id}">Send feedback</a><a href="/files/{id}.pdf">download</a><footer>&copy; {source}</footer></body></html>"""


def rich_pages(documents: DataFrame) -> DataFrame:
    """page_id, url, html: a documentation page for each document."""
    i = F.col("doc_id").cast("string")
    values = {
        "id": i,
        "next": (F.col("doc_id") + 1).cast("string"),
        "lang": F.coalesce("lang", F.lit("xx")),
        "source": F.coalesce("source", F.lit("none")),
        "day": F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"),
        "active": F.when(F.col("doc_id") % 2 == 0, "active").otherwise("item"),
    }
    url = F.concat(F.lit("https://"), values["source"], F.lit(".example.org/docs/"), i)
    return documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("page_id"), url.alias("url"), _text(RICH, **values).alias("html"))


def varied_pages(documents: DataFrame) -> DataFrame:
    """page_id, url, html: a page for each document, of its own words, with parts that depend on its id.

    The container is an article, a div of content, a div without a known name, or none; lists, code, attributes, related sections,
    links and framework marks come and go.  Words are runs of letters a-z and A-Z, so that markup needs no escapes.
    """
    i, k = F.col("doc_id").cast("string"), F.col("doc_id")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[^a-zA-Z]+", -1), lambda w: w != "")
    head, body = F.coalesce(F.get(words, F.lit(0)), F.lit("none")), F.array_join(words, " ")
    extra, box = k % 5, k % 4
    related = _text('<section class="related-links"><h3>More</h3><a href="/docs/r{i}">Related {i}</a></section>', i=i)
    inner = F.concat(
        _text("<h1>{head}</h1><p>{body}</p><p>{fill}</p>", head=head, body=body, fill=F.lit("filling words of the page " * 9 + "filling words of the page")),
        F.when(extra == 0, _text("<ul><li>one<ul><li>deep {i}</li></ul></li><li>two</li></ul>", i=i)).otherwise(""),
        F.when(extra == 1, _text("<pre>bare {i}</pre>", i=i)).when(extra == 2, _text('<pre><code class="lang-sql">set {i}</code></pre>', i=i)).otherwise(""),
        F.when(extra == 3, F.lit('<p onclick="x()" data-lang="en" data-x="1">kept</p>')).otherwise(""),
        F.lit('<p></p><div class="ads">Buy</div><script>x()</script>'),
    )
    # Admonitions, edit links and the like, where the wiki strategy takes the article; the generic one takes them out as noise.
    wiki = _text(
        '<div class="admonition"><div class="note">Mind {i}</div><div class="plain-box">plain {i}</div><div class="deepwiki-sidebar">s</div><a class="edit-page" href="/e">Edit</a>'
        '<a href="https://github.com/x">Source</a><!-- c --><div class="toc-wrapper">t</div></div>', i=i)  # fmt: skip
    whole = (
        F.when(box == 0, F.concat(F.lit("<article>"), inner, wiki, F.lit("</article>")))
        .when(box == 1, F.concat(F.lit('<div class="content">'), inner, F.lit("</div>")))
        .when(box == 2, F.concat(F.lit('<div class="page">'), inner, F.lit("</div>")))
        .otherwise(inner)
    )
    mark = F.when(k % 9 == 0, "MkDocs 1").when(k % 9 == 1, "Docusaurus").when(k % 9 == 2, "sphinx 7").when(k % 9 == 3, "Hugo 0").otherwise("none")
    first = F.when(k % 3 == 0, F.concat(F.lit("/Docs/"), i)).when(k % 3 == 1, "/a/LOGIN").otherwise(F.concat(F.lit("/p"), i))
    nav = _text('<nav><a href="{first}">A</a><a href="/guide/{i}">B</a><a href="{first}">C</a><a href="#">D</a></nav>', first=first, i=i)
    html = F.concat(
        _text('<html><head><meta name="generator" content="{mark}"></head><body>', mark=mark), nav, whole, F.when(extra == 4, related).otherwise(""), F.lit("</body></html>")
    )
    url = F.concat(F.lit("https://s"), (k % 7).cast("string"), F.lit(".example.org/docs/"), i)
    return documents.filter("doc_id IS NOT NULL").select(k.alias("page_id"), url.alias("url"), html.alias("html"))


def site_pages(pages: DataFrame) -> DataFrame:
    """url, html, status: a site of four hosts whose pages link to each other; one page in eleven is missing.

    Page p is page p div 4 of host p mod 4; page i of a host points to 2i + 1, 2i + 2 and i div 3, and to a style sheet.
    """
    p = F.col("page_id")
    i = F.floor(p / 4).cast("long")
    path = lambda k: F.concat(F.lit("/p"), k.cast("string"))
    nav = _text('<nav><a href="{a}">A</a><a href="{b}">B</a><a href="{c}">C</a><a href="{a}">A</a><a href="/style.css">S</a></nav>', a=path(2 * i + 1), b=path(2 * i + 2), c=path(F.floor(i / 3).cast("long")))
    html = F.concat(F.lit("<html><body>"), nav, _text("<article><h1>Page {p}</h1><p>Words of page {p}.</p></article></body></html>", p=p.cast("string")))
    url = F.concat(F.lit("https://h"), (p % 4).cast("string"), F.lit(".example.org"), path(i))
    return pages.select(url.alias("url"), html.alias("html"), F.when(p % 11 == 10, 404).otherwise(200).alias("status"))


def page_edges(pages: DataFrame) -> DataFrame:
    """src, dst, link_seq: a binary tree over page ids with a back edge and a repeated one for each page.

    Page p points to 2p + 1 and 2p + 2, back to p div 3, and again to 2p + 1.
    """
    p = F.col("page_id")
    targets = F.array(2 * p + 1, 2 * p + 2, F.floor(p / 3).cast("long"), 2 * p + 1)
    out = pages.select(p.alias("src"), F.posexplode(targets).alias("link_seq", "dst"))
    return out.join(pages.select(p.alias("dst")), "dst", "left_semi").select("src", "dst", "link_seq")
