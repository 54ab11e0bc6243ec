"""Steps whose cost grew with more than their rows: evidence in pages, calls in flight, the page pass."""

import random
import re
from urllib.parse import urljoin, urlparse

from pagequarry.operators import control, dom, enrich, links, pages
from pagequarry.operators.markdown import markdown
from pagequarry.plans import rich, running
from pagequarry.sources import cache, derived

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_mark_of_a_framework_is_looked_for_once(spark):
    df = spark.createDataFrame([(1, "x")], "k long, html string").select(control.framework_evidence().alias("e")).select("e.framework", "e.confidence", "e.indicators")
    for _, mark, _, _ in control.FRAMEWORK_SIGNS:
        assert len(re.findall(r"RLIKE\([^,]*, " + re.escape(mark) + r"\)", plan(df))) == 1


def test_calls_in_flight_give_out_groups_and_not_frames_of_one_row(spark):
    rows = spark.createDataFrame([(k, f"c{k}") for k in range(100)], "k long, content string").coalesce(1)
    known = spark.createDataFrame([(f"c{k}c{k}clean{1 + len(str(k))}", "known") for k in range(0, 100, 3)], cache.CONTENT_CACHE)

    def model(contents, mode, kind):
        if "c50" in contents:
            raise ValueError("refused")
        return [f"{len(contents)} {c}" for c in contents]

    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for size, options in ((1, {}), (5, {}), (1, {"cache": known}), (5, {"cache": known})):
            df = enrich.process(rows, model, batch_size=size, at_once=4, **options)
            assert "MapInArrow" in plan(df)
            got = {r["k"]: r for r in df.collect()}
            assert sorted(got) == list(range(100))
            for k, r in got.items():
                if options and k % 3 == 0:
                    assert (r["result"], r["processed"], r["cached"], r["error"]) == ("known", True, True, None)
                elif r["processed"]:
                    assert r["result"].split()[1] == f"c{k}" and not r["cached"] and r["error"] is None
                else:
                    assert (r["result"], r["error"]) == (f"c{k}", "refused")
            assert not got[50]["processed"] and sum(not r["processed"] for r in got.values()) <= size
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def shape(tree):
    """Tags, attributes, places and texts of a tree, in document order."""
    out, stack = [], [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, dom.Element):
            out.append((node.tag, tuple(node.attrs.items()), node.at, node.end))
            stack.extend(reversed(node.children))
        else:
            out.append((type(node).__name__, str(node)))
    return out


def test_plain_markup_is_read_by_pattern_as_the_tag_parser_reads_it():
    odd = ["a < b", "<p a=b>x", "<p a='b'>x", "<![CDATA[x]]>", "<a b", "</ p>", "<script>a</script b>", "<title>a<b>c</title>", "<script/>x", "<!-->x-->", "<!--a--b-->"]
    plain = [
        derived.RICH, "", "a &amp b &copy; &#65;", '<P CLASS=" a">x</P></i><br/><br />y', '<p a="1" A="2&lt;" hidden>x', "<script>if (a < b) '<p>'</script>z",
        "<title>t</title><!-- a-b > c --><!DOCTYPE html>", "<ul><li>a<li>b</ul>c</li>", "<style></style><textarea>x</textarea>",
    ]
    for html in plain + odd:
        assert shape(dom.parse(html)) == shape(dom.parsed_by_tags(html))
    assert all(dom._plain(html) is not None for html in plain) and all(dom._plain(html) is None for html in odd)


def test_markdown_of_rich_pages_takes_one_python_pass(spark):
    df = rich.html_to_markdown(spark, SF)
    assert plan(df).count("MapInArrow") == 1 and "ArrowEvalPython" not in plan(df) and "emit(" not in plan(df)
    pages_of = derived.rich_pages(spark.createDataFrame([(1, "en", "web"), (2, None, None)], "doc_id long, lang string, source string"))
    one = {r["page_id"]: r["markdown"] for r in pages.page_markdown(pages_of).collect()}
    two = {r["page_id"]: r["m"] for r in pages.extract(pages_of, with_links=False).select("page_id", markdown("content").alias("m")).collect()}
    assert one == two and len(one) == 2
    none = spark.createDataFrame([(7, "u", None), (8, None, "")], "page_id long, url string, html string")
    assert {(r["page_id"], r["markdown"]) for r in pages.page_markdown(none).collect()} == {(7, ""), (8, "")}


def test_markdown_of_varied_pages_takes_one_python_worker(spark):
    found = plan(running.varied_markdown(spark, SF))
    assert found.count("MapInArrow") == 1 and "ArrowEvalPython" not in found and "emit(" not in found


def test_links_under_absent_ancestors_are_not_looked_at(monkeypatch):
    tree, looked = dom.parse("<main><a href='x'>x</a></main>" + "<a href='y'>y</a>" * 50), []
    holds = dom._holds
    monkeypatch.setattr(dom, "_holds", lambda node, row: looked.append(node) or holds(node, row))
    assert dom.select(tree, "article a") == [] and dom.select_one(tree, ".content a") is None and not looked
    assert [a.get("href") for a in dom.select(tree, "article a,main a")] == ["x"] and len(looked) == 51
    assert dom.select(tree, "[data-x] a") == [] and len(looked) == 102


def test_pagination_links_of_rich_pages_need_no_tag_parser(monkeypatch):
    html = derived.RICH.replace("{id}", "5").replace("{next}", "6").replace("{lang}", "en").replace("{source}", "web")
    by_tags = links.generic(dom.parsed_by_tags(html), "https://web.example.org/docs/5")

    def unused(html):
        raise AssertionError("not plain")

    monkeypatch.setattr(dom, "parsed_by_tags", unused)
    found = links.generic(dom.parse(html), "https://web.example.org/docs/5")
    assert found == by_tags and [r["text"] for r in found if r["type"].startswith("pagination")] == ["Next page", "← 5", "Send feedback"]


def test_a_page_gives_out_each_url_once_and_resolves_plain_references_itself(monkeypatch):
    html = derived.RICH.replace("{id}", "5").replace("{next}", "6").replace("{lang}", "en").replace("{source}", "web")
    joined, resolve = [], links._joined
    monkeypatch.setattr(links, "_joined", lambda base, href: joined.append(href) or resolve(base, href))
    found = links.generic(dom.parse(html), "https://web.example.org/docs/5")
    urls = [r["url"] for r in found]
    assert len(urls) == len(set(urls)) == 8 and urls[0] == "https://web.example.org/docs/5" and found[0]["text"] == "Overview 5" and len(joined) == 2


def test_references_are_resolved_as_the_library_resolves_them():
    bases = [
        "https://h.example/docs/5", "http://h.example", "https://h.example/a/../b/./c?x=1#f", "HTTPS://H.example:8080//a//b/", "file:///a/b", "mailto:x@y", "", "docs/5", "/a/b;p/c;q",
        "https:", "//h/a/b", "https://[bad/x", "https://h/a/b/../..", "?q", "x:y/z",
    ]
    parts = ["", "/", "//", "a", "b.c", ".", "..", ".a", "a:b", ";p", "?x=1", "?", "#", "#f", "?a/../b", "é", "%20", " ", "[", "https://", "http:", "https://g.example", "HTTP://G", "https://g:80", "-", "~"]
    for base in bases:
        for href in {a + b + c + d for a in parts for b in ("", "/", "a", "?x", "..") for c in ("", "/", "b", "//", "/./") for d in ("", "#f", "?", "/")}:
            try:
                want = urljoin(base, href)
            except ValueError:
                want = None
            assert links._Out(base).url(href) == want, (base, href)
            if want and "[" not in want:
                path = urlparse(want).path.strip("/")
                assert links.path_depth(want) == (path.count("/") + 1 if path else 0)


def test_attribute_selectors_look_at_nodes_with_the_attribute(monkeypatch):
    looked, holds = [], dom._holds
    monkeypatch.setattr(dom, "_holds", lambda node, row: looked.append(node) or holds(node, row))
    tree = dom.parse("<p>x</p>" * 50 + '<p role="other"></p><p role="navigation" title="">y</p>')
    assert [n.stripped() for n in dom.select(tree, "[role='navigation']")] == ["y"] and len(looked) == 2
    assert len(dom.select(tree, "[role^='n']")) == len(dom.select(tree, "[title]")) == len(dom.select(tree, "[title='']")) == 1


def test_random_markup_gives_the_tree_of_the_tag_parser():
    rng = random.Random(5)
    pieces = [
        "<p>", "</p>", "<B class=\" a  b\" id='x'>", "<b class=\" a  b\" rel>", "</b>", "text", " & &amp; &copy", "<br>", "<br/>", "<i/>", "<!-- c -->", "<!DOCTYPE html>", "<script>", "</script>",
        "<script>a<b</script>", "<title>t</title>", "<title>a&amp;</title>", "<style>x</style>", "<", ">", "\n", '<a href="?a&amp;b&c" HREF="2">', "</a>", "<plaintext>", "<textarea>", "</textarea>",
    ]
    plain = 0
    for _ in range(3000):
        html = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 9)))
        plain += dom._plain(html) is not None
        assert shape(dom.parse(html)) == shape(dom.parsed_by_tags(html)), html
    assert plain > 300
