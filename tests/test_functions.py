"""Truth tables of the column functions."""

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import text, urls
from pagequarry.operators import relevance

TRUE_PATHS = ["/docs/api", "/documentation/guide", "/manual/intro", "/guide/getting-started", "/api/v1/endpoints", "/help/faq", "/reference/methods", "/v2/api-reference", "/learn/tutorial", "/examples/code.html", "/how-to/deploy"]
FALSE_PATHS = ["/blog/new-features", "/download/latest", "/about-us", "/contact", "/profile", "/login", "/signup", "/img/logo.png", "/video/demo.mp4", "/twitter", "/?utm_source=google"]


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i").select(column).collect()]


def test_likely_documentation(spark):
    rows = [(f"https://example.com{p}",) for p in TRUE_PATHS + FALSE_PATHS]
    assert values(spark, urls.likely_documentation("u"), rows, "u string") == [True] * len(TRUE_PATHS) + [False] * len(FALSE_PATHS)


def test_likely_documentation_in_any_case(spark):
    rows = [("https://x.org/Docs/A",), ("https://x.org/a/LOGIN",), ("https://x.org/README.MD",), ("https://x.org/a/b.PNG",)]
    assert values(spark, urls.likely_documentation("u"), rows, "u string") == [True, False, True, False]


def test_same_site(spark):
    base = "https://docs.example.com"
    rows = [("https://docs.example.com/a", base), ("https://api.example.com/b", base), ("https://otherdomain.com", base), ("https://example.org", base)]
    assert values(spark, urls.same_site("u", "b"), rows, "u string, b string") == [True, True, False, False]


@pytest.mark.parametrize(
    ("function", "rows", "expected"),
    [
        (text.sanitized_filename, ["file:with?invalid*chars", "  trim spaces  ", "", "a" * 200], ["file_with_invalid_chars", "trim spaces", "untitled", "a" * 100]),
        (text.sanitized_filename, ["\n Title \n", "\t\r\n", "a\tb"], ["Title", "untitled", "a\tb"]),
        (text.clean_title, ["\n A \n | B", "\tA\n"], ["A", "A"]),
        (text.stripped_text, ["\n<p>\t a </p>\n"], ["a"]),
        (text.looks_like_html, ["\n<div>a</div>", " \t<p>a</p>", "a<p></p>", "<p>"], [True, True, False, False]),
        (text.anchor, ["Test Heading", "Test & Heading!", "ALL CAPS", "Über uns"], ["test-heading", "test-heading", "all-caps", "über-uns"]),
        (text.token_estimate, ["", "abcd", "abcdefg"], [0, 1, 1]),
        (text.clean_title, ["A | B - C", "A - B", "plain"], ["A", "A", "plain"]),
        (text.without_suffix, ["Intro - DeepWiki", "Intro | Documentation", "Intro"], ["Intro", "Intro", "Intro"]),
        (urls.title_from_url, ["https://www.x.org/a/getting-started_now/", "https://docs.x.org/"], ["Getting Started Now", "Docs"]),
        (urls.project_name, ["https://www.python.org/a", "https://docs.x.org"], ["Python", "Docs"]),
        (urls.path_depth, ["https://x.org", "https://x.org/", "https://x.org/a/b/"], [0, 0, 2]),
        (urls.with_scheme, ["x.org/a", "http://x.org"], ["https://x.org/a", "http://x.org"]),
        (text.class_language, ["x language-python", "lang-c", "plain"], ["python", "c", ""]),
    ],
)
def test_scalars(spark, function, rows, expected):
    assert values(spark, function("x"), [(r,) for r in rows], "x string") == expected


def test_page_number_keeps_long_numbers(spark):
    assert values(spark, text.page_number("n"), [(1,), (999,), (12345,)], "n int") == ["001", "999", "12345"]


def test_cache_keys(spark):
    long = "a" * 100 + "m" * 50 + "z" * 100
    assert values(spark, text.content_cache_key("x", F.lit("clean")), [(long,), ("ab",)], "x string") == ["a" * 100 + "z" * 100 + "clean250", "ababclean2"]


def test_should_follow(spark):
    base = "https://x.org/docs/a"
    rows = [("https://x.org/docs/b", base, "b"), ("https://y.org/docs/b", base, "b"), ("https://x.org/a.pdf", base, "a"), ("https://x.org/b", base, "Sign In"), ("https://x.org#a", base, "a"), ("https://x.org/a?q=1", base, "a"), ("https://x.org/a?rev=1", base, "a")]
    assert values(spark, urls.should_follow("u", "b", "t"), rows, "u string, b string, t string") == [True, False, False, False, False, False, True]


def test_join(spark):
    rows = [("https://x.org/a/b", "../c"), ("https://x.org/a/b", "/c?d#e"), ("https://x.org/a", "https://y.org/z"), (None, "/a")]
    assert values(spark, urls.join("b", "h"), rows, "b string, h string") == ["https://x.org/c", "https://x.org/c?d#e", "https://y.org/z", None]


def test_link_text(spark):
    html = '<p><a class="x" href="/docs/api">API <b>Reference</b></a></p>'
    rows = [(html, "/docs/api"), (html, "/non-existent")]
    assert values(spark, relevance.link_text("h", F.col("u")), rows, "h string, u string") == ["API Reference", ""]


def test_link_text_is_stripped(spark):
    assert values(spark, relevance.link_text("h", F.col("u")), [("<a href='/a'>\n\tA <b>b</b>\n</a>", "/a")], "h string, u string") == ["A b"]


def test_context_and_sample(spark):
    page = "x" * 150 + "the link" + "y" * 150
    assert values(spark, relevance.context_of("c", "t"), [(page, "the link"), (page, "none"), (page, ""), ("the link", "the link")], "c string, t string") == ["x" * 100 + "the link" + "y" * 100, None, None, "the link"]
    assert values(spark, relevance.content_sample("c", 10), [("a" * 10,), ("a" * 11,)], "c string") == ["a" * 10, "a" * 10 + "..."]


def test_wiki_should_follow(spark):
    base = "https://x.org/docs/a"
    rows = [("https://x.org/docs/b", base, "b"), ("https://x.org/docs/b/edit/1", base, "b"), ("https://y.org/docs/b", base, "b"), ("/docs/c", base, "c"), ("https://x.org#top", base, "t"), ("https://x.org#top", "https://x.org", "t")]
    assert values(spark, urls.wiki_should_follow("u", "b", "t"), rows, "u string, b string, t string") == [True, False, False, True, True, False]


def test_expressions_and_tree_helpers_agree(spark):
    """What the DOM pass says in Python is said in expressions elsewhere: both must say the same."""
    from pagequarry.operators import content, links

    cases = ["https://x.org", "https://x.org/", "https://x.org/a/b/", "https://docs.x.org/a/getting-started_now", "https://x.org/docs/b.md?x#y", "https://y.org/wiki/A", "https://x.org/edit/1", "https://x.org/search?q"]
    rows, base = [(u,) for u in cases], "https://x.org/docs/"
    assert values(spark, urls.path_depth("u"), rows, "u string") == [links.path_depth(u) for u in cases]
    assert values(spark, urls.title_from_url("u"), rows, "u string") == [content.title_from_url(u) for u in cases]
    assert values(spark, urls.looks_like_doc("u", F.lit("Guide"), F.lit(base)), rows, "u string") == [links.looks_like_doc(u, "Guide", base) for u in cases]
    assert values(spark, urls.looks_like_doc("u", F.lit("x"), F.lit(base)), rows, "u string") == [links.looks_like_doc(u, "x", base) for u in cases]
    for classes in ("language-python", "x lang-c", "plain", "language-a-b"):
        assert values(spark, text.class_language("c"), [(classes,)], "c string") == [content.class_language(classes.split()) or ""]
    points = [("Overview", "/a", d, a, h) for d in range(4) for a in (True, False) for h in (True, False)] + [("Legacy", "/INDEX", 1, False, False)]
    found = values(spark, urls.wiki_link_priority("t", "h", "d", "a", "k"), points, "t string, h string, d int, a boolean, k boolean")
    assert found == [links.wiki_priority(*p) for p in points]


def test_glob_filter(spark):
    rows = [("https://x.org/docs/a",), ("https://x.org/docs/private/a",), ("https://x.org/blog",)]
    assert values(spark, urls.glob_filter("u", ["*/docs/*"], ["*private*"]), rows, "u string") == [True, False, False]


def test_markdown_postprocess(spark):
    rows = [("a\n\n\n\nb",), ("##Title",), ("* a\nb",)]
    assert values(spark, text.markdown_postprocessed("x"), rows, "x string")[:2] == ["a\n\nb", "## Title"]
