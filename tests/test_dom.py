"""The DOM kernel and both content strategies on hand-computed pages."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.operators import content, dom, links
from pagequarry.operators.markdown import to_markdown


def test_unclosed_elements_nest_and_stray_ends_are_ignored():
    tree = dom.parse("<div><p>a<p>b</div></span>c")
    div = tree.find("div")
    assert div.markup() == "<div><p>a<p>b</p></p></div>"
    assert tree.stripped() == "abc"


def test_text_leaves_out_comments_and_scripts():
    tree = dom.parse("<div> <b> a </b> b <!-- no --><script>no</script><i>c</i></div>")
    assert tree.find("div").stripped() == "abc"


@pytest.mark.parametrize(
    ("selector", "ids"),
    [("div", "ac"), (".x", "ab"), ("#b", "b"), ("div .x", "b"), ("[role='nav']", "c"), ("[data^='ab']", "c"), ("p:first-of-type", "b"), ("div.x,p.y", "ad")],
)
def test_selectors(selector, ids):
    tree = dom.parse("<div id=a class='x z'><p id=b class=x></p><p id=d class=y></p></div><div id=c role=nav data=abc></div>")
    assert "".join(n.get("id") for n in dom.select(tree, selector)) == ids


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/abp \"'=&;!-[", max_size=80))
def test_any_markup_parses_and_serialises(html):
    once = dom.parse(html).markup()
    assert dom.parse(html).stripped() is not None and once.startswith("<[document]>")


def test_generic_title_falls_back():
    assert content.generic_title(dom.parse("<title>A | B</title>")) == "A"
    assert content.generic_title(dom.parse("<title>A - B</title>")) == "A"
    assert content.generic_title(dom.parse("<p>x</p>")) == "Untitled Document"


def test_metadata_precedence():
    page = dom.parse('<meta property="og:title" content="o"><meta name="title" content="n"><meta property="og:x" content=""><link rel="canonical" href="/c">')
    assert content.metadata(page) == {"title": "n", "canonical_url": "/c"}


def test_generic_scoring_prefers_dense_divs_and_the_first_of_equals():
    page = dom.parse("<body><div class='menu'><p>1</p><p>2</p><p>3</p></div><div id=a><p>x</p></div><div id=b><p>y</p></div></body>")
    node, method = content.generic_node(page)
    assert (node.get("id"), method) == ("a", "content_scoring")


def test_generic_clean_wraps_bare_pre_and_scrubs_attributes():
    page = dom.parse("<article><pre>x</pre><p></p><p onclick=1 data-lang=c data-z=1>t</p><nav>n</nav></article>")
    out = content.generic(page)
    assert out["content"] == '<article><pre><code>x</code></pre><p data-lang="c">t</p></article>'
    assert out["elements"]["code_blocks"] == [{"language": "", "code": "x", "source": "pre"}]


def test_empty_and_missing_content_are_error_rows():
    assert content.generic(None)["error"] == "Empty HTML provided"
    assert content.generic(dom.parse("text"))["error"] == "Could not find content container"
    assert content.wiki(None, "https://x.org/a-b")["title"] == "A B"


def test_wiki_sections_are_copied_and_rules_end_them():
    page = dom.parse("<main>" + "x" * 120 + "<h2>API Reference</h2><p>a</p><hr><h3>s</h3><h2>End</h2></main>")
    out = content.wiki(page, "https://x.org/a")
    assert out["api_sections"] == [{"title": "API Reference", "level": 2, "content": "<p>a</p><hr/><h3>s</h3>"}]
    assert "API Reference" in out["content"]


def test_wiki_admonitions_get_a_prefix():
    page = dom.parse("<main>" + "x" * 120 + "<div class='note'>mind</div></main>")
    assert "<strong>Note: </strong>mind" in content.wiki(page, "https://x.org/a")["content"]


def test_pagination_words_match_inside_words():
    assert links.pagination_kind("Send feedback", "", [], []) == "pagination_previous"
    assert links.pagination_kind("Next page", "", [], []) == "pagination_next"
    assert links.pagination_kind("", "", ["nav-prev"], []) == "pagination_previous"
    assert links.pagination_kind("x", "", [], []) is None


def test_markdown():
    html = "<h1>T</h1><p><strong>b</strong> and <em>i</em> <a href='https://example.com'>link</a></p><ul><li>Item 1</li><li>Item 2</li></ul><pre><code class='language-python'>print(1)</code></pre>"
    out = to_markdown(html)
    for piece in ("# T", "**b**", "*i*", "[link](https://example.com)", "* Item 1", "```python\nprint(1)\n```"):
        assert piece in out
    assert "[link]" not in to_markdown(html, links=False)
