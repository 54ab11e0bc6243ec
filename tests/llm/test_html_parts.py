"""Parts of a page inside and beside its article, of any length; articles that have such parts' names."""

import pytest

from pagequarry.llm import html_main

TEXT = "A sentence of the article, with commas, and long enough to count for something. " * 2
SIDE = "Here is a sentence of the side part, with commas. And one more of it, likewise. A third one ends it, at last."
ARTICLE = "".join(f"<p>{TEXT}{k}</p>" for k in range(12))
WANTED = "\n\n".join(f"{TEXT}{k}" for k in range(12))
BOXES = [
    "<div class=sidebar>%s</div>", "<div class='cookie-notice'>%s</div>", "<div class=notice>%s</div>", "<div class='newsletter-signup'>%s</div>", "<div class='ad-slot'>%s</div>",
    "<div id=comments><h2>Comments</h2>%s</div>", "<div class=comments>%s</div>", "<section class=comments><h3>3 comments</h3>%s</section>", "<ol class='comment-list'><li><article class='comment-body'>%s</article></ol>",
    "<section id=comments><h2>Comments</h2><div class=comment>%s</div></section>", "<aside>%s</aside>", "<div id=disqus_thread>%s</div>",
]
PLACES = ["<body><article>{a}{b}</article></body>", "<body><main>{b}{a}</main></body>", "<body><div class=wrap><article>{a}</article>{b}</div></body>", "<body><div class=content>{a}{b}</div></body>", "<body>{b}<div><div class=post>{a}</div></div></body>"]


@pytest.mark.parametrize("place", range(len(PLACES)))
@pytest.mark.parametrize("length", [1, 3, 60])
def test_parts_go_whatever_their_length(place, length):
    side = f"<p>{SIDE}</p>" * length
    for box in BOXES:
        assert html_main.main_text(PLACES[place].format(a=ARTICLE, b=box % side)) == WANTED, box


def test_a_short_article_with_a_long_thread():
    thread = f"<p>{SIDE}</p>" * 50
    for box in BOXES[5:10]:
        assert html_main.main_text(f"<body><article><h1>Title</h1><p>{TEXT}</p></article>{box % thread}</body>") == f"Title\n\n{TEXT.strip()}", box
        assert html_main.main_text(f"<body><div class=post><p>{TEXT}</p>{box % thread}</div></body>") == TEXT.strip(), box


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        # The page's own text inside boxes with such names.
        (f"<body class=sidebar><div class=sidebar><main>{ARTICLE}</main></div></body>", WANTED),
        (f"<body><div class='notice'><h1>Head</h1>{ARTICLE}</div></body>", f"Head\n\n{WANTED}"),
        (f"<body><div class=comments><p>{SIDE}</p></div></body>", SIDE),
        # A text about comments.
        (f"<article><section id=comments><h2>Comments</h2>{ARTICLE}</section></article>", f"Comments\n\n{WANTED}"),
        (f"<article><div class=section id=comments><h2>On comments</h2>{ARTICLE}</div></article>", f"On comments\n\n{WANTED}"),
        # Paragraphs go by their links.
        (f"<article><p class=related>{SIDE}</p>{ARTICLE}<p class=related><a href=/x>More of it</a></p></article>", f"{SIDE}\n\n{WANTED}"),
        (f"<article>{ARTICLE}<dl class='py notice'><dt>f()<dd>{SIDE}</dl></article>", f"{WANTED}\n\nf()\n\n{SIDE}"),
        (f"<article>{ARTICLE}<pre><span class=comment># {SIDE}</span></pre></article>", f"{WANTED}\n\n# {SIDE}"),
    ],
)
def test_names_take_no_text_of_the_article(html, expected):
    assert html_main.main_text(html) == expected
