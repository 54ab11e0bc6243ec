r"""Main text of HTML pages by tree scoring.

A page is parsed once into a light tree.  Elements that are never part of an
article (scripts, forms, navigation, page headers and footers, adverts, notices,
reader comments, hidden parts) are taken out.  By class and id this takes a whole name of
such a part on a box: a sidebar, a notice of cookies or of anything else, a newsletter, an advert and reader comments go whatever their length, unless
the page's ``main`` or first heading is in it (or an article in anything but comments); other parts go if they are short or mostly links.  Boxes
that merely have such a word in their names are left out of the choice, but stay inside the
container chosen.  If names leave a page without any text, it is read without regard to names.  A form that wraps the page (half of its text and a paragraph) is a container; any other form goes.  A ``header``
inside an article is the head of that article if it has a heading, and stays; else, and anywhere else, it goes.  Then each paragraph passes points
for its length and its commas to its ancestors, the whole to the parent and less
to each one above; an ancestor's points are discounted by its link density.  The
best container is kept, with the siblings that score well beside it; a container
inside ``article`` or ``main`` stands for that element.

A page is one row in and one row out: Spark partitions the pages, a task holds one
Arrow batch and the tree of one page.

Defined results: null or empty html, and pages without text, give the empty text;
repeated pages are extracted each for itself; an empty table gives no rows; further
columns are ignored.  The whole html is read, however long.  White space is
whatever ``str.split`` splits at, so a non-breaking space counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends the open elements named, up to the nearest of the stoppers.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
P_STOPS = frozenset("article aside blockquote body button caption dd details dialog div dt figcaption figure footer form header li main nav object section td th".split())

#: Never part of an article, by tag and by role.
NEVER_TAGS = frozenset(
    "head script style noscript template iframe object embed applet canvas svg audio video map form button input select textarea"
    " nav header footer aside menu dialog".split()
)
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status note".split())
#: Never part of an article, by a word of class or id.
READERS = frozenset("comment comments commentlist disqus replies reply respond usercomments".split())
NEVER_WORDS = READERS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit adsbygoogle disclaimer banner banners sponsor sponsored sponsors promo promos promotion promoted"
    " sidebar sidebars rail menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs pagination pager footer footers header masthead topbar toolbar"
    " cookie cookies consent gdpr notice notices notification notifications alert popup popover modal overlay lightbox newsletter subscribe subscription signup"
    " signin login register paywall related recommended recommendations share sharing social follow widget widgets search skip hidden outbrain taboola".split()
)
#: Adverts and comment threads are no text of the article at any length.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit adsbygoogle sponsored outbrain taboola".split())
THREADS = READERS - {"reply", "replies"}
#: A box with one of these as its whole name is no text of the article at any length.
FIRM = ADVERTS | frozenset("sidebar sidebars cookie cookies consent gdpr newsletter notice notices".split())
#: A name with one of these is that of a part, whatever else is in it.
STRONG = ADVERTS | frozenset("sidebar sidebars navbar topnav subnav breadcrumb breadcrumbs cookie cookies consent gdpr newsletter paywall".split())
#: Words that go with those of a part in its name, and those that turn it into a property of the page.
FILLERS = frozenset("area articles bar block box button buttons container group icons inner item items links list posts site thread top bottom left right wrap wrapper slot unit zone label space placement".split())
READER_FILLERS = FILLERS | frozenset("author body content form meta post section text title".split())
PROPERTIES = frozenset("has no with without is".split())
#: Elements that may be a part of the page; a row, cell, heading or piece of a line is text whatever its class.
BOXES = frozenset("div section article ul ol dl li p table center figure details".split())
ROWS = frozenset("tr th td thead tbody tfoot caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Characters of a short box.
SHORT = 300
#: Elements whose id names a part of the page; elsewhere an id is an anchor in the text.
PARTS = frozenset("div section ul ol dl table center fieldset span".split())
GOOD_WORDS = frozenset("article body content entry main page post text story blog hentry".split())
ARTICLES = frozenset({"article", "main"})
PARAGRAPHS = frozenset("p pre td blockquote dd li h1 h2 h3 h4 h5 h6 div section article main figcaption body".split())
START_POINTS = {"article": 30.0, "main": 20.0, "section": 5.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0}


class Node:
    __slots__ = ("attrs", "children", "doubt", "parent", "points", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.points = tag, attrs, parent, [], None
        self.doubt = False


class Tree(HTMLParser):
    """A tree of Node and str with the implied end tags that articles need."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#page", {}, None)
        #: Open elements by tag, so that an end tag without a start is known without a walk.
        self.open: dict[str, int] = {}

    def _up_to(self, node: Node) -> None:
        """Close the open elements below node's parent."""
        end = node.parent
        while self.at is not end:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _close(self, tags, stops) -> None:
        node = self.at
        while node.parent is not None and node.tag not in stops and any(self.open.get(t) for t in tags):
            above = node.parent
            if node.tag in tags:
                self._up_to(node)
            node = above

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, P_STOPS)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as browsers do, "/" counts for void elements only

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        self._up_to(node)

    def handle_data(self, data):
        self.at.children.append(data)

    def parse_marked_section(self, i, report=1):
        """A bogus comment, up to the next ">"."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def nodes(top: Node) -> Iterator[Node]:
    """All elements below and with top, in page order; not those in doubt."""
    stack = [top]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.doubt)


def words_of(node: Node) -> set[str]:
    """The words of class and, where it names a part, id: split at punctuation and inner capitals."""
    own = node.attrs.get("id", "") if node.tag in PARTS or node.tag in ARTICLES else ""
    names = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{node.attrs.get('class', '')} {own}")
    return set(re.split(r"[^a-z]+", names.lower()))


def is_hidden(node: Node) -> bool:
    style = node.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in node.attrs or node.attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def _shares(root: Node) -> dict[int, tuple[int, int, bool, bool, bool]]:
    """By node: length of its text and of that in links, whether an article or main, a p, and a main or h1 is below or with it."""
    out: dict[int, tuple[int, int, bool, bool, bool]] = {}
    for node in reversed(list(nodes(root))):
        if node.tag in NEVER_TAGS and node.tag != "form":
            out[id(node)] = (0, 0, False, False, False)
            continue
        text, link, article, p, head = 0, 0, node.tag in ARTICLES, node.tag == "p", node.tag in ("main", "h1")
        for child in node.children:
            if isinstance(child, str):
                text += len(child.strip())
            else:
                t, k, a, q, h = out[id(child)]
                text, link, article, p, head = text + t, link + k, article or a, p or q, head or h
        out[id(node)] = (text, text if node.tag == "a" else link, article, p, head)
    return out


def _names(value: str) -> list[set[str]]:
    """The words of each name in a class or id; names of properties (has-sidebar) are none."""
    names = (set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) - {""} for name in value.split())
    return [words for words in names if words and not words & PROPERTIES]


def _whole(names: list[set[str]], parts: frozenset[str]) -> bool:
    """Whether one of the names says nothing but one of the parts."""
    fillers = READER_FILLERS if parts <= READERS else FILLERS
    return any(words & parts and words <= NEVER_WORDS | fillers for words in names)


def _opens_with(node: Node, words: set[str], shares: dict) -> bool:
    """Whether the first text of node is a heading that has one of the words: then an id with it is an anchor."""
    at = node
    while True:
        for child in at.children:
            if isinstance(child, str):
                if child.strip():
                    return False
            elif child.tag in HEADINGS or shares[id(child)][0]:
                break
        else:
            return False
        if child.tag in HEADINGS:
            text = "".join(c for c in _strings(child)).lower()
            return bool(words & set(re.split(r"[^a-z]+", text)))
        if child.tag not in ("div", "section"):
            return False
        at = child


def _is_section(node: Node, words: set[str], shares: dict) -> bool:
    """Whether a box whose id is that of reader comments is a section of a text about them: marked as one, opened by a heading
    that has one of the words, and without a reader's comment in it."""
    marked = node.tag == "section" or re.search(r"(^|\s)(section|level\d)(\s|$)", node.attrs.get("class", ""))
    return bool(marked) and _opens_with(node, words, shares) and not any(c.tag in BOXES and _whole(_names(c.attrs.get("class", "")), READERS) for c in nodes(node))


def _strings(top: Node) -> Iterator[str]:
    stack: list = [top]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            yield node
        else:
            stack.extend(reversed(node.children))


def is_article(node: Node) -> bool:
    return node.tag in ARTICLES or node.attrs.get("role", "").lower() in ("main", "article")


def is_part(node: Node, shares: dict, total: int) -> bool:
    """Whether the names of a node are those of a part of the page, and its text is like one."""
    tag = node.tag
    if tag in ROWS or tag in HEADINGS or tag in ("html", "body"):
        return False
    text, link, article, p, head = shares[id(node)]
    classes = _names(node.attrs.get("class", ""))
    if _whole(classes, ADVERTS) and not article and not head:
        return True
    if tag not in BOXES:
        return False
    if _whole(classes, READERS):
        return not head
    ids = _names(node.attrs.get("id", "")) if tag in PARTS else []
    if _whole(ids, READERS) and not head and not _is_section(node, set().union(*ids) & READERS, shares):
        return text <= SHORT or _whole(ids, THREADS)
    if article or head:
        return False
    if tag != "dl" and _whole(classes, FIRM):
        return True
    half = tag in ("div", "section") and 2 * text >= total and p
    if half or not (_whole(classes, NEVER_WORDS) or any(words & STRONG for words in classes)):
        return False
    return text <= SHORT and tag not in ("p", "dl") or 2 * link >= text


def is_doubtful(node: Node, shares: dict, total: int) -> bool:
    """Whether a node outside articles has a word of a part in its names: it is not to be chosen for itself."""
    tag = node.tag
    bad = words_of(node) & NEVER_WORDS
    if not bad or tag in ("html", "body", "tr") or tag in HEADINGS or tag in ROWS and not bad & STRONG:
        return False
    text, _, article, p, _ = shares[id(node)]
    # A wrapper of the whole page may be named after one of its parts.
    if article or tag in ("div", "section") and 2 * text >= total and p:
        return False
    by_class = set().union(*_names(node.attrs.get("class", ""))) & NEVER_WORDS
    return bool(by_class) or not _opens_with(node, bad, shares)


def goes(node: Node, inside: bool, shares: dict, total: int) -> bool:
    """Whether the tag of a node is that of a part of the page; inside: in an article."""
    if node.tag == "form":
        text, _, _, p, _ = shares[id(node)]
        return not (p and 2 * text >= total)
    if node.tag == "header" and inside:
        return not any(c.tag in HEADINGS for c in nodes(node))
    return node.tag in NEVER_TAGS


def strip(root: Node, by_name: bool = True) -> None:
    """Take out what is never part of an article; mark what is in doubt (by its names)."""
    shares = _shares(root)
    total = shares[id(root)][0]
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        kept = []
        for child in node.children:
            if isinstance(child, str):
                kept.append(child)
                continue
            tag = child.tag
            if tag in NEVER_TAGS and goes(child, inside, shares, total) or child.attrs and (is_hidden(child) or child.attrs.get("role", "").lower() in NEVER_ROLES and tag != "form" and not (tag == "header" and inside)):
                continue
            if by_name and child.attrs and ("class" in child.attrs or "id" in child.attrs):
                if is_part(child, shares, total):
                    continue
                child.doubt = not inside and not is_article(child) and is_doubtful(child, shares, total)
            kept.append(child)
            stack.append((child, inside or tag in HEADINGS or is_article(child)))
        node.children = kept


def own_text(node: Node) -> str:
    """Text of a node that is not in a block below it."""
    out, stack = [], list(reversed(node.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            out.append(child)
        elif child.tag not in BLOCKS and not child.doubt:
            stack.extend(reversed(child.children))
    return " ".join("".join(out).split())


def lengths(root: Node) -> dict[int, tuple[int, int]]:
    """(text length, length of text in links) by node, in one pass from below."""
    order = list(nodes(root))
    out: dict[int, tuple[int, int]] = {}
    for node in reversed(order):
        text = link = 0
        for child in node.children:
            if isinstance(child, str):
                text += len(child)
            elif not child.doubt:
                t, a = out[id(child)]
                text, link = text + t, link + a
        out[id(node)] = (text, text if node.tag == "a" else link)
    return out


def score(root: Node) -> tuple[list[Node], dict[int, tuple[int, int]]]:
    size = lengths(root)
    found: list[Node] = []
    for node in nodes(root):
        if node.tag not in PARAGRAPHS:
            continue
        text = own_text(node)
        if not text:
            continue
        points = min(len(text) / 100, 3.0) + text.count(",") + (1.0 if len(text) >= 25 else 0.0)
        at, level = node.parent if node.tag not in ("div", "section", "article", "main", "body") else node, 1
        while at is not None and at.tag not in ("#page", "html") and level <= 4:
            if at.points is None:
                at.points = START_POINTS.get(at.tag, 0.0) + (10.0 if at.attrs and words_of(at) & GOOD_WORDS else 0.0)
                found.append(at)
            at.points += points / level
            at, level = at.parent, level + 1
    for node in found:
        text, link = size[id(node)]
        node.points *= 1 - link / max(1, text)
    return found, size


def beside(node: Node | str, chosen: Node, size: dict[int, tuple[int, int]]) -> bool:
    """Whether node is one more article of the page beside the chosen one."""
    if isinstance(node, str) or node.doubt or node.tag != chosen.tag or not is_article(node):
        return False
    text, link = size[id(node)]
    return 2 * link < text and 5 * text >= size[id(chosen)][0]


def pick(root: Node) -> list[Node]:
    """The best container, or it and its good siblings, in page order."""
    found, size = score(root)
    if not found:
        return [root]
    best = max(found, key=lambda n: n.points)  # the first of equals
    at = best
    while at is not None:
        if is_article(at):
            return [at] if at.parent is None else [c for c in at.parent.children if c is at or beside(c, at, size)]
        at = at.parent
    if best.parent is None or best.tag == "body":
        return [best]
    least, kept = max(10.0, 0.2 * best.points), []
    for sibling in best.parent.children:
        if isinstance(sibling, str) or sibling.doubt:
            continue
        text, link = size[id(sibling)]
        bonus = 0.2 * best.points if sibling.attrs.get("class") and sibling.attrs.get("class") == best.attrs.get("class") else 0.0
        good = sibling is best or (sibling.points or 0.0) + bonus >= least
        plain = sibling.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6") and text and 4 * link <= text
        if good or plain:
            kept.append(sibling)
    return kept


def block_texts(top: Node) -> list[str]:
    """Texts of the blocks of top in page order, white space made single; of a whole page without what is in doubt."""
    page = top.tag in ("#page", "html", "body")
    blocks, run = [], []

    def flush():
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    stack: list = [top]
    while stack:
        node = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            run.append(node)
        elif page and node.doubt:
            continue
        elif node.tag in BLOCKS:
            flush()
            stack.append(None)
            stack.extend(reversed(node.children))
        elif node.tag == "br":
            run.append(" ")
        else:
            stack.extend(reversed(node.children))
    flush()
    return blocks


def main_text(html: str | None) -> str:
    if not html:
        return ""
    for by_name in (True, False):
        root = parse(html)
        strip(root, by_name)
        text = "\n\n".join(text for top in pick(root) for text in block_texts(top))
        if text:
            return text
    return ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            texts = [main_text(h.as_py()) for h in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string")).mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )
