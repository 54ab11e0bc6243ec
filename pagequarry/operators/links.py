"""Links of a page: candidates from the tree, with their ordinals; dedupe and merge are relational.

A generator emits each candidate once it has passed the cheap href checks, in the order in which the strategy
meets it.  ``dedupe_then_filter`` and ``merge_wiki`` then work on rows with windows: URLs
are deduplicated *before* the follow filter, so a URL rejected once is not reconsidered.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.functions import rules, urls

from . import dom
from .dom import Element

HEADS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})

# Plain references, as most are: no empty segments, none that begin with a dot, no parameters, nothing empty behind ? or #.  The library puts these
# behind the root or the folder of the base, or gives them back as they are.
_SEGMENT = r"[\w~%-][\w~%.-]*+"
_PATH, _TAIL = rf"{_SEGMENT}(?:/{_SEGMENT})*+/?", r"(?:\?[\w~%.=&+/-]++)?+(?:#[\w~%.=&+/-]++)?+"
_ROOTED = re.compile(rf"/(?:{_PATH})?{_TAIL}", re.ASCII)
_RELATIVE = re.compile(rf"{_PATH}{_TAIL}", re.ASCII)
_ABSOLUTE = re.compile(rf"https?://[a-z0-9.-]++(?::[0-9]++)?+((?:/(?:{_PATH})?)?){_TAIL}", re.ASCII)
_NEXT, _PREVIOUS = (re.compile("|".join(map(re.escape, words))) for words in (rules.NEXT_WORDS, rules.PREVIOUS_WORDS))


def path_depth(url: str) -> int:
    plain = _ABSOLUTE.fullmatch(url)
    path = (plain[1] if plain else urlparse(url).path).strip("/")
    return path.count("/") + 1 if path else 0


def _joined(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href)
    except ValueError:
        return None


class _Out:
    """The links of a page, with the texts, URLs and depths that several groups ask for."""

    def __init__(self, base: str):
        self.rows: list[dict] = []
        self.base = base
        self._texts: dict[int, str] = {}
        self._urls: dict[str, str | None] = {}
        self._depths: dict[str, int] = {}
        self._seen: set[str] = set()
        root, beside = _joined(base, "/"), _joined(base, "x")
        #: What plain references stand behind; none where the base can't be read.
        self._root, self._folder = (None, None) if root is None or beside is None else (root[:-1], beside[:-1])

    def text(self, a: Element) -> str:
        if id(a) not in self._texts:
            self._texts[id(a)] = a.stripped()
        return self._texts[id(a)]

    def url(self, href: str) -> str | None:
        if href not in self._urls:
            self._urls[href] = self._resolved(href)
        return self._urls[href]

    def _resolved(self, href: str) -> str | None:
        if self._root is None:
            return _joined(self.base, href)
        if _ROOTED.fullmatch(href):
            return self._root + href
        if _RELATIVE.fullmatch(href):
            return self._folder + href
        return href if _ABSOLUTE.fullmatch(href) else _joined(self.base, href)

    def new(self, href: str | None) -> str | None:
        """The URL of a reference, unless the page has a link to it already."""
        url = self.url(href) if href else None
        return None if not url or url in self._seen else url

    def depth(self, url: str) -> int:
        if url not in self._depths:
            self._depths[url] = path_depth(url)
        return self._depths[url]

    def add(self, group: int, url: str | None, text: str, kind: str, priority: float, depth: int | None, **more) -> None:
        if url is None:
            return
        row = {"url": url, "text": text, "type": kind, "priority": float(priority), "depth": depth, "group_ix": group, "seq": len(self.rows)}
        row |= {k: None for k in ("source_selector", "is_active", "is_heading", "container_type", "section_title")} | more
        self.rows.append(row)
        self._seen.add(url)


# -- generic strategy


def _generic_href(a: Element) -> str | None:
    href = (a.get("href") or "").strip()
    return None if not href or href.startswith("javascript:") or href == "#" else href


def pagination_kind(text: str, title: str, classes: list[str], rel: list[str]) -> str | None:
    """next before previous; words match anywhere in text or title."""
    text, title = text.lower(), title.lower()
    if _NEXT.search(text) or _NEXT.search(title) or any("next" in c for c in classes) or "next" in rel:
        return "pagination_next"
    if _PREVIOUS.search(text) or _PREVIOUS.search(title) or any("prev" in c for c in classes) or {"prev", "previous"} & set(rel):
        return "pagination_previous"
    return None


def generic(page: Element, base: str) -> list[dict]:
    """The first candidate of each URL in the page."""
    out = _Out(base)
    for rank, selector in enumerate(rules.NAV_SELECTORS):
        found = dom.select(page, selector)
        for i, nav in enumerate(found):
            priority = rank + 1 + (0.1 * i if len(found) > 1 else 0)
            for a in nav.find_all("a"):
                if url := out.new(_generic_href(a)):
                    out.add(0, url, out.text(a), "navigation", priority, out.depth(url), source_selector=selector)
    for rank, selector in enumerate(rules.CONTENT_LINK_SELECTORS):
        for a in dom.select(page, selector):
            if url := out.new(_generic_href(a)):
                out.add(1, url, out.text(a), "content", 10 + rank, out.depth(url), source_selector=selector)
    for a in page.find_all("a"):
        if not (url := out.new(_generic_href(a))):
            continue
        kind = pagination_kind(out.text(a), a.get("title") or "", a.classes, a.values("rel"))
        if kind:
            out.add(2, url, out.text(a), kind, 5 if kind == "pagination_next" else 8, out.depth(url))
    return out.rows


# -- wiki strategy


def nav_depth(a: Element) -> int:
    return max(0, sum(1 for x in a.ancestors() if x.tag in ("ul", "ol")) - 1)


def is_active(a: Element) -> bool:
    item = next((x for x in a.ancestors() if x.tag == "li"), None)
    names = set(a.classes) | set(item.classes if item is not None else [])
    return bool(names & set(rules.ACTIVE_CLASSES)) or bool(a.get("aria-current"))


def container(a: Element) -> str:
    above = {x.tag for x in a.ancestors()}
    if above & HEADS:
        return "heading"
    if "p" in above:
        return "paragraph"
    return "list" if above & {"ul", "ol"} else "other"


def wiki_priority(text: str, href: str, depth: int, active: bool, heading: bool) -> int:
    points = 5 + ({0: 3, 1: 2}.get(depth, -depth)) + 3 * active + 2 * heading
    text, href = text.lower(), href.lower()
    points += 2 * any(w in text or w in href for w in rules.ENTRY_WORDS)
    return points - 3 * any(w in text for w in rules.OLD_WORDS)


def _wiki_href(a: Element) -> str | None:
    href = a.get("href") or ""
    return None if not href or href.startswith(("#", "javascript:", "mailto:")) else href


def looks_like_doc(url: str, text: str, base: str) -> bool:
    there, here = urlparse(url).netloc, urlparse(base).netloc
    if not there or there == here:
        return not url.startswith("#") and not re.search("|".join(rules.WIKI_EXCLUDED_LINKS), url)
    return bool(re.search("|".join(rules.WIKI_DOC_LINKS), url) or re.search("|".join(rules.WIKI_DOC_TEXTS), text, re.IGNORECASE))


def wiki(page: Element, base: str) -> list[dict]:
    out = _Out(base)
    for selector in rules.WIKI_NAV_SELECTORS:
        for nav in dom.select(page, selector):
            for a in nav.find_all("a"):
                if (href := _wiki_href(a)) and (url := out.url(href)):
                    depth, active = nav_depth(a), is_active(a)
                    heading = a.parent is not None and a.parent.tag in HEADS | {"strong"}
                    out.add(0, url, out.text(a), "navigation", wiki_priority(out.text(a), href, depth, active, heading), depth, source_selector=selector, is_active=active, is_heading=heading)
    area = page.find("body")
    for selector in rules.WIKI_AREA_SELECTORS:
        found = dom.select(page, selector)
        if found:
            area = max(found, key=lambda n: len(n.stripped()))
            break
    for a in area.find_all("a") if area is not None else []:
        if (href := _wiki_href(a)) and (url := out.url(href)) and looks_like_doc(url, out.text(a), base):
            kind = container(a)
            out.add(1, url, out.text(a), "content", 5 if kind == "heading" else 3, 0, container_type=kind, is_heading=kind == "heading")
    for selector in rules.WIKI_RELATED_SELECTORS:
        for section in dom.select(page, selector):
            head = section.find(*sorted(HEADS))
            title = head.stripped() if head is not None else section.get("aria-label") or section.get("title") or ""
            for a in section.find_all("a"):
                if (href := _wiki_href(a)) and (url := out.url(href)):
                    out.add(2, url, out.text(a), "related", 7, None, source_selector=selector, section_title=title)
    return out.rows


# -- relational part


def dedupe_then_filter(links: DataFrame) -> DataFrame:
    """Generic links (page_id, page_url, url, text, seq, ...): the first of each URL in a page, then those to follow."""
    first = Window.partitionBy("page_id", "url").orderBy("seq")
    return links.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth").filter(urls.should_follow("url", "page_url", "text"))


def by_page(links: DataFrame) -> DataFrame:
    """The links dealt by page: windows and groups over a page's URLs need no further exchange."""
    return links.repartition("page_id")


def merge_wiki(links: DataFrame) -> DataFrame:
    """Wiki links: the first of each URL in a group, then one row per page and URL.

    page_url, where it is given, comes along.  The row with the strictly higher priority wins, in the first one's position; its source_type lists
    the running winners, the latest first.
    """
    in_group = Window.partitionBy("page_id", "url", "group_ix").orderBy("seq")
    rows = links.withColumn("nth", F.row_number().over(in_group)).filter("nth = 1").drop("nth")
    earlier = Window.partitionBy("page_id", "url").orderBy("group_ix").rowsBetween(Window.unboundedPreceding, -1)
    all_groups = Window.partitionBy("page_id", "url")
    rows = rows.withColumn("best_before", F.max("priority").over(earlier)).withColumn("position", F.min("seq").over(all_groups))
    winners = rows.filter("best_before IS NULL OR priority > best_before")
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("group_ix")).alias("k"), F.col("type").alias("t")))), lambda x: x["t"])
    record = F.struct(*[c for c in links.columns if c not in ("page_id", "page_url", "url")])
    keys = [c for c in ("page_id", "page_url", "url") if c in links.columns]
    merged = winners.groupBy(*keys).agg(F.max_by(record, "group_ix").alias("r"), F.array_join(names, ",").alias("source_type"), F.first("position").alias("position"))
    return merged.select(*keys, "source_type", "position", "r.*")


def documentation_only(links: DataFrame) -> DataFrame:
    """Wiki links of the same domain that are not excluded, and others that look like documentation (``is_external``)."""
    same = F.coalesce(urls.netloc("url") == urls.netloc("page_url"), F.lit(False))
    inside = same & ~urls.excluded(urls.path("url"))
    outside = urls.looks_like_doc("url", "text", "page_url")
    return links.filter(inside | outside).withColumn("is_external", F.when(inside, F.lit(None)).otherwise(F.lit(True)))


def ordered_wiki(links: DataFrame) -> DataFrame:
    """rank of the links of a page: priority, navigation first, depth, position."""
    order = Window.partitionBy("page_id").orderBy(F.desc("priority"), F.col("source_type") != "navigation", F.coalesce("depth", F.lit(0)), "position")
    return links.withColumn("rank", F.row_number().over(order))
