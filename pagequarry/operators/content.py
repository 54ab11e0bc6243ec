"""Content of a page: title, metadata, main node, cleaning, structural elements.

Two strategies, ``generic`` and ``wiki``.  Both work on one parsed tree and in a fixed order, because cleaning changes what
later steps see: title and metadata before selection, selection before cleaning, cleaning
before the elements.
"""

from __future__ import annotations

import re
from urllib.parse import urlparse

from pagequarry.functions import rules

from . import dom
from .dom import Element

NO_ELEMENTS = {"headings": [], "lists": [], "code_blocks": [], "tables": [], "images": []}
HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")


def failed(message: str, title: str = "") -> dict:
    """The row of a page that can't be extracted."""
    return {"title": title, "content": "", "metadata": {}, "elements": dict(NO_ELEMENTS), "api_sections": [], "success": False, "extraction_method": "failed", "error": message}


# -- shared


def headings(top: Element) -> list[dict]:
    """By level, then in document order."""
    return [{"level": k, "text": h.stripped(), "id": h.get("id", "")} for k, tag in enumerate(HEADS, 1) for h in top.find_all(tag)]


def lists(top: Element) -> list[dict]:
    return [{"type": x.tag, "items": [li.stripped() for li in x.find_all("li")]} for x in top.find_all("ul", "ol")]


def class_language(classes: list[str], prefixes: tuple[str, ...] = ("language-", "lang-"), whole: bool = False) -> str | None:
    """The language named by the first class with one of the prefixes: up to the next dash, or whole."""
    for name in classes:
        if name.startswith(prefixes):
            return name.split("-", 1)[1] if whole else name.split("-")[1]
    return None


def code_blocks(top: Element) -> list[dict]:
    out = []
    for pre in top.find_all("pre"):
        code = pre.find("code")
        out.append({"language": class_language((code or pre).classes) or "", "code": (code or pre).text(), "source": "pre"})
    return out


def tables(top: Element) -> list[dict]:
    out = []
    for table in top.find_all("table"):
        head, body = table.find("thead"), table.find("tbody")
        rows = [[c.stripped() for c in row.find_all("td", "th")] for row in (body.find_all("tr") if body else [])]
        out.append({"headers": [h.stripped() for h in head.find_all("th")] if head else [], "rows": [r for r in rows if r]})
    return out


def images(top: Element) -> list[dict]:
    return [{k: i.get(k, "") for k in ("src", "alt", "title")} for i in top.find_all("img")]


# -- generic strategy


def generic_title(page: Element) -> str:
    first = dom.select_one(page, ",".join(rules.CONTENT_SELECTORS))
    head = first.find("h1") if first is not None else None
    head = head or page.find("h1")
    if head is not None:
        return head.stripped()
    title = page.find("title")
    if title is None:
        return "Untitled Document"
    text = title.stripped()
    for mark in (" | ", " - "):
        if mark in text:
            return text.split(mark)[0].strip()
    return text or "Untitled Document"


def metadata(page: Element) -> dict[str, str]:
    out: dict[str, str] = {}
    metas = page.find_all("meta")
    for m in metas:
        if (m.get("property") or "").startswith("og:") and m.get("content"):
            out[m.get("property")[3:]] = m.get("content")
    for m in metas:
        if m.get("name") and m.get("content"):
            out[m.get("name")] = m.get("content")
    canonical = next((x for x in page.find_all("link") if "canonical" in x.values("rel") and x.get("href")), None)
    if canonical is not None:
        out["canonical_url"] = canonical.get("href")
    modified = next((m for m in metas if m.get("name") == "last-modified" and m.get("content")), None)
    if modified is not None:
        out["last_modified"] = modified.get("content")
    return out


def content_score(n_p: int, n_h: int, n_code: int, n_text: int) -> float:
    return 2 * n_p + 3 * n_h + 2 * n_code + min(n_text / 100, 10)


def _places(page: Element, tags: tuple[str, ...]) -> list[int]:
    """Where the tags stand in a numbered tree."""
    return sorted(k for tag in tags for k in page.numbering.tags.get(tag, []))


def generic_node(page: Element) -> tuple[Element | None, str]:
    for selector in rules.CONTENT_SELECTORS:
        node = dom.select_one(page, selector)
        if node is not None:
            return node, f"priority_selector:{selector}"
    best = None
    page = page if page.is_numbered else dom.numbered(page)
    counted, lengths = [_places(page, tags) for tags in (("p",), HEADS, ("pre", "code"))], page.numbering.text_lengths()
    for div in page.find_all("div"):
        if set(div.classes) & set(rules.UNSCORED_CLASSES):
            continue
        n_p, n_h, n_code = (dom.count_within(places, div) for places in counted)
        if n_p + n_h + n_code:
            points = content_score(n_p, n_h, n_code, lengths[div.at])
            if best is None or points > best[0]:
                best = points, div
    if best is not None:
        return best[1], "content_scoring"
    body = page.find("body")
    return (body, "full_body_fallback") if body is not None else (None, "extraction_failed")


def generic_clean(node: Element) -> None:
    dom.remove_all(node, rules.NOISE_SELECTORS)
    for block in node.find_all("p", "div"):
        if not block.stripped() and block.find("img", "svg") is None:
            block.remove()
    for element in (node, *node.walk()):
        for name in list(element.attrs):
            if name.startswith("on") or (name.startswith("data-") and name not in ("data-lang", "data-language")):
                del element.attrs[name]
    for pre in node.find_all("pre"):
        if pre.find("code") is None and len(pre.children) == 1 and isinstance(pre.children[0], str):
            code = Element("code", parent=pre)
            code.children, pre.children = pre.children, [code]
            pre.changed()
    dom.numbered(node)


def generic(page: Element | None) -> dict:
    if page is None:
        return failed("Empty HTML provided")
    title, meta = generic_title(page), metadata(page)
    node, method = generic_node(page)
    if node is None:
        return failed("Could not find content container")
    generic_clean(node)
    elements = {"headings": headings(node), "lists": lists(node), "code_blocks": code_blocks(node), "tables": tables(node), "images": images(node)}
    return {"title": title, "content": node.markup(), "metadata": meta, "elements": elements, "api_sections": [], "success": True, "extraction_method": method, "error": None}


# -- wiki strategy


def title_from_url(url: str) -> str:
    parts = urlparse(url)
    path = parts.path.strip("/")
    if not path:
        return parts.netloc.split(".")[0].capitalize()
    return " ".join(w.capitalize() for w in path.split("/")[-1].replace("-", " ").replace("_", " ").split())


def wiki_title(page: Element, url: str) -> str:
    for selector in rules.WIKI_TITLE_SELECTORS:
        node = dom.select_one(page, selector)
        if node is not None and node.stripped():
            return node.stripped()
    return title_from_url(url)


def wiki_node(page: Element) -> tuple[Element | None, str]:
    for selector in rules.WIKI_CONTENT_SELECTORS:
        node = dom.select_one(page, selector)
        if node is not None and len(node.stripped()) > 100:
            return node, f"selector:{selector}"
    best = None
    page = page if page.is_numbered else dom.numbered(page)
    excluded, links, lengths = sorted({n.at for s in rules.WIKI_EXCLUDED for n in dom.select(page, s)}), _places(page, ("a",)), page.numbering.text_lengths()
    for div in page.find_all("div"):
        if not div.classes or dom.count_within(excluded, div):
            continue
        n_text, n_links, n_below = lengths[div.at], dom.count_within(links, div), div.end - div.at - 1
        if n_text < 200 or (n_links > 15 and n_links > n_text / 100) or not n_below:
            continue
        points = 0.8 * n_text + 0.2 * (n_text / n_below) * 10
        if best is None or points > best[0]:
            best = points, div
    if best is not None:
        return best[1], "heuristic:content_size"
    body = page.find("body")
    return (body, "fallback:body") if body is not None else (None, "none")


def wiki_clean(node: Element) -> None:
    dom.remove_all(node, (*rules.WIKI_EXCLUDED, *rules.WIKI_EDIT_LINKS))
    dom.numbered(node)
    for element in (node, *list(node.walk())):
        element.children = [c for c in element.children if not (isinstance(c, dom.Comment) or isinstance(c, str) and "<!--" in c)]
    dom.remove_all(node, ("script", "style", "iframe", *(f".{name}" for name in rules.WIKI_DROPPED_CLASSES)))
    for a in node.find_all("a"):
        href = a.get("href") or ""
        if ("edit" in href or "github.com" in href or "gitlab.com" in href) and len(a.stripped()) < 30:
            a.remove()
    dom.numbered(node)
    kinds = ((div, next((k for k in rules.ADMONITIONS if k in (div.get("class") or "").lower()), None)) for div in node.find_all("div"))
    for div, kind in [(div, kind) for div, kind in kinds if kind and div.find("strong", "b") is None]:
        strong = Element("strong")
        strong.append(f"{kind.capitalize()}: ")
        div.insert(0, strong)
    dom.numbered(node)


def wiki_code_blocks(node: Element) -> list[dict]:
    """Blocks of pre > code first, then those of code divs, which may hold the same pre again."""
    out = []
    for pre in node.find_all("pre"):
        code = pre.find("code")
        if code is not None:
            out.append({"language": class_language(code.classes, whole=True), "code": code.text(), "source": "pre_code"})
    for div in node.find_all("div"):
        if set(div.classes) & set(rules.WIKI_CODE_CLASSES):
            language = div.get("data-language") or div.get("data-lang") or class_language(div.classes, ("language-", "lang-", "highlight-"), whole=True)
            out.append({"language": language, "code": div.text(), "source": "div_code"})
    return out


def api_sections(node: Element) -> list[dict]:
    """Sections headed by API headings: their siblings up to a heading of the same or a higher level."""
    out = []
    for head in node.find_all("h1", "h2", "h3"):
        if head.parent is None or not re.search(rules.API_HEADINGS, head.stripped()):
            continue
        level, parts = int(head.tag[1]), []
        siblings = head.parent.children
        at = next(i for i, c in enumerate(siblings) if c is head)
        for sibling in siblings[at + 1 :]:
            if isinstance(sibling, Element):
                if sibling.tag in HEADS and int(sibling.tag[1]) <= level:
                    break
                parts.append(sibling.markup())
            elif not isinstance(sibling, dom.Comment):
                parts.append(sibling)
        out.append({"title": head.stripped(), "level": level, "content": "".join(parts)})
    return out


def wiki(page: Element | None, url: str) -> dict:
    if page is None:
        return failed("Empty HTML provided", title_from_url(url))
    title = wiki_title(page, url)
    node, method = wiki_node(page)
    if node is None:
        return failed("Could not find content container", title)
    wiki_clean(node)
    blocks, sections = wiki_code_blocks(node), api_sections(node)
    meta = {
        "extraction_successful": "true", "extraction_method": method, "has_code_blocks": str(bool(blocks)).lower(), "code_block_count": str(len(blocks)),
        "has_api_sections": str(bool(sections)).lower(), "api_section_count": str(len(sections)), "url": url,
    }
    elements = {"headings": headings(node), "lists": lists(node), "code_blocks": blocks, "tables": tables(node), "images": images(node)}
    return {"title": title, "content": node.markup(), "metadata": meta, "elements": elements, "api_sections": sections, "success": True, "extraction_method": method, "error": None}
