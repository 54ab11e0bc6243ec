"""HTML to Markdown on the DOM kernel."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions import text as T

from . import content, dom
from .dom import Element

BLOCKS = frozenset("address article aside body dd details div dl dt fieldset figcaption figure footer form header html main nav p section summary [document]".split())


class _Writer:
    def __init__(self, links: bool, images: bool):
        self.links, self.images = links, images

    def inline(self, node) -> str:
        if isinstance(node, dom.Comment):
            return ""
        if isinstance(node, str):
            return re.sub(r"\s+", " ", node)
        tag = node.tag
        if tag in ("script", "style", "template", "noscript"):
            return ""
        if tag == "br":
            return "  \n"
        if tag == "img":
            return f"![{node.get('alt', '')}]({node.get('src', '')})" if self.images else ""
        inner = "".join([self.inline(c) for c in node.children])
        bare = inner.strip()
        if not bare:
            return inner
        if tag in ("strong", "b"):
            return inner.replace(bare, f"**{bare}**", 1)
        if tag in ("em", "i"):
            return inner.replace(bare, f"*{bare}*", 1)
        if tag in ("code", "kbd", "samp"):
            return f"`{node.text().strip()}`"
        if tag == "a" and self.links and node.get("href"):
            return f"[{bare}]({node.get('href')})"
        return inner

    def fence(self, pre: Element) -> str:
        code = pre.find("code")
        language = content.class_language((code or pre).classes) or (code or pre).get("data-lang") or pre.get("data-lang") or ""
        return f"```{language}\n{(code or pre).text().strip(chr(10))}\n```"

    def items(self, node: Element, depth: int) -> str:
        """A list's lines.  A list right inside it is one level deeper; any other text right inside it is a line without a mark."""
        out, k, indent = [], 0, "  " * depth
        for c in node.children:
            tag = c.tag if isinstance(c, Element) else ""
            if tag in ("ul", "ol"):
                out.append(self.items(c, depth + 1))
            elif tag == "pre":
                out.append(self.fence(c))
            elif tag != "li":
                text = self.inline(c).strip()
                if text:
                    out.append(indent + text)
            else:
                k += 1
                mark = f"{k}." if node.tag == "ol" else "*"
                own = "".join([self.inline(x) for x in c.children if not (isinstance(x, Element) and x.tag in ("ul", "ol", "pre"))]).strip()
                out.append(f"{indent}{mark} {own}")
                for x in c.children:
                    if isinstance(x, Element) and x.tag in ("ul", "ol"):
                        out.append(self.items(x, depth + 1))
                    elif isinstance(x, Element) and x.tag == "pre":
                        out.append(self.fence(x))
        return "\n".join(out)

    def table(self, node: Element) -> str:
        rows = [[self.inline(c).strip().replace("|", r"\|") for c in tr.find_all("td", "th")] for tr in node.find_all("tr")]
        rows = [r for r in rows if r]
        if not rows:
            return ""
        width = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])

    def blocks(self, node: Element) -> list[str]:
        out, run = [], []

        def flush():
            joined = "".join(run).strip()
            if joined:
                out.append(joined)
            run.clear()

        for c in node.children:
            tag = c.tag if isinstance(c, Element) else ""
            if tag in content.HEADS:
                flush()
                out.append(f"{'#' * int(tag[1])} {''.join([self.inline(x) for x in c.children]).strip()}")
            elif tag == "pre":
                flush()
                out.append(self.fence(c))
            elif tag in ("ul", "ol"):
                flush()
                out.append(self.items(c, 0))
            elif tag == "table":
                flush()
                out.append(self.table(c))
            elif tag == "blockquote":
                flush()
                out.append("\n".join(f"> {line}" for line in "\n\n".join(self.blocks(c)).split("\n")))
            elif tag == "hr":
                flush()
                out.append("* * *")
            elif tag in BLOCKS:
                flush()
                out.extend(self.blocks(c))
            else:
                run.append(self.inline(c))
        flush()
        return [b for b in out if b]


#: Levels of markup that are followed; the interpreter keeps them on its heap.
LEVELS = 100_000


def to_markdown(html: str | None, links: bool = True, images: bool = True) -> str:
    """The Markdown of a page; markup nested beyond ``LEVELS`` gives its text alone."""
    if not html:
        return ""
    held = sys.getrecursionlimit()
    sys.setrecursionlimit(max(held, 4 * LEVELS))
    try:
        return "\n\n".join(_Writer(links, images).blocks(dom.parse(html)))
    except (RecursionError, ValueError, AssertionError):
        return re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", html)).strip()
    finally:
        sys.setrecursionlimit(held)


def markdown(html, links: bool = True, images: bool = True) -> Column:
    """A Markdown column: Arrow-batched emission, then the clean-up passes as expressions."""

    @F.pandas_udf("string")
    def emit(values: pd.Series) -> pd.Series:
        return values.map(lambda h: to_markdown(h, links, images))

    return T.markdown_postprocessed(emit(F.col(html) if isinstance(html, str) else html))
