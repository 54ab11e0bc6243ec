"""The DOM kernel: a lenient tree, a small CSS matcher, text and markup of nodes.

The tree is the one of a plain tag parser: no implied end tags (unclosed paragraphs nest), an end
tag closes its nearest open match, stray ones are ignored, void elements close themselves,
of repeated attributes the last wins.  It lives inside Python operators only, never in a column.

A tree that isn't changed is numbered in document order, so what is below a node is a range, and tags, classes and ids are looked up;
a change makes its nodes walk until the part still needed is numbered again (``numbered``).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from html import parser as html_parser
from html import unescape
from html.parser import HTMLParser

VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
#: Elements whose own strings are no part of an ancestor's text.
SILENT = frozenset({"script", "style", "template"})
MANY_VALUED = frozenset({"class", "rel"})


class Comment(str):
    """A comment, declaration or processing instruction: never text."""

    form = "<!--{}-->"


class Declaration(Comment):
    form = "<!{}>"


class Instruction(Comment):
    form = "<?{}>"


class Numbering:
    """The elements of a tree in document order, and where each tag, class and id stands."""

    __slots__ = ("_classes", "_ids", "_tags", "_texts", "nodes", "valid")

    def __init__(self, nodes: list[Element]):
        self.nodes, self.valid = nodes, True
        self._tags = self._classes = self._ids = self._texts = None

    @property
    def tags(self) -> dict[str, list[int]]:
        if self._tags is None:
            self._tags = {}
            for k, node in enumerate(self.nodes):
                self._tags.setdefault(node.tag, []).append(k)
        return self._tags

    @property
    def classes(self) -> dict[str, list[int]]:
        if self._classes is None:
            self._classes = {}
            for k, node in enumerate(self.nodes):
                if "class" in node.attrs:
                    for name in set(node.classes):
                        self._classes.setdefault(name, []).append(k)
        return self._classes

    @property
    def ids(self) -> dict[str, list[int]]:
        if self._ids is None:
            self._ids = {}
            for k, node in enumerate(self.nodes):
                if "id" in node.attrs:
                    self._ids.setdefault(node.attrs["id"], []).append(k)
        return self._ids

    def text_lengths(self) -> list[int]:
        """By node: characters of its own stripped strings and of those below, in one pass from the end."""
        if self._texts is None:
            own = [0] * len(self.nodes)
            for k in range(len(self.nodes) - 1, -1, -1):
                node = self.nodes[k]
                for child in node.children:
                    if isinstance(child, Element):
                        own[k] += 0 if child.tag in SILENT else own[child.at]
                    elif not isinstance(child, Comment):
                        own[k] += len(child.strip())
            self._texts = own
        return self._texts


def within(places: list[int], node: Element) -> list[int]:
    """Of ascending places those below node."""
    return places[bisect_left(places, node.at + 1) : bisect_left(places, node.end)]


def count_within(places: list[int], node: Element) -> int:
    return bisect_left(places, node.end) - bisect_left(places, node.at + 1)


class Element:
    __slots__ = ("at", "attrs", "children", "end", "numbering", "parent", "tag")

    def __init__(self, tag: str, attrs: dict | None = None, parent: Element | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []
        self.numbering: Numbering | None = None

    @property
    def is_numbered(self) -> bool:
        return self.numbering is not None and self.numbering.valid

    def changed(self) -> None:
        """What was numbered with this node isn't any more."""
        if self.numbering is not None:
            self.numbering.valid = False

    # -- walking
    def walk(self) -> Iterator[Element]:
        """Elements below this one, in document order; the tree must not change meanwhile."""
        if self.is_numbered:
            yield from self.numbering.nodes[self.at + 1 : self.end]
            return
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))

    def find_all(self, *tags: str) -> list[Element]:
        if self.is_numbered:
            nodes, places = self.numbering.nodes, self.numbering.tags
            found = [k for tag in tags if tag in places for k in within(places[tag], self)]
            return [nodes[k] for k in (found if len(tags) == 1 else sorted(found))]
        return [n for n in self.walk() if n.tag in tags]

    def find(self, *tags: str) -> Element | None:
        if self.is_numbered:
            found = self.find_all(*tags)
            return found[0] if found else None
        return next((n for n in self.walk() if n.tag in tags), None)

    def ancestors(self) -> Iterator[Element]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    # -- attributes
    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    def values(self, name: str) -> list[str]:
        return (self.attrs.get(name) or "").split()

    @property
    def classes(self) -> list[str]:
        return self.values("class")

    # -- text
    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, Element):
                if node.tag not in SILENT:
                    stack.extend(reversed(node.children))
            elif not isinstance(node, Comment):
                yield node

    def text(self) -> str:
        return "".join(self.strings())

    def stripped(self) -> str:
        """Text of individually stripped strings, joined without a separator."""
        return "".join(s.strip() for s in self.strings())

    # -- changing
    def remove(self) -> None:
        if self.parent is not None:
            self.changed()
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def append(self, node) -> None:
        self.changed()
        if isinstance(node, Element):
            node.parent = self
        self.children.append(node)

    def insert(self, at: int, node) -> None:
        self.changed()
        if isinstance(node, Element):
            node.parent = self
        self.children.insert(at, node)

    # -- markup
    def markup(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                out.append(node[0])
            elif isinstance(node, Comment):
                out.append(node.form.format(str(node)))
            elif isinstance(node, str):
                out.append(node)
            else:
                attrs = "".join(f" {k}={_quoted(v)}" if v is not None else f' {k}=""' for k, v in node.attrs.items())
                if node.tag in VOID:
                    out.append(f"<{node.tag}{attrs}/>")
                    continue
                out.append(f"<{node.tag}{attrs}>")
                stack.append((f"</{node.tag}>",))
                raw = node.tag in ("script", "style")
                stack.extend(c if isinstance(c, (Element, Comment)) or raw else (_escaped(c),) for c in reversed(node.children))
        return "".join(out)


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _quoted(value: str) -> str:
    value = _escaped(value)
    if '"' in value:
        return f"'{value}'" if "'" not in value else '"' + value.replace('"', "&quot;") + '"'
    return f'"{value}"'


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("[document]")
        #: Open elements by tag, so that an end tag without a start is known without a walk.
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        values = {}
        for k, v in attrs:
            values[k] = v or ""
        for k in MANY_VALUED & values.keys():
            values[k] = " ".join(values[k].split())
        node = Element(tag, values, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        while True:
            node = self.at
            self.open[node.tag] -= 1
            self.at = node.parent
            if node.tag == tag:
                return

    def handle_data(self, data):
        self.at.children.append(data)

    def handle_comment(self, data):
        self.at.children.append(Comment(data))

    def handle_decl(self, decl):
        self.at.children.append(Declaration(decl))

    def handle_pi(self, data):
        self.at.children.append(Instruction(data))

    def parse_marked_section(self, i, report=1):
        """Any <![...> is a declaration, up to the next ">"."""
        end = self.rawdata.find(">", i + 3)
        if end < 0:
            return -1
        self.handle_decl(self.rawdata[i + 2 : end])
        return end + 1


#: Plain markup, which most pages are made of: start tags with quoted attributes, end tags, comments, the document type; each with the text behind it.
_PLAIN = re.compile(
    r"""<(?:
      ([a-zA-Z][a-zA-Z0-9]*+)((?:[ \t\n\r\f]++[a-zA-Z][a-zA-Z0-9_:-]*+(?:="[^"]*+")?+)*+)[ \t\n\r\f]*+(/?)>
    |/([a-zA-Z][a-zA-Z0-9]*+)>
    |!--(?!-?>)((?:[^-]|-(?!-))*+)-->
    |!((?:DOCTYPE|doctype)[^>]*+)>
    )([^<]*+)""",
    re.VERBOSE,
)
_ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9_:-]*+)(?:="([^"]*+)")?+')
#: Elements whose content some parsers read in a mode of its own: the end of those whose content is raw, and of those where any reading of plain text is the same.
_RAW_END = {tag: re.compile(rf"(?i)</{tag}") for tag in ("script", "style")}
_PLAIN_END = {tag: re.compile(rf"(?i)([^<&]*+)(?=</{tag}>)") for tag in ("title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript")}
_unescaped_value = getattr(html_parser, "_unescape_attrvalue", unescape)


def _plain(html: str) -> Element | None:
    """The numbered tree of plain markup, by one pattern for each piece of it; None where any piece is something else."""
    root = at = Element("[document]")
    nodes = [root]
    numbering = root.numbering = Numbering(nodes)
    root.at, open_tags, n, piece = 0, {}, len(html), _PLAIN.match
    i = html.find("<")
    text = html if i < 0 else html[:i]
    if text:
        at.children.append(unescape(text) if "&" in text else text)
    while 0 <= i < n:
        m = piece(html, i)
        if m is None:
            return None
        i = m.end()
        tag, attributes, closed, ended, comment, declared, text = m.groups()
        if tag is not None:
            tag, values = tag.lower(), {}
            if attributes:
                for name, value in _ATTRIBUTE.findall(attributes):
                    name = name.lower()
                    if "&" in value:
                        value = _unescaped_value(value)
                    values[name] = " ".join(value.split()) if name in MANY_VALUED else value
            node = Element(tag, values, at)
            node.numbering, node.at = numbering, len(nodes)
            nodes.append(node)
            at.children.append(node)
            if closed or tag in VOID:
                if tag in _RAW_END or tag in _PLAIN_END:
                    return None
                node.end = len(nodes)
            else:
                at = node
                open_tags[tag] = open_tags.get(tag, 0) + 1
                if tag in _RAW_END:
                    i = m.start(7)
                    end = _RAW_END[tag].search(html, i)
                    if end is None or html[end.end() : end.end() + 1] != ">" or "<!--" in html[i : end.start()]:
                        return None
                    if end.start() > i:
                        node.children.append(html[i : end.start()])
                    i = end.start()
                    continue
                if tag in _PLAIN_END and _PLAIN_END[tag].match(html, m.start(7)) is None or tag == "plaintext":
                    return None
        elif ended is not None:
            tag = ended.lower()
            if open_tags.get(tag):
                while True:
                    node, at = at, at.parent
                    node.end = len(nodes)
                    open_tags[node.tag] -= 1
                    if node.tag == tag:
                        break
        else:
            at.children.append(Declaration(declared) if comment is None else Comment(comment))
        if text:
            at.children.append(unescape(text) if "&" in text else text)
    while at is not None:
        at.end, at = len(nodes), at.parent
    return root


def parse(html: str) -> Element:
    return _plain(html) or parsed_by_tags(html)


def parsed_by_tags(html: str) -> Element:
    """The tree of any markup, by the library's tag parser."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return numbered(builder.root)


def numbered(top: Element) -> Element:
    """top, with all below it numbered in document order."""
    nodes: list[Element] = []
    numbering = Numbering(nodes)
    stack: list[tuple[Element, bool]] = [(top, False)]
    while stack:
        node, done = stack.pop()
        if done:
            node.end = len(nodes)
            continue
        node.numbering, node.at = numbering, len(nodes)
        nodes.append(node)
        below = [(c, False) for c in node.children if isinstance(c, Element)]
        if below:
            stack.append((node, True))
            stack.extend(reversed(below))
        else:
            node.end = len(nodes)
    return top


# -- selectors: tag, .class, #id, [attr], [attr='v'], [attr^='v'], :first-of-type, descendants, lists

_PART = re.compile(r"(?P<tag>^[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>\^?=)'(?P<val>[^']*)')?\]|:(?P<pseudo>first-of-type)")


@lru_cache(maxsize=1024)
def _compiled(selector: str) -> tuple[tuple[tuple[tuple[str, str, str], ...], ...], ...]:
    """Alternatives, each a row of compounds, each a set of (kind, name, value) tests."""
    out = []
    for alternative in selector.split(","):
        row = []
        for compound in alternative.split():
            tests, at = [], 0
            while at < len(compound):
                m = _PART.match(compound[at:]) if at else _PART.match(compound)
                if not m or (m["tag"] and at):
                    raise ValueError(f"selector not understood: {selector}")
                if m["tag"]:
                    tests.append(("tag", m["tag"].lower(), ""))
                elif m["cls"]:
                    tests.append(("class", m["cls"], ""))
                elif m["id"]:
                    tests.append(("is", "id", m["id"]))
                elif m["pseudo"]:
                    tests.append(("first", "", ""))
                else:
                    tests.append(({None: "has", "=": "is", "^=": "starts"}[m["op"]], m["attr"], m["val"] or ""))
                at += m.end()
            row.append(tuple(tests))
        out.append(tuple(row))
    return tuple(out)


def _passes(node: Element, tests) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = node.tag == name
        elif kind == "class":
            ok = name in node.classes
        elif kind == "has":
            ok = name in node.attrs
        elif kind == "is":
            ok = node.attrs.get(name) == value
        elif kind == "starts":
            ok = (node.attrs.get(name) or "").startswith(value) and name in node.attrs
        else:
            ok = node.parent is not None and next(c for c in node.parent.children if isinstance(c, Element) and c.tag == node.tag) is node
        if not ok:
            return False
    return True


def _holds(node: Element, row) -> bool:
    """Whether the last compound holds for the node and the others for ancestors, in order."""
    if not _passes(node, row[-1]):
        return False
    above, k = node.parent, len(row) - 2
    while k >= 0 and above is not None:
        if above.tag != "[document]" and _passes(above, row[k]):
            k -= 1
        above = above.parent
    return k < 0


def matches(node: Element, selector: str) -> bool:
    return any(_holds(node, row) for row in _compiled(selector))


def _candidates(top: Element, tests) -> list[int]:
    """Places below top where a compound may hold, by its most telling test."""
    numbering = top.numbering
    for kind, name, value in tests:
        if kind == "is" and name == "id":
            return within(numbering.ids.get(value, []), top)
    for kind, places in (("class", "classes"), ("tag", "tags")):
        for own, name, _ in tests:
            if own == kind:
                return within(getattr(numbering, places).get(name, []), top)
    for kind, name, _ in tests:
        if kind in ("has", "is", "starts"):
            return [k for k in range(top.at + 1, top.end) if name in numbering.nodes[k].attrs]
    return list(range(top.at + 1, top.end))


def _possible(numbering: Numbering, row) -> bool:
    """Whether the tree has the tags and classes that a row of compounds asks of ancestors."""
    return all(name in (numbering.tags if kind == "tag" else numbering.classes) for tests in row[:-1] for kind, name, _ in tests if kind in ("tag", "class"))


def select(top: Element, selector: str) -> list[Element]:
    if not top.is_numbered:
        return [n for n in top.walk() if matches(n, selector)]
    nodes = top.numbering.nodes
    found = {k for row in _compiled(selector) if _possible(top.numbering, row) for k in _candidates(top, row[-1]) if _holds(nodes[k], row)}
    return [nodes[k] for k in sorted(found)]


def select_one(top: Element, selector: str) -> Element | None:
    if not top.is_numbered:
        return next((n for n in top.walk() if matches(n, selector)), None)
    nodes = top.numbering.nodes
    firsts = [next((k for k in _candidates(top, row[-1]) if _holds(nodes[k], row)), None) for row in _compiled(selector) if _possible(top.numbering, row)]
    first = min((k for k in firsts if k is not None), default=None)
    return None if first is None else nodes[first]


def remove_all(top: Element, selectors: tuple[str, ...]) -> None:
    """Take out whatever is below top and matches one of the selectors, which must not look at ancestors."""
    found = {id(node): node for selector in selectors for node in select(top, selector)}
    parents = {id(node.parent): node.parent for node in found.values()}
    for parent in parents.values():
        parent.children = [c for c in parent.children if id(c) not in found]
    for node in found.values():
        node.parent = None
    if found:
        top.changed()
