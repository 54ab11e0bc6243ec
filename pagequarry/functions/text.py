"""Text columns: names, anchors, keys, markdown clean-up, checks of content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(text) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def sanitized_filename(name) -> Column:
    r"""Each of <>:"/\|?* becomes _; trimmed, cut to 100 characters; empty becomes untitled."""
    out = F.substring(stripped(F.regexp_replace(_c(name), r'[<>:"/\\|?*]', "_")), 1, 100)
    return F.when(out == "", F.lit("untitled")).otherwise(out)


def anchor(text) -> Column:
    """Lower case, blanks and other signs to single dashes, none at the ends."""
    dashed = F.regexp_replace(F.replace(F.lower(_c(text)), F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}_-]", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^-+|-+$", "")


def token_estimate(text) -> Column:
    return F.floor(F.length(_c(text)) / 4)


def content_cache_key(text, mode) -> Column:
    """First and last 100 characters, mode and length."""
    t = _c(text)
    return F.concat(F.substring(t, 1, 100), F.when(F.length(t) <= 100, t).otherwise(F.substring(t, -100, 100)), _c(mode), F.length(t).cast("string"))


def link_cache_key(url, page_url) -> Column:
    return F.concat_ws("|", _c(url), _c(page_url))


def page_number(n) -> Column:
    """At least three digits."""
    s = _c(n).cast("string")
    return F.lpad(s, F.greatest(F.lit(3), F.length(s)), F.lit("0"))


def clean_title(title) -> Column:
    """What stands before " | ", or else before " - "."""
    t = _c(title)
    return stripped(F.when(F.instr(t, " | ") > 0, F.substring_index(t, " | ", 1)).otherwise(F.substring_index(t, " - ", 1)))


def without_suffix(title) -> Column:
    """Without a trailing site or section name of wiki titles."""
    # The names.
    return F.regexp_replace(F.regexp_replace(_c(title), r"\s*[-|]\s*DeepWiki$", ""), r"\s*[-|]\s*Documentation$", "")


def class_language(classes) -> Column:
    """language- or lang- prefix of a class list, as ``content.class_language`` reads it for Markdown and content alike."""
    return F.regexp_extract(_c(classes), r"(?:^|\s)(?:language|lang)-([^-\s]*)", 1)


def markdown_postprocessed(md) -> Column:
    """Five passes: blank lines, fences, heading marks from six down to one, fence languages, lists."""
    out = F.regexp_replace(_c(md), r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"```\s+```", "```\n```")
    for k in range(6, 0, -1):
        out = F.regexp_replace(out, f"#{{{k}}}([^\\s#])", "#" * k + " $1")
    out = F.regexp_replace(out, r"```[ \t]+([a-zA-Z0-9]+)", "```$1")
    return F.regexp_replace(out, r"(\n[*-] [^\n]+)\n([^\n*-])", "$1\n\n$2")


def stripped_text(html) -> Column:
    """get_text of markup without scripts: strings stripped one by one and joined; four entities decoded."""
    out = stripped(F.regexp_replace(_c(html), r"\s*<[^>]*>\s*", ""))
    return decoded(out)


def decoded(text) -> Column:
    out = _c(text)
    # The entities that the pages use; the ampersand last.
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def looks_like_html(text) -> Column:
    return _c(text).rlike(r"^\s*<") & F.contains(_c(text), F.lit("</"))


def content_warnings(text) -> Column:
    """Warnings for content to process: html without html or body, one very long line."""
    t = _c(text)
    whole = F.lower(t)
    no_body = looks_like_html(t) & ~F.contains(whole, F.lit("<html")) & ~F.contains(whole, F.lit("<body"))
    one_line = ~F.contains(t, F.lit("\n")) & (F.length(t) > 500)
    return F.array_compact(F.array(F.when(no_body, F.lit("fragment")), F.when(one_line, F.lit("single_line"))))
