"""URL columns: parts, resolution, site keys and link predicates, all as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

#: Scheme, authority, path, query and fragment of a URL reference.
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), _URL, 1))


def netloc(url) -> Column:
    return F.regexp_extract(_c(url), _URL, 2)


def path(url) -> Column:
    return F.regexp_extract(_c(url), _URL, 3)


def query(url) -> Column:
    return F.regexp_extract(_c(url), _URL, 4)


def fragment(url) -> Column:
    return F.regexp_extract(_c(url), _URL, 5)


def with_scheme(url) -> Column:
    """https:// before URLs without a scheme."""
    return F.when(_c(url).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), _c(url)).otherwise(F.concat(F.lit("https://"), _c(url)))


def _any(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def path_depth(url) -> Column:
    """Segments of the path between its outer slashes; 0 for the root."""
    trimmed = F.regexp_replace(path(url), "^/+|/+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "/", -1)))


# Schemes under which references are relative, and of these the one without an authority.
RELATIVE_SCHEMES = ("", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss")
#: Schemes whose last path segment may have parameters behind a semicolon.
PARAMETER_SCHEMES = ("", "ftp", "http", "prospero", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu", "mms", "sftp")


def _named(text: Column, at: int) -> Column:
    return F.regexp_extract(text, _URL, at)


def _cleaned(reference: Column) -> Column:
    """Without leading control signs and blanks, tabs and line ends."""
    return F.regexp_replace(F.regexp_replace(reference, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it: plans stay small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parts(reference: Column) -> Column:
    """scheme, authority, path, parameters (behind the first semicolon of the last segment), query and fragment of a reference."""
    split = r"^((?:[^/]*/)*[^/;]*)(?:;([^/]*))?$"

    def named(t: Column) -> Column:
        return F.struct(F.lower(_named(t, 1)).alias("scheme"), *(_named(t, k).alias(n) for k, n in ((2, "authority"), (3, "path"), (4, "query"), (5, "fragment"))))

    return _bound(_bound(_cleaned(reference), named), lambda p: F.struct(*(p[n].alias(n) for n in ("scheme", "authority", "query", "fragment")), p["path"].alias("whole"), F.regexp_extract(p["path"], split, 1).alias("path"), F.regexp_extract(p["path"], split, 2).alias("parameters")))


def _split_path(p: Column, scheme: Column) -> tuple[Column, Column]:
    """Path and parameters; without parameters where the scheme has none."""
    has = scheme.isin(*PARAMETER_SCHEMES)
    return F.when(has, p["path"]).otherwise(p["whole"]), F.when(has, p["parameters"]).otherwise("")


def without_dots(segments: Column) -> Column:
    """The segments after "." is dropped and ".." has taken the one before it away: a stack folded over them."""
    pushed = lambda held, s: F.when(s == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).when(s == ".", held).otherwise(F.concat(held, F.array(s)))
    return F.aggregate(segments, F.array().cast("array<string>"), pushed)


def _unsplit(scheme: Column, authority: Column, path: Column, parameters: Column, query_: Column, fragment_: Column) -> Column:
    whole = F.concat(path, F.when(parameters != "", F.concat(F.lit(";"), parameters)).otherwise(""))
    rooted = F.when((whole != "") & ~whole.startswith("/"), F.concat(F.lit("/"), whole)).otherwise(whole)
    empty = (scheme != "") & ((whole == "") | whole.startswith("/"))  # all relative schemes have an authority, if an empty one
    placed = F.when(authority != "", F.concat(F.lit("//"), authority, rooted)).when(whole.startswith("//") | empty, F.concat(F.lit("//"), whole)).otherwise(whole)
    out = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), placed)
    out = F.concat(out, F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(""))
    return F.concat(out, F.when(fragment_ != "", F.concat(F.lit("#"), fragment_)).otherwise(""))


def join(base, href) -> Column:
    """The reference href resolved against base (RFC 3986, with empty segments inside a relative path dropped); JVM-side.

    Null where either is null or an authority has one bracket without the other.
    """
    b, h = _c(base), _c(href)

    def against(both: Column) -> Column:
        base_, own = both["base"], both["own"]
        scheme = F.when(own["scheme"] == "", base_["scheme"]).otherwise(own["scheme"])
        bp, bw = _split_path(base_, base_["scheme"])
        hp, hw = _split_path(own, scheme)
        named = F.struct(
            base_["scheme"].alias("bs"), base_["authority"].alias("bn"), bp.alias("bp"), bw.alias("bw"), base_["query"].alias("bq"),
            scheme.alias("hs"), own["authority"].alias("hn"), hp.alias("hp"), hw.alias("hw"), own["query"].alias("hq"), own["fragment"].alias("hf"),
        )
        return _bound(named, _resolved)

    def _resolved(p: Column) -> Column:
        same = (p["hs"] == p["bs"]) & p["hs"].isin(*RELATIVE_SCHEMES)
        one_bracket = F.lit(False)
        for authority in (p["bn"], p["hn"]):
            one_bracket = one_bracket | (F.contains(authority, F.lit("[")) != F.contains(authority, F.lit("]")))
        itself = (p["hp"] == "") & (p["hw"] == "")
        # Which parts the answer has; its path is resolved last.
        whole = F.struct(
            p["hs"].alias("scheme"),
            F.when(p["hn"] != "", p["hn"]).otherwise(p["bn"]).alias("authority"),
            F.when(p["hn"] != "", p["hp"]).when(itself, p["bp"]).otherwise(_merged(p["bp"], p["hp"])).alias("path"),
            F.when((p["hn"] == "") & itself, p["bw"]).otherwise(p["hw"]).alias("parameters"),
            F.when((p["hn"] == "") & itself & (p["hq"] == ""), p["bq"]).otherwise(p["hq"]).alias("query"),
            p["hf"].alias("fragment"),
        )
        built = _bound(whole, lambda w: _unsplit(*(w[n] for n in ("scheme", "authority", "path", "parameters", "query", "fragment"))))
        return F.when(~one_bracket, F.when(same, built).otherwise(F.lit("\u0000")))  # of another scheme: the reference as it is

    found = _bound(F.struct(_parts(b).alias("base"), _parts(h).alias("own")), against)
    answer = _bound(found, lambda x: F.when(x == "\u0000", h).otherwise(x))
    return F.when(b == "", h).when(h == "", b).when(b.isNotNull() & h.isNotNull(), answer)


def _merged(base_path: Column, path: Column) -> Column:
    """The path behind the base's last slash (or from the root), without dots; / for nothing."""

    def resolved(segments: Column) -> Column:
        last = F.element_at(segments, -1).isin(".", "..")
        joined = F.array_join(F.concat(without_dots(segments), F.when(last, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/")
        return _bound(joined, lambda j: F.when(j == "", "/").otherwise(j))

    def inner(both: Column) -> Column:
        return F.filter(both, lambda s, i: (i == 0) | (i == F.size(both) - 1) | (s != ""))

    # The base's segments without its last one (an empty one stays).
    kept = _bound(F.split(base_path, "/", -1), lambda x: F.when(F.element_at(x, -1) != "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))
    segments = F.when(path.startswith("/"), F.split(path, "/", -1)).otherwise(_bound(F.concat(kept, F.split(path, "/", -1)), inner))
    return _bound(segments, resolved)


def join_rooted(base, href) -> Column:
    """urljoin where href starts with a slash and has no dot segments: JVM-side."""
    return F.concat(scheme(base), F.lit("://"), netloc(base), _c(href))


def site_key(url) -> Column:
    """The last two labels of the authority (port kept), or the authority if it has fewer."""
    return F.substring_index(netloc(url), ".", -2)


def same_site(url, base) -> Column:
    two = F.size(F.split(netloc(url), r"\.")) >= 2
    two_base = F.size(F.split(netloc(base), r"\.")) >= 2
    return (netloc(url) == netloc(base)) | (two & two_base & (site_key(url) == site_key(base)))


def should_follow(url, current, text) -> Column:
    """Generic strategy: same authority, no asset, no account or shop text, no bare fragment, no query but a version."""
    t = F.lower(_c(text))
    barred = F.lit(False)
    for word in rules.UNFOLLOWED_TEXTS:
        barred = barred | t.contains(word)
    return (
        (netloc(url) == netloc(current))
        & ~F.lower(path(url)).rlike(rules.ASSET_EXTENSIONS)
        & ~F.coalesce(barred, F.lit(False))
        & ~((path(url) == "") & (fragment(url) != ""))
        & ((query(url) == "") | query(url).rlike(rules.VERSION_QUERY))
    )


def excluded(href) -> Column:
    """Wiki strategy: edit, history, account and similar links."""
    return _c(href).rlike(_any(rules.WIKI_EXCLUDED_LINKS))


def looks_like_doc(href, text, base) -> Column:
    inside = (netloc(href) == "") | (netloc(href) == netloc(base))
    outside = _c(href).rlike(_any(rules.WIKI_DOC_LINKS)) | _c(text).rlike("(?i)" + _any(rules.WIKI_DOC_TEXTS))
    return F.when(inside, ~_c(href).startswith("#") & ~excluded(href)).otherwise(outside)


def wiki_should_follow(url, current, text) -> Column:
    """Wiki strategy's own follow predicate."""
    foreign = (netloc(url) != "") & (netloc(url) != netloc(current))
    bare = (path(url) == "") & (fragment(url) != "") & (path(current) == "")
    return ~excluded(url) & ~foreign & ~bare & looks_like_doc(url, text, current)


def likely_documentation(url) -> Column:
    """On the path only, in any case: documentation patterns win over excluded ones; else more than one segment."""
    p = path(url)
    segments = F.size(F.array_remove(F.split(p, "/", -1), ""))
    return F.when(p.rlike("(?i)" + _any(rules.RELEVANT_PATHS)), True).when(p.rlike("(?i)" + _any(rules.IRRELEVANT_PATHS)), False).otherwise(segments > 1)


def wiki_link_priority(text, href, depth, active, heading) -> Column:
    """Points of a wiki navigation link."""
    t, h, d = F.lower(_c(text)), F.lower(_c(href)), _c(depth)
    entry, old = F.lit(False), F.lit(False)
    for w in rules.ENTRY_WORDS:
        entry = entry | t.contains(w) | h.contains(w)
    for w in rules.OLD_WORDS:
        old = old | t.contains(w)
    return (
        F.lit(5)
        + F.when(d == 0, 3).when(d == 1, 2).otherwise(-d)
        + F.when(_c(active), 3).otherwise(0)
        + F.when(_c(heading), 2).otherwise(0)
        + F.when(entry, 2).otherwise(0)
        - F.when(old, 3).otherwise(0)
    )


def glob_filter(url, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """An extension: keep URLs that match some include glob (if any) and no exclude glob."""

    def any_of(globs):
        out = F.lit(False)
        for g in globs:
            out = out | _c(url).rlike("^" + "".join(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if not ch.isalnum() else ch for ch in g) + "$")
        return out

    keep = any_of(include) if include else F.lit(True)
    return keep & ~any_of(exclude) if exclude else keep


def title_from_url(url) -> Column:
    """The last path segment in capitalised words; for a root the first label of the host."""
    trimmed = F.regexp_replace(path(url), "^/+|/+$", "")
    words = F.filter(F.split(F.translate(F.element_at(F.split(trimmed, "/", -1), -1), "-_", "  "), r"\s+", -1), lambda w: w != "")
    named = F.array_join(F.transform(words, capitalized), " ")
    return F.when(trimmed == "", capitalized(F.substring_index(netloc(url), ".", 1))).otherwise(named)


def capitalized(word: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 2147483647)))


def project_name(url) -> Column:
    """The first host label, or the second after www."""
    labels = F.split(netloc(url), r"\.")
    return capitalized(F.when((F.get(labels, F.lit(0)) == "www") & (F.size(labels) > 1), F.get(labels, F.lit(1))).otherwise(F.get(labels, F.lit(0))))
