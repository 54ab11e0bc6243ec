"""Registering queries, and pieces of SQL that several of them need."""

from __future__ import annotations

from collections.abc import Callable

from pagequarry.functions import rules

URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def put(function):
            self.queries[function.__name__] = function
            if sql is not None:
                self.sql[function.__name__] = sql
            return function

        return put


def read(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- SQL


def part(url: str, k: int) -> str:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment."""
    return f"regexp_extract({url}, '{URL}', {k})"


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def stripped(text: str) -> str:
    """Without white space at both ends."""
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def decoded(text: str) -> str:
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return text


def likely(url: str) -> str:
    p = part(url, 3)
    return (
        f"CASE WHEN regexp_matches({p}, '(?i){any_of(rules.RELEVANT_PATHS)}') THEN true "
        f"WHEN regexp_matches({p}, '(?i){any_of(rules.IRRELEVANT_PATHS)}') THEN false "
        f"ELSE len(list_filter(string_split({p}, '/'), lambda x: x <> '')) > 1 END"
    )


def follow(url: str, base: str, text: str) -> str:
    barred = " OR ".join(f"contains(lower({text}), '{w}')" for w in rules.UNFOLLOWED_TEXTS)
    return (
        f"({part(url, 2)} = {part(base, 2)} AND NOT regexp_matches(lower({part(url, 3)}), '{rules.ASSET_EXTENSIONS}') AND NOT ({barred}) "
        f"AND NOT ({part(url, 3)} = '' AND {part(url, 5)} <> '') AND ({part(url, 4)} = '' OR regexp_matches({part(url, 4)}, '{rules.VERSION_QUERY}')))"
    )


def depth(url: str) -> str:
    p = f"regexp_replace({part(url, 3)}, '^/+|/+$', '', 'g')"
    return f"CASE WHEN {p} = '' THEN 0 ELSE len(string_split({p}, '/')) END::INTEGER"


#: page_id, page_url, pos, href, text of the anchors in nav, by regular expressions.
NAV = r"""nav AS (SELECT page_id, url AS page_url, regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1) AS h FROM pages),
anchors AS (SELECT page_id, page_url, unnest(regexp_extract_all(h, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(h, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text, generate_subscripts(regexp_extract_all(h, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS pos FROM nav),
cand AS (SELECT page_id, page_url, pos, DECODED AS text, lower(SCHEME) || '://' || HOST || href AS url FROM anchors WHERE href <> '' AND href <> '#' AND NOT starts_with(href, 'javascript:')),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS nth FROM cand) WHERE nth = 1)""".replace(
    "DECODED", decoded(stripped("text"))
).replace("SCHEME", part("page_url", 1)).replace("HOST", part("page_url", 2))
