"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .license_scan import TEMPLATES
from .quality_rules import RULES

_WORDS7 = r"[^\x20\x09-\x0D]+"
_BAD = " ".join(f"+ CASE WHEN {cond} THEN {1 << b} ELSE 0 END" for b, (_, cond) in enumerate(RULES))

QUALITY = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '{_WORDS7}') AS ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{_WORDS7}')) AS ls FROM t),
p AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, ws FROM w),
g AS (SELECT doc_id, i, ws[i:i+4] AS five FROM p WHERE i + 4 <= len(ws)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM g) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0)::BIGINT AS word_chars,
 (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
 coalesce(n, 0)::BIGINT AS n_repeat_words, (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')))::BIGINT AS n_capitals, (length(x) - length(replace(x, '!', '')))::BIGINT AS n_bangs
 FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, (0 {_BAD})::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, failed_bits = 0 AS kept, failed_bits, n_lines, n_capitals, n_bangs FROM b
"""


def _license() -> str:
    parts = []
    for k, t in enumerate(TEMPLATES):
        words = t.words
        low, high = t.key or (0, len(words))
        key = "[" + ", ".join(f"'{w}'" for w in words[low:high]) + "]"
        agree = " + ".join(f"(coalesce(ws[i + {j}], '') = '{w}')::INT" for j, w in enumerate(words)) if high - low < len(words) else str(len(words))
        parts.append(
            f"SELECT doc_id, {k} AS t, '{t.label}' AS label, {str(t.base).lower()} AS base, i - 1 AS start, ({agree}) / {len(words)}.0::DOUBLE AS share "
            f"FROM (SELECT doc_id, ws, generate_subscripts(ws, 1) - {low} AS i FROM hit WHERE list_has_all(ws, {key})) WHERE i >= 1 AND ws[i+{low}:i+{high - 1}] = {key} AND ({agree}) / {len(words)}.0 >= {t.least}"
        )
    found = " UNION ALL ".join(parts)
    return f"""
WITH hit AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
f AS ({found}),
a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY 1)
SELECT h.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM hit h LEFT JOIN a USING (doc_id)
"""


LICENSE = _license()

NEIGHBOURS = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 100 = 0),
d AS (SELECT query_id, vec_id, sqrt(list_sum(list_transform(list_zip(e, qe), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM q JOIN v ON vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""



def _near(size: int, percent: int, rest: str) -> str:
    """Components over links of shingle sets; ``rest`` ends the query over w (doc_id, ws), n (sizes), k (components), c (classes)."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - {size - 1}) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, ws[i:i+{size - 1}] AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1),
c AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY ws) END AS class_id FROM w)
{rest}
"""


NEAR_DUPLICATES = _near(5, 80, "SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, class_id FROM w LEFT JOIN n USING (doc_id) JOIN k USING (doc_id) JOIN c USING (doc_id)")
SKETCHED = _near(3, 85, "SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)")

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LEXICAL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY 1, 2),
a AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d),
u AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM t) GROUP BY 1, 2, 3),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, a GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score FROM t JOIN f USING (term) JOIN w USING (term), a GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""

DIVERGENCE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
u AS (SELECT lang, source, unnest(ws) AS term FROM d),
o AS (SELECT lang, unnest(list_distinct(ws)) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
e AS (SELECT lang, source, term, count(*) AS n FROM u JOIN k USING (lang, term) GROUP BY 1, 2, 3),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN e USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM c JOIN v USING (lang)),
m AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM m JOIN v USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM y UNION ALL SELECT * FROM z))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""

SQL = {
    "op6_license_scan": LICENSE,
    "op7_quality_rules": QUALITY,
    "op8_nearest_neighbours": NEIGHBOURS,
    "op9_jaccard_join": NEAR_DUPLICATES,
    "op11_setsketch_near_dedup": SKETCHED,
    "op12_lexical_search": LEXICAL,
    "op13_source_divergence": DIVERGENCE,
}
