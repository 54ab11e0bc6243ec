"""The audit of sources against brute force."""

import collections
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_df, top):
    own = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {x for x, _, _ in own}:
        mine = [(s, t) for x, s, t in own if x == lang]
        df = collections.Counter(w for _, t in mine for w in set(t))
        kept = {w for w, n in df.items() if n >= min_df}
        groups = collections.defaultdict(collections.Counter)
        for s, t in mine:
            groups[s].update(w for w in t if w in kept)
        share = lambda c: {w: 1 + (10**9 * (c[w] + 2)) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), collections.Counter()))
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in groups:
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in groups if o != s]
            terms = [(f(p[s][w], q[w]), w) for w in kept if groups[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def table(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("terms", "term", "n", "no", "tile", "v", "p0", "counts", "folder", "part", "rank", "doc_id")})


def found(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def case(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdé" for b in "vwxyzÜ"] + ["Upper", "don't", "a9b"]
    rows = []
    for lang, n in (("en", 120), ("de", 60), (None, 25), ("x", 3)):
        for _ in range(n):
            s = rng.choice(["s1", "s2", "S3", None, "é", "s10"])
            rows.append((" ".join(rng.choice(words[: 10 + 5 * len(s or "")]) for _ in range(rng.randrange(0, 12))), lang, s))
    return rows + [(None, "en", "only null"), ("", "en", "s1"), ("1 2 3", "de", "none"), ("lonely", "yy", "one"), ("av " * 5000, "en", "long")] + [rows[0]] * 3


@pytest.mark.parametrize(("tile", "part_terms", "model_terms"), [(64, 4096, 10**6), (2, 3, 10**6), (2, 5, 0)])
def test_audit_matches_brute_force(spark, monkeypatch, tile, part_terms, model_terms):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "PART_TERMS", part_terms)
    monkeypatch.setattr(divergence, "SUM_TERMS", 8192 if tile > 2 else 4)
    monkeypatch.setattr(divergence, "HELD", 1 << 26 if tile > 2 else 100)
    rows = case(1)
    assert found(divergence.audit(table(spark, rows), min_df=10, top=4, model_terms=model_terms)) == brute(rows, 10, 4)


def test_no_kept_terms_and_no_rows(spark):
    rows = case(2)[-40:]
    assert found(divergence.audit(table(spark, rows), min_df=1000)) == brute(rows, 1000, 10)
    assert found(divergence.audit(table(spark, []))) == []


def test_texts_are_read_once_and_a_task_gives_out_a_row_for_each_term(spark, monkeypatch):
    texts = ["b A a", "", "a c"] * 50
    batch = pa.RecordBatch.from_pylist([{"group": {"lang": "en", "source": f"s{k % 2}"}, "text": text} for k, text in enumerate(texts)])
    rows = pa.Table.from_batches(divergence.term_counts(1000, 1 << 20, 2)(iter([batch]))).to_pylist()
    assert [(r["term"], r["docs"], r["lang_n"], sorted(zip(r["source"], r["n"], strict=True))) for r in sorted(rows, key=lambda r: r["term"])] == [
        ("a", 100, 150, [("s0", 75), ("s1", 75)]), ("b", 50, 50, [("s0", 25), ("s1", 25)]), ("c", 50, 50, [("s0", 25), ("s1", 25)]),
    ]
    assert len(list(divergence.term_counts(0, 1 << 20, 2)(iter([batch])))) > len(rows)
    kept, write = [], divergence.written
    monkeypatch.setattr(divergence, "written", lambda df, *label, **by: kept.append(df.dtypes) or write(df, *label, **by))
    divergence.audit(table(spark, case(3)))
    assert kept and not [name for types in kept for name, kind in types if kind.startswith("array")]


@pytest.mark.parametrize("n", [0, 8_999_999_999, 9_000_000_000, 10**15])
def test_shares_are_exact_on_both_sides_of_64_bits(spark, n):
    df = spark.createDataFrame([(n, 3 * n + 7, 11, 0)], "n long, total long, v long, none long")
    own, none = df.select(divergence._share("n", "total", "v"), divergence._share("n", "total", "none")).first()
    assert (own, none) == (1 + 10**9 * (n + 2) // (3 * n + 7 + 22), None)


def test_texts_that_are_not_utf8_do_not_stop_the_audit(spark):
    rows = spark.range(12).selectExpr("cast(concat(unhex('C3'), cast(' word' AS binary)) AS string) AS text", "'en' AS lang", "concat('s', id % 2) AS source")
    assert {(r[3], r[4]) for r in found(divergence.audit(rows))} == {("s0", 0), ("s1", 0)}
