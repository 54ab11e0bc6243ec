"""Source divergence audit: how the sources of each lang differ in their use of words.

*Counts.*  Texts are read once, where they lie: a task counts the terms of its texts by source, and the documents that hold each, and gives out a row
for each lang and term whenever what it holds reaches a bound.  These rows are shuffled by lang and term; terms that too few documents of the lang
hold go, and the counts of the others are added up.  No vocabulary is held as a whole, so any number of terms, sources and langs will do.

*Pairs.*  With count 0 a term has a share q0 that is the same for all terms of a source.  A pair's value is therefore V times the
value of two such shares, and what the terms that either source holds differ from that: only entries that are there are looked at.  Sources are dealt into tiles of ``TILE`` and terms
into parts of about ``PART_TERMS``; a task compares the columns of two tiles over the terms of a part, so what it holds is bounded and no pair of
entries becomes a row.

Defined results: null text, lang and source are ''; every (lang, source) that occurs is a group, also without terms; a lang without
kept terms has pairs of value 0 and no terms; a lang of one source has no pairs; repeated rows count each; equal values are ranked by item in the order of UTF-8;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_lots, written

#: Distinct terms, about, that a task holds.
MODEL_TERMS = 500_000
#: Bytes of texts, about, whose terms a task counts before it gives out the sums.
HELD = 32 << 20
#: Terms that a task gives out together.
SUM_TERMS = 8192
#: Sources of a tile, and terms of a part, about.
TILE, PART_TERMS = 64, 4096
#: UTF-8 bytes as those of terms: A-Z small, other ASCII a blank, bytes beyond ASCII kept.
_AS_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_BILLION = 1_000_000_000


def lang_counts(lang: str, terms: list[bytes], sources: list[str], found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """A row for each term: documents with it, occurrences, and those by source; ``found`` has source, distinct terms and occurrences of each document."""
    of, at, n = zip(*found, strict=True)
    source = np.repeat(np.array(of, dtype=np.int64), [len(x) for x in at])
    at, n = np.concatenate(at), np.concatenate(n)
    docs = np.bincount(at, minlength=len(terms))
    key = at * len(sources) + source
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    sums = np.add.reduceat(n[order], first)
    term, source = np.divmod(key[first], len(sources))
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    names = pa.array(sources, pa.string()).take(pa.array(source))
    ends = pa.array(starts, pa.int32())
    return pa.table(
        {
            "lang": pa.array([lang] * len(terms), pa.string()), "term": pa.array(terms, pa.binary()).cast(pa.string()),
            "docs": pa.array(docs, pa.int64()), "lang_n": pa.array(np.add.reduceat(sums, starts[:-1]), pa.int64()),
            "source": pa.ListArray.from_arrays(ends, names), "n": pa.ListArray.from_arrays(ends, pa.array(sums, pa.int64())),
        }
    )


def term_counts(most_terms: int, most_bytes: int, rows: int):
    """Rows of ``lang_counts`` over rows (group, text), in tasks; of a term there are as many as times that counts were given out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given():
            for lang, (terms, sources, found) in langs.items():
                yield from lang_counts(lang, list(terms), list(sources), found).to_batches(max_chunksize=rows)
            langs.clear()

        langs, held, size = defaultdict(lambda: (defaultdict(count().__next__), {}, [])), 0, 0
        for groups, texts in text_lots(batches, 1024, 8 << 20):
            for group, text in zip(groups.to_pylist(), texts, strict=True):
                words = text.translate(_AS_TERMS).split()
                if not words:
                    continue
                terms, sources, found = langs[group["lang"]]
                before = len(terms)
                at, n = np.unique(np.fromiter(map(terms.__getitem__, words), np.int64, len(words)), return_counts=True)
                found.append((sources.setdefault(group["source"], len(sources)), at, n))
                held, size = held + len(terms) - before, size + len(text)
                if held >= most_terms or size >= most_bytes:
                    yield from given()
                    held = size = 0
        yield from given()

    return run


def counted(docs: DataFrame, min_df: int, held_terms: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source) of all groups; lang, source, term, n > 0 and the lang's lang_n of the kept terms' entries.  Both are written."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    groups = written(docs.select(lang, source).distinct(), "groups")
    own = docs.select(F.struct(lang, source).alias("group"), F.make_valid_utf8(text).alias("text"))
    counts = own.mapInArrow(term_counts(held_terms, HELD, SUM_TERMS), "lang string, term string, docs long, lang_n long, source array<string>, n array<long>")
    # Dealt by lang and term once: sums of a lang and those by source need no further exchange.
    in_lang = Window.partitionBy("lang", "term")
    dealt = counts.repartition("lang", "term").withColumn("df", F.sum("docs").over(in_lang)).withColumn("lang_n", F.sum("lang_n").over(in_lang))
    entries = dealt.filter(F.col("df") >= min_df).select("lang", "term", "lang_n", F.inline(F.arrays_zip("source", "n")))
    sums = entries.groupBy("lang", "source", "term", "lang_n").agg(F.sum("n").alias("n"))
    return groups, written(sums.select("lang", "source", "term", "n", "lang_n"), "entries")


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10**9 * (n + 2) / (total + 2 * terms)), exactly; null without terms.  Decimals, which are slow, only where 64 bits may not do."""
    exact = f"CASE WHEN {n} < 9000000000 THEN ({_BILLION}L * ({n} + 2)) div ({total} + 2 * {terms}) ELSE (CAST({_BILLION} AS DECIMAL(38, 0)) * ({n} + 2)) div CAST({total} + 2 * {terms} AS DECIMAL(38, 0)) END"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + {exact} END")


def _value(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def shares(groups: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups with V, their p0 (of count 0), number and tile in the lang, and tiles of the lang; the entries with p and the lang's q."""
    terms = entries.groupBy("lang").agg(F.count_distinct("term").alias("v"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = groups.join(terms, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["v", "total"])
    own = Window.partitionBy("lang")
    numbered = named.withColumn("no", F.row_number().over(own.orderBy("source")) - 1).withColumn("sources", F.count(F.lit(1)).over(own)).withColumn("lang_total", F.sum("total").over(own))
    numbered = numbered.withColumn("p0", _share("0", "total", "v")).withColumn("tile", F.expr(f"no div {TILE}")).withColumn("tiles", F.expr(f"(sources + {TILE - 1}) div {TILE}"))
    numbered = written(numbered, "shares")
    full = entries.join(numbered.select("lang", "source", "no", "tile", "tiles", "v", "total", "lang_total"), ["lang", "source"])
    full = full.withColumn("p", _share("n", "total", "v")).withColumn("q", _share("lang_n", "lang_total", "v"))
    return numbered, written(full.select("lang", "source", "term", "no", "tile", "tiles", "v", "p", "q"), "entry-shares")


def tile_differences(key, left, right):
    """Two tiles over the terms of a part: how each pair's value differs from that of V terms with count 0.

    ``left`` holds the entries of both tiles, ``right`` the sources of both (no, tile, p0).
    """
    _, low, high, _ = (k.as_py() for k in key)
    no, tile, p0 = (np.asarray(right.column(c), dtype=np.int64) for c in ("no", "tile", "p0"))
    row, p = (np.asarray(left.column(c), dtype=np.int64) for c in ("no", "p"))
    term = np.asarray(left.column("term").combine_chunks().dictionary_encode().indices, dtype=np.int64)
    sides = []
    for t in (low, high):
        mine = np.argsort(no[tile == t])
        own, zero = no[tile == t][mine], p0[tile == t][mine]
        share = np.tile(zero, (int(term.max()) + 1, 1))
        at = np.minimum(np.searchsorted(own, row), len(own) - 1)
        hit = own[at] == row
        share[term[hit], at[hit]] = p[hit]
        sides.append((own, zero, share))
    (a_no, a_zero, a), (b_no, b_zero, b) = sides
    out = []
    for k in range(len(a_no)):
        f = (a[:, k : k + 1] - b) ** 2 // (a[:, k : k + 1] + b)
        zero = (a_zero[k] - b_zero) ** 2 // (a_zero[k] + b_zero)
        out.append((f - zero).sum(axis=0))
    values = np.array(out).ravel()
    one, two = np.repeat(a_no, len(b_no)), np.tile(b_no, len(a_no))
    if low != high:  # both directions; within a tile both are there
        one, two, values = np.concatenate([one, two]), np.concatenate([two, one]), np.concatenate([values, values])
    other = one != two
    lang = pa.array([key[0].as_py()] * int(other.sum()), pa.string())
    return pa.table({"lang": lang, "no": one[other], "other": two[other], "more": values[other]})


def pair_values(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the lang), value."""

    def dealt(rows: DataFrame) -> DataFrame:
        """Each row for every tile that its own is compared with."""
        out = rows.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        return out.withColumn("low", F.least("tile", "to")).withColumn("high", F.greatest("tile", "to"))

    parts = F.expr(f"1 + v div {PART_TERMS}")
    held = dealt(entries).select("lang", "low", "high", F.pmod(F.xxhash64("term"), parts).alias("part"), "no", "term", "p")
    sources = dealt(groups.filter("v > 0")).select("lang", "low", "high", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "no", "tile", "p0")
    key = ["lang", "low", "high", "part"]
    present = sources.join(held.select(*key).distinct(), key, "left_semi")
    more = held.groupBy(*key).cogroup(present.groupBy(*key)).applyInArrow(tile_differences, "lang string, no long, other long, more long")
    more = more.groupBy("lang", "no", "other").agg(F.sum("more").alias("more"))
    one = groups.select("lang", "source", "no", "v", "p0")
    two = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("other"), F.col("p0").alias("q0"))
    pairs = one.join(two, "lang").filter("no != other").join(more, ["lang", "no", "other"], "left")
    value = F.when(F.col("v") > 0, F.col("v") * _value("p0", "q0") + F.coalesce("more", F.lit(0))).otherwise(F.lit(0).cast("long"))
    return pairs.select("lang", "source", "item", value.alias("value"))


def audit(docs: DataFrame, min_df: int = 10, top: int = 10, model_terms: int = MODEL_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank from 1 in each group and part; ``model_terms`` bounds what a task holds."""
    groups, entries = counted(docs, min_df, model_terms)
    groups, entries = shares(groups, entries)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pair_values(groups, entries).withColumn("rank", F.row_number().over(order))
    terms = entries.filter("p > q").select("lang", "source", F.col("term").alias("item"), _value("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(terms.withColumn("part", F.lit("term")).select(*out))
