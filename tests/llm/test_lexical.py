"""Ranked search against brute force."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    own = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    df = collections.Counter(x for _, t in own for x in set(t))
    merged = collections.defaultdict(list)
    for item, text in items:
        merged[item] += terms(text)
    out = []
    for item, wanted in merged.items():
        scores = []
        for doc, t in own:
            tf, score = collections.Counter(t), 0
            for x in wanted:
                if tf[x]:
                    m = 100 - 75 + (75 * len(t) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def tables(spark, docs, items):
    more = {c: F.lit("x") for c in ("term", "n", "score", "rank", "lot", "times", "block", "at")}
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns(more), spark.createDataFrame(items, "item_id long, text string").withColumns(more)


def case(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join(f"W{int(rng.paretovariate(0.7)) % 200}" for _ in range(n))
    docs = [(i, prose(rng.randrange(1, 80))) for i in range(150)] + [(500, prose(30_000)), (501, None), (502, ""), (503, "--- !?"), (None, "w1 w2"), (None, "w1 w2"), (504, "Éa éa_w1 9w.w1")]
    docs += [(600 + i, "w1 w2 w3") for i in range(15)] + [(600, "w1 w2 w3")] * 2  # ties, repeated rows
    items = [(i, prose(rng.randrange(1, 30))) for i in range(20)] + [(30, "w1 W1 w2"), (31, None), (32, ""), (33, "nothing-known"), (34, "Éa w1 éa"), (35, "w1"), (35, "w3 w1")]
    return docs, items


@pytest.mark.parametrize("index_terms", [lexical.INDEX_TERMS, 40])
def test_search_matches_brute_force(spark, index_terms):
    docs, items = case(1)
    want = brute(docs, items)
    assert found(lexical.search(*tables(spark, docs, items), index_terms=index_terms)) == want
    assert {r[0] for r in want}.isdisjoint({31, 32, 33})


def test_fewer_than_k_and_no_rows(spark):
    docs, items = case(2)
    assert found(lexical.search(*tables(spark, docs, items), k=300)) == brute(docs, items, 300)
    for some, others in (([], items), (docs, []), ([], [])):
        assert found(lexical.search(*tables(spark, some, others))) == []
