"""Nearest neighbours over many lists: recall against brute force, repeated ids, sizes of lists."""

import collections

import numpy as np
from pyspark.sql import functions as F

from pagequarry.llm import ann


def neighbours(df, **options):
    got = collections.defaultdict(list)
    for r in ann.search(df, **options).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return {q: [(v, s) for _, v, s in sorted(found)] for q, found in got.items()}


def test_recall_over_many_lists(spark, monkeypatch):
    """Clustered vectors in 30 lists; sub-lists and blocks are cut, too."""
    monkeypatch.setattr(ann, "LIST_ROWS", 100)
    monkeypatch.setattr(ann, "SUB_ROWS", 60)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(8)
    n, d = 3000, 24
    points = (3 * rng.standard_normal((40, d))[rng.integers(0, 40, n)] + rng.standard_normal((n, d))).astype(np.float32)
    points[1000:2000] = points[1000] + 0.5 * rng.standard_normal((1000, d)).astype(np.float32)  # a third of all rows lie together
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>").withColumn("list", F.lit("x")).repartition(4)
    assert ann.list_count(n) == 30
    probed = []
    real = ann.measured_probes
    monkeypatch.setattr(ann, "measured_probes", lambda *a, **k: probed.append(real(*a, **k)) or probed[-1])
    got = neighbours(df)
    wide, hits, total = points.astype(np.float64), 0, 0
    assert set(got) == set(range(0, n, 100))
    for q, found in got.items():
        away = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        away[q] = np.inf
        best = set(np.argsort(away, kind="stable")[:10].tolist())
        hits, total = hits + len(best & {v for v, _ in found}), total + 10
        assert len(found) == 10 and all(abs(s - away[v]) < 1e-9 for v, s in found)
    assert hits / total >= 0.9 and 1 <= probed[0] < 30, (hits, total, probed)
    everywhere = neighbours(df, probes=30)
    for q, found in everywhere.items():  # all lists: the bounds lose nothing but rare cases
        away = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        away[q] = np.inf
        assert abs(found[-1][1] - np.sort(away)[9]) < 1e-9


def test_repeated_ids_are_candidates_each_and_one_query(spark):
    rows = [(0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (1, [0.0, 3.0]), (1, [0.0, 3.0]), (2, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(v, round(s, 6)) for v, s in neighbours(df)[0]] == [(1, 1.0), (1, 2.0), (1, 2.0), (2, 6.403124)]


def test_lists_grow_with_the_table():
    counts = [ann.list_count(n) for n in (0, 10, 2_000, 2_000_000, 10**8, 10**9, 10**12)]
    assert counts == sorted(counts) and counts[:3] == [1, 1, 1] and counts[3] == 1000 and counts[4] == 40_000 and counts[-1] == ann.SAMPLE // 4


def test_queries_of_small_lists_find_k(spark):
    """Two queries far from all others, each with a list of its own or nearly so."""
    rng = np.random.default_rng(9)
    rows = [(k + 1000, (rng.normal(0, 1, 8) + 20 * (k % 25)).tolist()) for k in range(2500) if (k + 1000) % 100]
    rows += [(100, [900.0] * 8), (100, [900.5] * 8), (200, [-700.0] * 8), (201, [-701.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df, k=10, probes=1).collect()
    for q, vector in ((100, [900.0] * 8), (200, [-700.0] * 8)):
        mine = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert len(mine) == 10 and q not in mine
    assert [r["vec_id"] for r in found if r["query_id"] == 200 and r["rank"] == 1] == [201]
