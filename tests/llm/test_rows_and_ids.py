"""Null and repeated ids: rows are what is joined, packed and sharded, not ids."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import jaccard_join, packing, shard

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(4)


def prose(rng, n=40, vocabulary=10**6):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_no_text_is_lost_with_its_id(spark):
    rng = random.Random(1)
    a, b, c, d, e = (prose(rng) for _ in range(5))
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, b), (2, c), (3, c), (3, d), (4, near), (5, e), (5, e), (None, a), (None, a), (6, ""), (6, ""), (6, None), (7, " ")]
    docs = table(spark, rows).withColumns({x: F.lit("x") for x in ("goes", "sequence_key", "k1", "listed_id", "best", "times", "component_id")})
    found = jaccard_join.near_duplicates(docs)
    by = collections.Counter((r["doc_id"], r["component_id"]) for r in found.collect())
    assert by == {(1, 1): 2, (2, 2): 1, (3, 2): 1, (3, 3): 1, (4, 1): 1, (5, 5): 1, (None, None): 1, (6, 6): 1, (7, 7): 1}
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (2, c), (3, d), (5, e), (None, a), (None, a), (6, ""), (7, " ")], key=repr)


def test_a_repeated_id_of_several_texts_links_each_text(spark):
    rng = random.Random(2)
    texts = [prose(rng, 60) for _ in range(30)]
    changed = [t.rsplit(" ", 1)[0] + " x" for t in texts]
    docs = table(spark, [(8, t) for t in texts] + [(100 + k, t) for k, t in enumerate(changed)])
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()} == {(8, 8)} | {(100 + k, 8) for k in range(30)}
    # 30 components that share their least id: of each one row stays, the one with that id.
    assert sorted(r["text"] for r in jaccard_join.one_of_each(docs).collect()) == sorted(texts)


@pytest.mark.parametrize("ids", ["null", "one"])
def test_slices_are_bounded_whatever_the_ids(spark, ids):
    rows = [(None if ids == "null" else 5, 0, 0, 100 + k % 900, k % 3) for k in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    packed = packing.pack(pieces, capacity=1000, slice_pieces=300).collect()
    assert len(packed) == 3000
    slices = collections.Counter(r["sequence_id"] >> 40 for r in packed)
    assert len(slices) == 10 and max(slices.values()) < 400
    fill = collections.defaultdict(list)
    for r in packed:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1000


def test_sequences_of_null_and_repeated_ids_hold_their_own_ids(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, [(None, "one two three"), (None, "four"), (3, "five six"), (3, "seven"), (3, "seven"), (4, None)])
    pieces = packing.tokenized_pieces(docs, path, 64, with_ids=True).cache()
    packed = packing.pack(pieces, 64)
    whole = packing.sequences(packed, pieces).collect()
    assert sum(len(r["ids"]) // 4 for r in whole) == sum(r["length"] for r in pieces.collect())
    assert len(whole) == 1


def balance(rows):
    total, slots = collections.Counter({k: 0 for k in range(8)}), collections.defaultdict(list)
    for r in rows:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return total


@pytest.mark.parametrize("hot", [7, None])
def test_an_oversized_group_of_one_id_is_spread_and_the_rest_is_near_equal(spark, hot):
    rng = random.Random(3)
    rows = [(hot, "x" * 2000)] * 500 + [(1000 + k, prose(rng, rng.randrange(20, 80))) for k in range(1000)]
    found = shard.shard_rows(table(spark, rows), n_shards=8).collect()
    total = balance(found)
    assert len(found) == 1500 and max(total.values()) - min(total.values()) < 4000, total


def test_shards_are_near_equal_beside_a_row_larger_than_a_shard(spark):
    rng = random.Random(4)
    rows = [(1, "y" * 400_000)] + [(10 + k, prose(rng, rng.randrange(5, 60))) for k in range(900)]
    total = balance(shard.shard_rows(table(spark, rows), n_shards=8).collect())
    rest = sorted(total.values())[:-1]
    assert max(total.values()) == 400_001 and rest[0] > 0 and rest[-1] - rest[0] < 2000, total


def test_levels_and_shards_of_blocks():
    assert shard.level([100, 1, 1, 1, 1], 3) == 2 and shard.level([], 4) == 1 and shard.level([5], 1) == 5
    rng = random.Random(5)
    for _ in range(50):
        sizes = [rng.randrange(1, 100) for _ in range(rng.randrange(1, 400))] + [rng.randrange(1, 4000)]
        n = rng.randrange(1, 12)
        fills = collections.Counter({k: 0 for k in range(n)})
        for size, b in zip(sizes, shard.into_shards(sizes, n), strict=True):
            fills[b] += size
        assert max(fills.values()) <= max(max(sizes), shard.level(sizes, n) + 100)
