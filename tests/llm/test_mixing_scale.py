"""Mixing with many sources, ranges of blocks, rows without ids; an oversized group in sharding."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import common, mixing, shard

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("budget", [None, 30_000])
def test_weights_by_rows_are_those_of_one_row(spark, budget):
    rng = random.Random(3)
    sizes = spark.createDataFrame([(f"s{k}", int(10 * rng.paretovariate(0.8))) for k in range(50)] + [("none", 0)], "source string, tokens long")
    for options in ({}, {"entropy_share": None}, {"max_epochs": None}, {"entropy_share": 0.8, "max_epochs": 20.0}):
        one, two = ({r["source"]: r for r in f(sizes, budget=budget, **options).collect()} for f in (mixing.source_weights, mixing.source_weights_by_rows))
        assert set(one) == set(two) and len(one) == 50
        for s in one:
            assert all(abs(one[s][c] - two[s][c]) <= 1e-6 * max(1, abs(one[s][c])) for c in ("tokens", "exponent", "weight", "epochs")), (options, s)
    assert mixing.source_weights_by_rows(sizes.limit(0)).count() == 0


def test_more_sources_than_one_row_holds(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i if i % 5 else None, "w " * rng.randrange(1, 30) + str(i), "en", f"s{int(rng.paretovariate(1.0)) % 40}", 0) for i in range(800)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("mix_hash", "turn", "range", "many")})
    key = lambda df: sorted((r["doc_id"] or -1, r["mix_source"], r["epoch"], r["mix_start"]) for r in df.collect())
    options = {"block_rows": 8, "budget_share": 1.5, "max_epochs": 4.0}
    whole = key(mixing.mix(docs, **options))
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    assert key(mixing.mix(docs, **options)) == whole
    monkeypatch.setattr(mixing, "RANGE_BLOCKS", 2)  # the order of blocks doesn't hang on the ranges
    assert key(mixing.mix(docs, **options)) == whole


def test_a_budget_cuts_and_repeats(spark):
    rows = [(i, "a b c d", "en", "xy"[i % 2], 0) for i in range(200)]
    mixed = mixing.mix(spark.createDataFrame(rows, DOCS), budget_share=1.5, block_rows=8).collect()
    read = collections.Counter(r["mix_source"] for r in mixed)
    assert read == {"x": 150, "y": 150} and {r["epoch"] for r in mixed} == {0, 1}
    starts = sorted(r["mix_start"] for r in mixed if r["mix_source"] == "x")
    assert starts == list(range(0, 600, 4))


def test_rows_without_ids_lie_in_many_blocks(spark):
    docs = spark.createDataFrame([(None, f"t{i}", "en", "s", 0) for i in range(500)], DOCS)
    assert len({r["block"] for r in mixing.mix(docs, block_rows=16).collect()}) > 20


def test_a_group_larger_than_a_shard_is_cut_and_nothing_else(spark):
    rng = random.Random(5)
    texts = [f"text {i} " + "w" * rng.randrange(1, 40) for i in range(60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts + texts[:20])] + [(1000 + i % 300, "one hot text", "en", "s", 0) for i in range(600)]  # ids of the hot group repeat
    found = shard.shard_rows(spark.createDataFrame(rows, DOCS), n_shards=8).collect()
    assert len(found) == len(rows)
    total, home, slots = collections.Counter(), collections.defaultdict(set), collections.defaultdict(list)
    text = dict((i, t) for i, t, *_ in rows)
    for r in found:
        total[r["shard"]] += r["size"]
        home[text[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert [t for t, shards in home.items() if len(shards) > 1] == ["one hot text"] and len(home["one hot text"]) > 4
    assert set(total) == set(range(8)) and max(total.values()) <= 1.1 * min(total.values()), total
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_the_shared_folder_is_demanded_off_local_masters(monkeypatch):
    from types import SimpleNamespace

    session = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, applicationId=master))
    assert common.scratch_dir(session("local[2]")) == common.scratch_dir(session("local[2]"))
    for master in ("spark://h:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            common.scratch_dir(session(master))
