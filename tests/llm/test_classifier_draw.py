"""The draw of the quality classifier: held-out precision and recall, noise, repeats, long texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from pagequarry.llm import quality_classifier

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def mixed_texts(rng, n_good, n_bad, words=60):
    """Good texts, and bad ones of which half the words are those of good ones."""
    good = [" ".join(f"w{rng.randrange(words)}" for _ in range(rng.randrange(40, 120))) for _ in range(n_good)]
    bad = [" ".join(f"w{rng.randrange(words)}" if rng.random() < 0.5 else f"z{rng.randrange(words)}" for _ in range(80)) for _ in range(n_bad)]
    return good, bad


def test_precision_and_recall_on_unseen_texts(spark):
    """Only even ids are labelled; odd ones are neither fitted on nor calibrated on."""
    good, bad = mixed_texts(random.Random(41), 600, 300)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(good + bad)], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, int(i < 600), 0) for i in range(0, 900, 2)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality_classifier.resample(docs, labels).collect() if r["doc_id"] % 2}
    right = sum(i < 600 for i in kept)
    assert right / len(kept) >= 0.97 and right / 300 >= 0.95, (right, len(kept))


def test_the_draw_favours_weights_without_being_their_order(spark):
    good, bad = mixed_texts(random.Random(42), 500, 100)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(good + bad)], DOCS)
    labels = spark.createDataFrame([(i, int(i < 500), 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    scored = quality_classifier.resample(docs, labels, k=600)
    all_ = {r["doc_id"]: r["mean_weight"] for r in scored.collect()}
    drawn = {r["doc_id"] for r in quality_classifier.resample(docs, labels, k=100, temperature=0.5).collect()}
    other = {r["doc_id"] for r in quality_classifier.resample(docs, labels, k=100, seed=18, temperature=0.5).collect()}
    best = set(sorted(all_, key=all_.get, reverse=True)[:100])
    assert len(drawn) == len(other) == 100 and drawn != other and 15 <= len(drawn & best) <= 85
    assert np.mean([all_[i] for i in drawn]) > np.mean([w for i, w in all_.items() if i < 500])
    assert not {i for i in drawn if i >= 500}


def test_repeated_rows_long_texts_and_no_texts(spark):
    good, bad = mixed_texts(random.Random(43), 900, 60, words=12)
    long_good, long_bad = " ".join(good[::9]), " ".join(bad)
    rows = [*enumerate(good + bad), (5000, long_good), (5001, long_bad), (5002, None), (5003, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    labels = spark.createDataFrame([(i, int(i < 900), 0) for i in range(0, 960, 2)], "doc_id long, quality int, toxic int")
    once = sorted(r["doc_id"] for r in quality_classifier.keep(docs, labels).collect())
    assert {5000, 5002, 5003} <= set(once) and 5001 not in once
    twice = sorted(r["doc_id"] for r in quality_classifier.keep(docs.unionByName(docs), labels).collect())
    assert twice == sorted(once * 2)
    assert quality_classifier.keep(docs, labels, k=0).count() == 0 == quality_classifier.keep(docs.limit(0), labels).count()
    assert quality_classifier.keep(docs.withColumn("score", F.lit(1)), labels.limit(0)).count() == len(rows)


def test_shares_by_decile_follow_the_weights(spark):
    """Half of the texts are drawn; each decile's share is that of draws with other noise, and noise decides within deciles."""
    rng = random.Random(44)
    # Good texts differ in how many of their words are known from labelled ones.
    texts = [" ".join(f"w{rng.randrange(60)}" if rng.random() < share else f"v{rng.randrange(4000)}" for _ in range(rng.randrange(60, 200))) for share in (k % 10 / 20 + 0.5 for k in range(2000))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 10 > 6), 0) for i in range(0, 1000)], "doc_id long, quality int, toxic int").filter("quality = 1")
    rows = quality_classifier.resample(docs, labels).collect()
    z = np.array([r["log_weight"] / np.sqrt(max(1, r["n_grams"])) for r in rows])
    ids = np.array([r["doc_id"] for r in rows])
    k = len(rows) // 2
    drawn = {r["doc_id"] for r in quality_classifier.resample(docs, labels, k=k).collect()}
    assert len(drawn) == k == len({r["doc_id"] for r in quality_classifier.resample(docs, labels, share=0.5).collect()}) - len(rows) % 2
    tenth = np.argsort(np.argsort(z)) * 10 // len(z)
    own = np.array([np.mean([i in drawn for i in ids[tenth == d]]) for d in range(10)])
    other, generator = np.zeros(10), np.random.default_rng(5)
    for _ in range(200):
        chosen = np.zeros(len(z), dtype=bool)
        chosen[np.argsort(z + generator.gumbel(size=len(z)))[-k:]] = True
        other += np.array([chosen[tenth == d].mean() for d in range(10)]) / 200
    assert np.abs(own - other).max() < 0.13 and own[-1] - own[0] > 0.15
    assert ((own > 0.02) & (own < 0.98)).sum() >= 6
