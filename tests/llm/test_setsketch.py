"""SetSketch near-duplicates against brute force; the sketches' own laws."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import setsketch
from pagequarry.llm.wordhash import mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("node", "n", "k1", "band", "component", "kept", "sketch", "tokens", "class_id")})


def shingles(text, size=3):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        own = None if doc is None else least[root(i)]
        out.append((doc, len(sets[i]), own, own is None or own == doc))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 160))) for _ in range(60)]
    near = [edited(rng, t, k) for t in base[:30] for k in (1, 2, 3, 5)]
    odd = [None, "", "   ", "one", "One  TWO\tthree", "one two three", base[0].upper(), base[0], base[0], "\x00", "é ü " * 30, " ".join(f"w{rng.randrange(300)}" for _ in range(30_000))]
    rows = list(enumerate(base + near + odd))
    assert found(setsketch.near_duplicates(table(spark, rows))) == brute(rows)


def test_a_group_of_near_copies_with_strays_and_chains(spark):
    rng = random.Random(3)
    text = " ".join(f"w{k}" for k in range(120))
    rows = [(5000 - i, edited(rng, text, rng.randrange(0, 4))) for i in range(200)]
    link = text
    for i in range(12):  # each resembles the one before only
        link = edited(rng, link, 2)
        rows.append((9000 + i, link))
    assert found(setsketch.near_duplicates(table(spark, rows))) == brute(rows)


def test_many_texts_with_a_common_passage(spark, monkeypatch):
    """Texts that share half of their words link to none of each other but to their copies; buckets lie in several blocks."""
    monkeypatch.setattr(setsketch, "BLOCK", 4)
    rng = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(100))
    rows = []
    for k in range(150):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(25 if k % 3 else 60))
        rows += [(k, f"{passage} {own}"), (1000 + k, edited(rng, f"{passage} {own}", 1 + k % 4))]
    assert found(setsketch.near_duplicates(table(spark, rows))) == brute(rows)


def test_null_and_repeated_ids_and_no_rows(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(999)}" for _ in range(40)) for x in "abcd")
    rows = [(None, a), (None, a), (7, a), (3, a), (1, b), (1, c), (2, c), (2, c), (9, d), (4, edited(rng, d, 1)), (9, None)]
    assert found(setsketch.near_duplicates(table(spark, rows))) == brute(rows)
    assert setsketch.near_duplicates(table(spark, [])).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    for n in (1, 7, 300, 20_000):
        x = mix(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        one, two, whole = (setsketch.registers([s])[0] for s in (x[: n // 2 + 1], x[n // 3 :], x))
        assert (setsketch.merge(one, two) == whole).all()  # the two parts cover the set
    assert (setsketch.registers([x, x[:5]])[1] == setsketch.registers([x[:5]])[0]).all()  # by itself or in a lot
    for similarity in (0.3, 0.6, 0.85, 0.95):
        pairs, sizes = [], []
        for _ in range(60):
            common, own = int(1000 * similarity), int(1000 * (1 - similarity) / 2)
            x = mix(rng.integers(0, 1 << 62, common + 2 * own, dtype=np.uint64))
            pairs += [x[: common + own], x[own:]]
            sizes.append(common + own)
        s, n = setsketch.registers(pairs), np.array(sizes, dtype=float)
        estimate, stays = setsketch.estimates(s[::2], s[1::2], n, n, 0.85)
        assert abs(estimate.mean() - similarity) < 0.015
        assert stays.all() if similarity >= 0.85 else not stays.any()
        shared = (setsketch.bands(s[::2]) == setsketch.bands(s[1::2])).any(axis=1)
        assert shared.all() if similarity >= 0.85 else similarity > 0.5 or shared.mean() < 0.2


def test_parities_give_up_no_link_and_most_pairs_that_are_none():
    rng = np.random.default_rng(5)
    for size in (1, 7, 60, 400, 3000):
        base, sets = rng.integers(0, 1 << 63, size, dtype=np.uint64), []
        for share in np.linspace(0, 0.3, 40):
            own = base.copy()
            own[: int(share * size)] = rng.integers(0, 1 << 63, int(share * size), dtype=np.uint64)
            sets.append(np.unique(own))
        odd = np.stack([setsketch.parities(s) for s in sets]).view(np.uint64)
        n, others = np.array([len(s) for s in sets]), np.arange(len(sets))
        for k in range(len(sets)):
            stays = setsketch.may_link(odd, n, k, others, 85)
            both = np.array([len(np.intersect1d(sets[k], s)) for s in sets])
            similarity = both / (n + n[k] - both)
            assert stays[similarity >= 0.85].all()
            assert size != 400 or not stays[similarity < 0.8].any()
