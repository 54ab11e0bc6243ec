"""The operators against brute force, on small tables with nulls, ties, repeats and long texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.llm import ann, chat_format, html_main, jaccard_join, license_scan, mixing, packing, quality_classifier, quality_rules, queries, shard, wordhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **more):
    """Rows with ids from 0; columns that clash with the operators' own come along."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for c in ("n_words", "kept", "size", "token", "component_id", "block", "epoch", "words", "T", "quota", "within", "tokens", "id", "n_blocks", "mix_total"):
        df = df.withColumn(c, F.lit("x"))
    return df


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(12, 150)) for _ in range(60)]
    near = []
    for t in base[:25]:
        w = t.split(" ")
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randrange(1, 4)):
                v[rng.randrange(len(v))] = f"n{rng.randrange(10**6)}"
            near.append(" ".join(v))
    odd = [None, "", "   ", "\n\n", "one", "One  TWO\tthree", "one two three", base[0].upper(), base[0], base[0], "\x00", "é ü " * 30, prose(rng, 30_000)]
    return base + near + odd


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def texts():
    return corpus()


# -- op7


def brute_rules(text):
    x = text or ""
    w, lines = WORD.findall(x), [y for y in x.split("\n") if WORD.search(y)]
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", x)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_rules_match_brute_force(spark, texts):
    more = [*texts, "a b c d e a b c d e x", "la " * 200, "x\ny\nx\n\nx", "## $$ %%|", "a b c d e f " * 3 + "z"]
    got = {r["doc_id"]: r for r in rows_of(quality_rules.ledger(documents(spark, more)))}
    assert len(got) == len(more)
    for i, t in enumerate(more):
        expected = brute_rules(t)
        assert {k: got[i][k] for k in expected} == expected, t
        assert bool(got[i]["failed_bits"] & 1) == (expected["n_words"] < 10)


def test_policies_and_ablations(spark, texts):
    docs = documents(spark, [*texts, "la " * 200])
    kept = quality_rules.apply_policy(docs, quality_rules.BASE)
    assert kept.columns == docs.columns
    book = quality_rules.ledger(docs)
    bits = [r["failed_bits"] for r in book.collect()]
    assert kept.count() == sum(not b & quality_rules.BASE.mask for b in bits)
    for r in rows_of(quality_rules.ablations(book)):
        mask = next(p.mask for p in quality_rules.POLICIES if p.version == r["policy"])
        bit = next(1 << b for b, (n, _) in enumerate(quality_rules.RULES) if n == r["rule"])
        assert r["n_fail"] == sum(bool(b & bit) for b in bits)
        assert r["n_only"] == sum(b & mask == bit for b in bits)
        assert r["n_rejected"] == sum(b & mask != 0 for b in bits)
    assert quality_rules.ledger(docs.limit(0)).count() == 0 == quality_rules.apply_policy(docs.limit(0)).count()


# -- op9


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = list(range(len(texts)))

    def find(a):
        while low[a] != a:
            a = low[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed):
    texts = corpus(seed)
    docs = documents(spark, texts)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert found == brute_components(texts)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in found.items() if i == c)


def test_a_group_of_near_copies_with_strays(spark):
    """Copies at all distances around the threshold, chains between them, and one size down."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(80)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(80)] = f"x{rng.randrange(6)}"
        texts.append(" ".join(w[: rng.choice([80, 80, 80, 70, 66])]))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(documents(spark, texts)).collect()}
    assert found == brute_components(texts)


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    empty = documents(spark, ["a"]).limit(0)
    assert jaccard_join.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f", "", "", 0), (3, "a b c d e f", "", "", 0), (3, "a b c d e f", "", "", 0)], DOCS)
    found = [(r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(rows).collect()]
    assert len(found) == 2 and set(found) == {(None, None), (3, 3)}
    assert sorted((r["doc_id"] or -1) for r in jaccard_join.one_of_each(rows).collect()) == [-1, 3]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}


def test_prefix_lengths_never_miss_a_link():
    """The first order's bound: linked sets share at least the smaller l in their prefixes."""
    for na in range(1, 120):
        for nb in range(na, na * 5 // 4 + 1):
            overlap = -(-4 * (na + nb) // 9)
            if overlap > na:
                continue
            least = 1 + ((4 * na + 4) // 5) // 20
            for n in (na, nb):
                assert jaccard_join.prefix_length(n) >= n - overlap + 1 + (na // 20)
            assert 1 + min(na, nb) // 20 >= least


# -- hashing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbéZ \n\t\x00ſ", max_size=30), max_size=6))
def test_word_hashes_tell_words_apart(texts):
    found = list(wordhash.word_hashes([t.encode() for t in texts]))
    words = [WORD.findall(t.translate(LOWER)) for t in texts]
    assert [len(h) for h in found] == [len(w) for w in words]
    seen = {}
    for hashes, own in zip(found, words, strict=True):
        for h, w in zip(hashes.tolist(), own, strict=True):
            assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)


def test_long_texts_are_hashed_as_short_ones(monkeypatch):
    text = prose(random.Random(3), 5000).encode()
    (whole,) = wordhash.word_hashes([text])
    monkeypatch.setattr(wordhash, "PIECE", 997)
    (pieces,) = wordhash.word_hashes([text])
    assert (whole == pieces).all()


# -- op6


def brute_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, names = [], set()
    for t in license_scan.TEMPLATES:
        if t.base:
            for i in range(len(w) - len(t.words) + 1):
                if w[i : i + len(t.words)] == t.words:
                    places.append(i)
                    names.add(t.label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names))


def test_license_scan(spark, texts):
    special = [
        "Under the MIT License. under the mit LICENSE", "Apache License, Version 2.0", "cc by nc cc-by-nc CC BY-NC 4.0", "under the mit", "license under the mit license",
        "GNU General Public License, version 3", "the mit mit license under the mit license", "ünder the mit license", "xx under\x00the\x7fmit license",
        "Permission is hereby granted, free of charge, to any person obtaining one copy of that software",
    ]
    more = [*texts, *special]
    got = {r["doc_id"]: r for r in rows_of(license_scan.scan(documents(spark, more)))}
    for i, t in enumerate(more):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(t), t
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    n = len(texts)
    assert got[n + 5]["labels"] == "gpl-3" and got[n + 9]["labels"] == "mit" and 0.8 <= got[n + 9]["score"] < 1
    assert license_scan.scan(documents(spark, ["a"]).limit(0)).count() == 0


# -- op5


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    more = [*texts, "<|endoftext|> x<|startoftext|>y", "it's THEY'LL 1234 a's!?", "İstanbul H̱ ﬁ x y", "a\x1cb  c", "Ωσς ΟΔΟΣ"]
    packed = rows_of(packing.pack_documents(documents(spark, more), queries.TOKENIZER, capacity=256))
    per, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        per[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(more):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = [ids[k : k + 256] for k in range(0, len(ids), 256)]
        assert sorted(per[i]) == [(k, 256 * k, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes())) for k, p in enumerate(pieces)], t
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in packed)
    assert len(by_sequence) <= math.ceil(total / 256) * 1.05 + 2
    assert packing.pack_documents(documents(spark, ["a"]).limit(0), queries.TOKENIZER).count() == 0


def test_sum_of_squares_follows_its_rule():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 21, 300).tolist()
    bins, opened = packing.sum_of_squares(lengths, 20)
    gaps, count = {}, collections.Counter()
    for s, b in zip(lengths, bins, strict=True):
        before = dict(count)

        def after(old, new):
            c = collections.Counter(before)
            if old < 20:
                c[old] -= 1
            if new > 0:
                c[new] += 1
            return sum(v * v for v in c.values())

        best = min(after(g, g - s) for g in [*[g for g, n in count.items() if n > 0 and g >= s], 20])
        old = gaps.get(b, 20)
        assert after(old, old - s) == best
        if old < 20:
            count[old] -= 1
        gaps[b] = old - s
        if old > s:
            count[old - s] += 1
    assert opened == len(set(bins))


def test_sequences_hold_their_pieces(spark):
    docs = documents(spark, ["a b c", "d e", None])
    pieces = packing.tokenized_pieces(docs, queries.TOKENIZER, capacity=8, with_ids=True)
    out = packing.sequences(packing.pack(pieces, 8), pieces).collect()
    assert sum(len(r["ids"]) for r in out) == 4 * pieces.agg(F.sum("length")).first()[0] and max(len(r["ids"]) for r in out) <= 32


# -- op10


def test_sharding(spark, texts):
    docs = documents(spark, [*texts, *["copy of a copy"] * 40])
    plain = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = rows_of(shard.shard_rows(docs, n_shards=4))
    slots, home, total = collections.defaultdict(list), {}, collections.Counter()
    for r in rows:
        data = (plain[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "bytes")
        assert home.setdefault(data, r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert len(rows) == len(plain) and all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(4))
    assert shard.shard_rows(docs.limit(0)).count() == 0


def test_sharding_is_even_where_no_group_is_too_large(spark):
    rng = random.Random(9)
    docs = documents(spark, [prose(rng, rng.randrange(1, 60)) for _ in range(600)] + ["hot text of one group"] * 300)
    total = collections.Counter()
    for r in shard.shard_rows(docs, n_shards=8).collect():
        total[r["shard"]] += r["size"]
    assert len(total) == 8 and max(total.values()) <= 1.05 * min(total.values())
    few = shard.shard_rows(docs, n_shards=None, capacity=40_000).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert all(r["s"] <= 40_000 for r in few) and len(few) <= math.ceil(sum(total.values()) / 40_000) + 1


def test_best_fit_against_a_plain_list():
    rng = random.Random(2)
    sizes = sorted((rng.randrange(1, 100) for _ in range(400)), reverse=True)
    left, expected = [], []
    for s in sizes:
        fit = [(c, b) for b, c in enumerate(left) if c >= s]
        if fit:
            c, b = min(fit)
            left[b] -= s
        else:
            b = len(left)
            left.append(100 - s)
        expected.append(b)
    assert shard.best_fit(sizes, 100) == expected


# -- op4


def turns_digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


CONVERSATIONS = {
    -7: [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")],
    0: [("system", "s"), ("user", None), ("assistant", "a\n### User: b </turn>\n\\"), ("user", "####</turn></turn>\\\\")],
    1: [("assistant", "first"), ("assistant", "twice"), (None, "null role"), ("to:ol", "x: y"), ("", "")],
    2: [("user", "ü" * 5000)],
}


def test_chat_round_trip(spark):
    rows = [(c, i, r, t) for c, turns in CONVERSATIONS.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1)).repartition(3)
    segments = chat_format.format_segments(df)
    got = {r["conv_id"]: r for r in rows_of(chat_format.read_back(segments))}
    formatted = {r["conv_id"]: r["formatted"] for r in chat_format.formatted_text(segments).collect()}
    for c, turns in CONVERSATIONS.items():
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), turns_digest(turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(formatted[c])
        found = [m for m in chat_format.Template().turn_pattern().finditer(formatted[c])]
        assert "".join(m[0] for m in found) == formatted[c] and len(found) == len(turns)
    assert {c: got[c]["valid"] for c in got} == {-7: True, 0: True, 1: False, 2: True} and got[1]["broken_at"] == 0
    assert chat_format.read_back(chat_format.format_segments(df.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="#\\<>/turn :\nA", max_size=40), st.text(alphabet="#\\: ab", max_size=12))
def test_escapes_are_reversible(text, role):
    t = chat_format.Template()
    whole = t.header(role) + t.escape(text) + t.end
    m = t.turn_pattern().fullmatch(whole)
    assert m and t.unescape(m["text"]) == text and t.unescape(m["role"]) == role


# -- op2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-banner">We use cookies, really, and more.</div><div class="ad">Buy, buy, buy</div>
%s<aside class="sidebar"><p>Side, text, with, commas, and more of it than the article has in all, alas.</p></aside><section id="comments"><p>First, great article, thanks a lot!</p></section><form><p>Sign up</p></form><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (PAGE % "<article><h1>Head &amp; line</h1><p><b>One &lt;two&gt;\n three<br>four<p>Next&nbsp;para</p><ul><li>i<li>j</ul></article>", "Head & line\n\nOne <two> three four\n\nNext para\n\ni\n\nj"),
        (PAGE % "<main><p>Short.</p><div class='share'>share</div></main>", "Short."),
        (PAGE % "<div id='wrap'><div class='post-body'><p>A long paragraph, with commas, and words.</p><p>Another one, also long, also with commas.</p></div></div>", "A long paragraph, with commas, and words.\n\nAnother one, also long, also with commas."),
        (None, ""), ("", ""), ("   ", ""), ("<p>lonely", "lonely"), ("just text", "just text"), ("<script>only", ""),
        ("<article><p>a<!-- no --><p>b<table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
        ("<article><h2 id=comments>On comments</h2><p>a</p><div id=comments><p>b</p></div></article>", "On comments\n\na"),
        ("<body class=has-sidebar><div class='content no-sidebar'><p>The text, of the page, is here.</p></div><div class=sidebar><p>x</p></div></body>", "The text, of the page, is here."),
        ("<article><p hidden>x</p><p style='display: none'>y</p><p>z</p><p class=comment>q</p></article>", "z"),
    ],
)
def test_main_text(html, expected):
    assert html_main.main_text(html) == expected


LONG = "A sentence of the text, with commas, and long enough to count. " * 8
#: Pages of documentation tools whose class and id names hold words of page parts.
NAMED = [
    # mdBook: the heading's text is a link of class header.
    (f"<body><nav id=sidebar class=sidebar><a href=/>x</a></nav><div id=content class=page><main><h2 id=search><a class=header href=#search>Search</a></h2><p>{LONG}</main></div></body>", ["Search", LONG]),
    # pandoc: no article; table heads, sections by --section-divs.
    (f"<body><section id=intro class=level1><h1>Intro</h1><p>{LONG}<table><thead><tr class=header><th>Key<th>Value<tbody><tr class=odd><td class=search>a<td>b</table></section>"
     f"<section id=related-work class=level1><h1>Related work</h1><p>{LONG}</section></body>", ["Intro", LONG, "Key", "Value", "a", "b", "Related work", LONG]),
    # Sphinx: sections by the words of their headings.
    (f"<body><div class=related role=navigation><a href=/>index</a></div><div class=body role=main><section id=guide><h1>Guide</h1><p>{LONG}"
     f"<section id=how-to-share-files><h2>How to share files<a class=headerlink href=#x></a></h2><p>{LONG}</section><section id=comments><span id=index-0></span><h2>Comments</h2><p>{LONG}</section>"
     f"<section id=reply><h2>Reply</h2><p>{LONG}</section><div class=section id=social><p>{LONG}</div><dl class='py notification'><dt id=search>search()<dd>{LONG}</dl></section></div>"
     "<div class=sphinxsidebar><p>Side</div></body>", ["Guide", LONG, "How to share files", LONG, "Comments", LONG, "Reply", LONG, LONG, "search()", LONG]),
    # Highlighted code: comments are code.
    (f"<article><p>{LONG}<pre><code><span class='token comment'># why</span>\nx = 1</code></pre></article>", [LONG, "# why x = 1"]),
    # A container beside a sidebar, without article or main.
    (f"<body><div class=wrap><div class=sidebar-box><p>{LONG}</div><div class=text><p>{LONG}<p>{LONG}<div class=search-syntax><p>{LONG}</div></div></div></body>", [LONG] * 3),
    # Parts inside an article still go, comments and adverts at any length.
    (f"<article><p>{LONG}<p>{LONG}<div class=share-buttons>Tell</div><div class=related-posts>{'<a href=/r>One more story</a>' * 40}</div><div class='ad-box'>{LONG}</div><span class=ad>Buy</span>"
     f"<div id=comments class=comments-area><h2>Two thoughts</h2><p>{LONG}</div><ol class=commentlist><li>{LONG}</ol></article>", [LONG, LONG]),
]


@pytest.mark.parametrize("case", range(len(NAMED)))
def test_names_of_parts_take_no_text_of_the_article(case):
    html, expected = NAMED[case]
    assert html_main.main_text(html) == "\n\n".join(t.strip() for t in expected)


#: Article text in elements that are parts of the page elsewhere.
KEPT = [
    (f"<body><form id=aspnetForm><div class=content><p>{LONG}<p>{LONG}</div><input name=q><label>Search</label></form></body>", [LONG, f"{LONG}"]),
    ("<main><article>One</article><article>Two</article></main>", ["One", "Two"]),
    (f"<main><article><p>{LONG}</article><article><a href=/x>Another story of the site, with a long title</a></article></main>", [LONG]),
    (f"<article><h1 class=header>Head</h1><p>See <a class=related href=/m>the manual</a> for more. Please <span class=follow>follow</span> these steps.<p>{LONG}</article>",
     ["Head", "See the manual for more. Please follow these steps.", LONG]),
    (f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and press <label>OK</label>.<fieldset><p>{LONG}</fieldset></article>", ["Let x=1 and press OK.", LONG]),
    (f"<header><h1>Site</h1></header><article><header><h1>Title</h1><p>By A. Writer</p><nav>x</nav></header><p>{LONG}</article>", ["Title", "By A. Writer", LONG]),
    (f"<article><header>Menu of the page</header><p>{LONG}<form><label>Mail</label><input></form></article>", [LONG]),
]


@pytest.mark.parametrize("case", range(len(KEPT)))
def test_the_article_keeps_its_text(case):
    html, expected = KEPT[case]
    found = html_main.main_text(html)
    assert found.removesuffix("\n\nSearch") == "\n\n".join(t.strip() for t in expected)


def test_pages_of_an_empty_table_and_repeated_pages(spark):
    rows = [(1, "u", "<article><p>a</article>"), (1, "u", "<article><p>a</article>"), (2, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("x"))
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_main.extract_text(df).collect()) == [(1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert html_main.extract_text(df.limit(0)).count() == 0


def test_hostile_end_tags_take_time_in_proportion():
    import time

    began = time.perf_counter()
    assert html_main.main_text("<span>" * 20_000 + "</b>" * 20_000 + "<p>x" * 20_000) == "\n\n".join(["x"] * 20_000)
    assert time.perf_counter() - began < 20


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "!", "[", "p", "div", "/", '"', "'", "=", "&", "#x", "-", "--", "a ", "]", "?", "script", "article", "class=ad "]), max_size=30))
def test_any_markup_gives_a_text(pieces):
    assert isinstance(html_main.main_text("".join(pieces)), str)


def test_main_text_of_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "<p>deep, text</p>"
    long = "<article>" + "<p>word word, word</p>" * 5000 + "</article>"
    df = spark.createDataFrame([(1, "u", deep), (None, None, long), (3, "u", None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_main.extract_text(df).collect()}
    assert got == {1: "deep, text", None: "\n\n".join(["word word, word"] * 5000), 3: ""}


# -- op8


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(4)
    points = rng.standard_normal((700, 16)).astype(np.float32)
    points[300] = points[301] = points[200]
    rows = [(i, p.tolist(), 0) for i, p in enumerate(points)]
    rows += [(800, None, 0), (900, [0.0] * 16, 0), (1000, [float("nan")] * 16, 0), (1100, [1.0, None] + [1.0] * 14, 0), (1200, [1.0] * 3, 0), (1300, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("x")).repartition(3)
    got = collections.defaultdict(list)
    for r in ann.search(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    wide = points.astype(np.float64)
    assert set(got) == set(range(0, 700, 100))
    for q, found in got.items():
        away = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        other = np.array([i for i in range(700) if i != q])
        best = other[np.lexsort((other, away[other]))[:10]]
        assert [v for _, v, _ in sorted(found)] == best.tolist()
        assert all(abs(s - away[v]) < 1e-12 for _, v, s in found)
    assert ann.search(df.limit(0)).count() == 0


def test_bounds_hold_and_probing_few_lists_recalls(spark):
    rng = np.random.default_rng(6)
    points = rng.standard_normal((300, 64))
    rotation = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    norms = np.sqrt((points**2).sum(axis=1))
    turned = points / norms[:, None] @ rotation
    q = rng.standard_normal((20, 64))
    low, high = ann.estimates(np.packbits(turned > 0, axis=1), norms, np.abs(turned).sum(axis=1) / 8, q @ rotation)
    true = ((q[:, None] - points[None]) ** 2).sum(axis=2)
    assert ((low <= true) & (true <= high)).mean() > 0.99


# -- op1


def test_mixing(spark):
    rng = random.Random(8)
    sizes = {"big": 300, "mid": 60, "small": 15, None: 10}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, prose(rng, rng.randrange(0, 40)), "en", s, 0))
            i += 1
    rows += [(i, None, "en", "empty", 0), (0, rows[0][1], "en", "big", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("epoch", "T", "quota", "mix_total", "tokens", "rows")})
    mixed = rows_of(mixing.mix(docs, max_epochs=3.0, block_rows=32))
    tokens = collections.Counter()
    for r in rows:
        tokens[r[3] or ""] += len(WORD.findall(r[1] or ""))
    share = {s: t for s, t in tokens.items() if t}
    read, per = collections.Counter(), collections.defaultdict(list)
    for r in mixed:
        read[r["mix_source"]] += r["n_tokens"]
        per[r["mix_source"], r["_epoch"]].append(r["doc_id"])
    alpha = max(r["exponent"] for r in mixed if r["mix_source"] == "big")
    largest = max(share.values())

    def entropy(a):
        w = np.array([t**a for t in share.values()], dtype=float)
        w /= w.sum()
        return -(w * np.log(w)).sum()

    limit = max(0.0, 1 - math.log(3.0) / math.log(largest / min(share.values())))
    target = 0.97 * math.log(len(share))
    assert abs(alpha - limit) < 1e-6 if entropy(limit) <= target else abs(entropy(alpha) - target) < 1e-6
    for s, t in share.items():
        epochs = (largest / t) ** (1 - alpha)
        assert abs(read[s] - epochs * t) <= 41, s
        full = sorted(r[0] for r in rows if (r[3] or "") == s)
        for k in range(int(epochs + 1e-9)):
            assert sorted(per[s, k]) == full
        assert len(per[s, int(epochs + 1e-9)]) < len(full) or epochs == int(epochs)
    assert collections.Counter(r["doc_id"] for r in mixed if r["mix_source"] == "empty") == {i: 1}
    assert all(0 <= r["mix_key"] <= 1 for r in mixed)
    first = [r["doc_id"] for r in sorted((r for r in mixed if r["mix_source"] == "big"), key=lambda r: r["mix_start"])]
    assert first != sorted(first)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_to_a_budget(spark):
    rows = [(i, "a b c d", "en", "x" if i < 90 else "y", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = rows_of(mixing.mix(docs, entropy_share=None, max_epochs=None, budget=200, block_rows=8))
    assert 200 <= sum(r["n_tokens"] for r in mixed) <= 208
    by = collections.Counter(r["mix_source"] for r in mixed)
    assert by["x"] == 45 and by["y"] == 5


# -- op3


def test_classifier_separates_held_out_texts(spark):
    rng = random.Random(11)
    good = [prose(rng, rng.randrange(40, 120), 300) for _ in range(400)]
    bad = [" ".join(f"z{rng.randrange(300)}%%" for _ in range(80)) for _ in range(60)]
    texts = good + bad + [None, ""]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i in range(0, 460, 2)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality_classifier.resample(docs, labels).collect()}
    assert set(range(400)) <= kept and not kept & set(range(400, 460))
    out = quality_classifier.keep(docs, labels)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept
    assert quality_classifier.resample(docs.limit(0), labels).count() == 0
    assert quality_classifier.resample(docs, labels.limit(0)).count() == len(texts)
    assert quality_classifier.resample(docs, labels, k=100).count() == 100


def test_rows_with_null_and_repeated_ids_are_judged_by_their_own_texts(spark):
    rng = random.Random(12)
    good = [prose(rng, rng.randrange(40, 120), 300) for _ in range(120)]
    bad = [" ".join(f"z{rng.randrange(300)}%%" for _ in range(80)) for _ in range(40)]
    ids = [*range(120), *range(200, 230), None, None, *range(8)]  # eight bad texts have ids of good ones
    rows = [*zip(ids, good + bad, strict=True), (None, good[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in [*range(20, 120), *range(200, 230, 2)]], "doc_id long, quality int, toxic int")
    key = lambda i: -1 if i is None else i
    out = [(r["doc_id"], r["text"]) for r in quality_classifier.keep(docs, labels).collect()]
    assert not {t for _, t in out} & set(bad) and (None, good[0]) in out and set(good) == {t for _, t in out}
    assert sorted(key(i) for i, _ in out) == sorted(key(r["doc_id"]) for r in quality_classifier.resample(docs, labels).collect())


def test_floor_does_not_hang_on_one_text_or_on_table_size():
    """Bad texts lie where the spread of the good ones, however few, would still reach."""
    rng = np.random.default_rng(3)
    for n in (40, 400, 40_000):
        good, bad = np.sort(rng.normal(0, 0.1, n)), np.sort(rng.normal(-0.9, 0.1, n // 4))
        floor = quality_classifier.floor_of(good, bad)
        assert bad[-1] < floor < good[0]
        odd = np.sort(np.append(good[1:], -3.0)) if n > 50 else good  # one mislabelled text
        floor = quality_classifier.floor_of(odd, bad)
        assert (good >= floor).mean() >= 0.98 and (bad >= floor).mean() == 0
    mixed = np.sort(rng.normal(0, 0.1, 1000))
    assert (mixed >= quality_classifier.floor_of(mixed, mixed)).mean() >= 0.98
    assert quality_classifier.floor_of(good, good[:0]) < good[0] and quality_classifier.floor_of(good[:0], bad) == -np.inf


def test_the_stage_rejects_bad_texts_that_pass_the_rules(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(31)
    texts = [prose(rng, rng.randrange(40, 120), 300) for _ in range(200)]
    # Half of a bad text's words are those of good ones.
    texts += [" ".join(f"w{rng.randrange(300)}" if rng.random() < 0.5 else f"z{rng.randrange(300)}" for _ in range(80)) for _ in range(100)]
    docs = documents(spark, texts).select(*[c.split(" ")[0] for c in DOCS.split(", ")])
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    ruled = corpus_pipeline.apply_quality_rules(spark, docs, str(tmp_path))
    assert ruled.count() == 300
    kept = {r["doc_id"] for r in corpus_pipeline.apply_quality_classifier(spark, ruled, str(tmp_path)).collect()}
    assert len(kept & set(range(200))) >= 196 and len(kept & set(range(200, 300))) <= 2


def test_kth_largest(spark):
    values = [random.Random(1).gauss(0, 1) for _ in range(500)] + [0.25] * 20
    df = spark.createDataFrame([(v,) for v in values], "score double")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 100, 205, 519, 520):
        assert quality_classifier.kth_largest(df, k) == ranked[k - 1]


def test_weights_match_brute_force(spark):
    texts = ["a b a", "c", "a b", "d d d d"]
    good = np.array([0, 2])
    ratio = quality_classifier.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), good)
    grams = [quality_classifier._grams(w) for w in wordhash.word_hashes([t.encode() for t in texts])]
    raw, target = np.ones(quality_classifier.BUCKETS), np.ones(quality_classifier.BUCKETS)
    for i, g in enumerate(grams):
        np.add.at(raw, g, 1)
        if i in (0, 2):
            np.add.at(target, g, 1)
    assert np.allclose(ratio, np.log(target / target.sum()) - np.log(raw / raw.sum()))


def test_tokenizer_paths_are_parameters():
    assert queries.TOKENIZER == public_tokenizers.path("word_bpe_49k.json")


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept; the whole as the stages one by one."""
    import corpus_pipeline

    rng = random.Random(21)
    base = [prose(rng, rng.randrange(30, 120), 500) for _ in range(120)]
    near = [" ".join([*t.split(" ")[:-1], f"n{k}"]) for k, t in enumerate(base[:40])]
    texts = [*base, *near, *base[:10], "too short", "# % & " * 40, "spam " * 90, None, ""]
    docs = documents(spark, texts).select(*[c.split(" ")[0] for c in DOCS.split(", ")]).withColumn("source", F.when(F.col("doc_id") % 4 == 0, "rare").otherwise("hot"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    now, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r["doc_id"] for r in now.select("doc_id").collect()]
        if name != "packing":
            assert now.columns == docs.columns
    n = len(texts)
    assert sorted(kept["quality_rules"]) == list(range(n - 5))
    assert sorted(kept["quality_classifier"]) == list(range(n - 5))
    expected = brute_components(texts[: n - 5])
    assert sorted(kept["near_duplicates"]) == sorted(i for i, (_, c) in expected.items() if i == c)
    assert set(kept["source_mixing"]) == set(kept["near_duplicates"]) and len(kept["source_mixing"]) >= len(kept["near_duplicates"])
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(whole.columns) == sorted(now.columns)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(whole) == key(now)


def test_license_index_with_many_templates_and_other_capitals(spark):
    """A few hundred made templates, and letters beyond A-Z, against places found by slices."""
    rng = random.Random(51)
    made = tuple(license_scan.Template(f"made-{k}", " ".join(f"v{rng.randrange(60)}" for _ in range(rng.randrange(1, 6)))) for k in range(300))
    texts = [" ".join(f"V{rng.randrange(60)}" for _ in range(300)) for _ in range(10)] + ["v1", "v1 v1 v1", "", None, "İV1 v2"]
    docs = documents(spark, texts + texts[:1])
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs, made).collect()}
    for i, t in enumerate(texts + texts[:1]):
        w = (t or "").translate(LOWER).split()
        expected = {m.label for m in made if any(w[j : j + len(m.words)] == m.words for j in range(len(w)))}
        assert set(got[i].split(",")) - {""} == expected, t
    upper = license_scan.scan(documents(spark, ["ÜNDER the MIT license", "under the mİt license UNDER THE MIT LICENSE"])).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_base"], r["first_word"]) for r in upper] == [(4, 0, None), (8, 1, 4)]


def test_pairs_must_pass_every_order(spark):
    sets = spark.createDataFrame([(1, 5, [1, 2, 3, 4, 5], [1, 2]), (2, 5, [1, 2, 3, 4, 5], [2, 1]), (3, 5, [1, 6, 7, 8, 9], [8, 9])], "doc long, n int, tokens array<long>, other array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [(r["a"], r["b"]) for r in jaccard_join.candidates(pairs, sets).collect()] == [(1, 2)]
    rng = random.Random(6)
    base = [f"b{k}" for k in range(60)]
    texts = [" ".join(f"x{rng.randrange(9)}" if rng.random() < 0.03 else w for w in base) for _ in range(60)]
    docs = documents(spark, texts).select("doc_id", "text")
    found = [r.asDict() for r in jaccard_join.second_order(docs, docs.select(F.col("doc_id").alias("doc"))).collect()]
    linked = 0
    for x in found:
        for y in found:
            common = len(set(x["tokens"]) & set(y["tokens"]))
            if 5 * common >= 4 * (x["n"] + y["n"] - common):
                linked += 1
                assert set(x["other"]) & set(y["other"]) and set(x["tokens"][: x["m"]]) & set(y["tokens"][: y["m"]])
    assert linked > len(found)
