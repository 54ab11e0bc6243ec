"""The remembered words of packing against the tokenizer itself."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagequarry.llm import queries, word_tokens

TEXTS = [
    "don't they're 's 'tis ''s \"'start' a'd'm", "<|endoftext|> x<|startoftext|>y <| < |", "ÀÉ×÷ß Straße ÿ ÞÐ", "漢字 кириллица Ωmega École École ́x",
    "a b c　d​e", "1234 12a 3.14 $5%% ___ --- a_b", "\x00\x01ab\x7fc", "İstanbul Ǆ ﬁ ª º µ", "x" * 5_000 + " y", "é" * 1000 + "1" * 500 + " z",
    "", "   \n\t", "\U0001f600\U0001f600 a\U0001f600b", "a\rb\x0bc\x0cd", "..." * 500, "word " * 70_000,
]


@pytest.mark.parametrize("slots", [word_tokens.SLOTS, 16])
def test_ids_are_the_tokenizers(monkeypatch, slots):
    monkeypatch.setattr(word_tokens, "SLOTS", slots)
    monkeypatch.setattr(word_tokens, "LONG", slots)
    whole, own = Tokenizer.from_file(queries.TOKENIZER), word_tokens.WordTokens(queries.TOKENIZER)
    rng = np.random.default_rng(1)
    syllables = "th er an tion ment é ció ß THE 7 , ' - <| 語".split()
    made = [" ".join("".join(rng.choice(syllables, 3)) for _ in range(200)) for _ in range(20)]
    texts = TEXTS + made
    expected = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from what is remembered, or has been evicted
        assert [ids.tolist() for ids in own.encode([t.encode() for t in texts])] == expected
    assert (own.n > 0).sum() <= slots and len(own.long) <= slots
