"""Vectorised 64-bit hashes of the words of many texts.

Texts are joined into one byte array and hashed without a Python loop over
words: with B(i) the prefix sums of byte(i) * R**i modulo 2**64 and R odd (so that
it has an inverse), a word from s to e hashes to (B(e) - B(s)) * R**-s, mixed with its
length.  Words are runs of bytes other than blank, tab, LF, VT, FF and CR, or of another class
that leaves those out as well; A-Z are lower-cased.  Bytes of other UTF-8 characters stay as they are.

A text of any length is hashed in pieces of at most ``PIECE`` bytes cut at white
space (a single longer word grows its piece), so the arrays are bounded by the piece
and the eight bytes a word of the text itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Bytes hashed together: the arrays beside them are some fifty times as large, in every Python worker.
PIECE = 1 << 18
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WS = re.compile(rb"[\x20\x09-\x0D]")
_powers: dict[str, np.ndarray] = {}

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and all bytes beyond ASCII.
ALPHANUMERIC = np.ones(256, dtype=bool)
ALPHANUMERIC[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += 0x20
_LOWER += np.uint64(1)
_KEEP = np.arange(1, 257, dtype=np.uint64)


def _powers_of(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 4 * PIECE:
            _powers[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def piece_hashes(data: bytes, lower: bool, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of data, and where they start and end."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    starts, ends = word_bounds(raw, is_word)
    return range_hashes((_LOWER if lower else _KEEP)[raw], starts, ends), starts, ends


def word_bounds(raw: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the bytes start and end."""
    edge = np.diff(is_word[raw].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges of values (unsigned 64-bit, none of them 0)."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers_of(_R, len(values), "up")[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers_of(_R_INVERSE, len(values), "down")[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            if cut <= at:
                found = _WS.search(data, end)
                cut = found.start() if found else len(data)
            end = cut + 1 if cut < len(data) else cut
        yield data[at:end]
        at = end


def word_hashes(texts: list[bytes | None], lower: bool = True, is_word: np.ndarray = _IS_WORD) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; texts are hashed together up to a piece."""
    lot: list[bytes] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        hashes, starts, _ = piece_hashes(b"\n".join(lot), lower, is_word)
        ends = np.cumsum([len(t) + 1 for t in lot])
        cuts = np.searchsorted(starts, ends)
        low = 0
        for high in cuts:
            yield hashes[low:high]
            low = high

    for text in texts:
        text = text or b""
        if lot and held + len(text) > PIECE:
            yield from flush()
            lot, held = [], 0
        if len(text) > PIECE:
            yield np.concatenate([piece_hashes(p, lower, is_word)[0] for p in pieces(text)])
        else:
            lot.append(text)
            held += len(text) + 1
    if lot:
        yield from flush()


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all windows of ``size`` words; fewer words are one window as a whole."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0x100000001B3) + words[k : k + n]
        out = out ^ (out >> np.uint64(29))
    return mix(out)
