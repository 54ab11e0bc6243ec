"""Token ids of whole texts from remembered words.

The tokenizer (lower case, white space dropped, BPE within a word) treats each part that its own pattern finds by itself, so
a text's ids are those of its parts in order.  Parts are found and hashed for a quarter of a megabyte of text at once and looked
up in a table of a fixed size, in which a new part takes the place of an old one; only parts that the
table lacks go to the tokenizer.

Parts are found by classes of bytes, which is plain for ASCII and the Latin-1 letters.  A word with an
apostrophe, a control sign, a possible special token or any other character goes to the tokenizer whole, with its case (composition
may depend on it), and is remembered whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from .wordhash import PIECE, pieces, range_hashes, word_bounds

#: Places for parts that a Python worker remembers, and ids of a part that have room there.
SLOTS, WIDTH = 1 << 20, 8
#: Parts with more ids that are remembered apart, at most.
LONG = 20_000
#: Words that the tokenizer gets as one text: its time grows with the square of a text's length.
JOINED = 64

_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
#: Bytes that no plain word has: control signs, the apostrophe, the starts of characters beyond the Latin-1 letters.
_WHOLE = np.zeros(256, dtype=bool)
_WHOLE[[*range(0x09), *range(0x0E, 0x20), 0x27, 0x7F, 0xC0, 0xC1, 0xC2, *range(0xC4, 0x100)]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[0x41:0x5B] += 0x20
_KEPT = np.arange(301, 557, dtype=np.uint64)


class WordTokens:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if len(vocabulary) > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.ends_word = np.zeros(1 << 16, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.keys, self.n = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.uint8)
        self.ids = np.zeros((SLOTS, WIDTH), dtype=np.uint16)
        self.long: dict[int, np.ndarray] = {}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint16) for x in found]

    def _ids_of(self, plain: list[str], whole: list[str]) -> list[np.ndarray]:
        """Ids of plain parts, then of whole words."""
        lots = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        out = []
        for lot, ids in zip(lots, self._encoded([" ".join(lot) for lot in lots]), strict=True):
            cuts = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(cuts) == len(lot):
                out += [ids[low:high] for low, high in zip([0, *cuts[:-1]], cuts, strict=True)]
            else:  # no such vocabulary is known; each part for itself is right with any
                out += self._encoded(lot)
        return out + self._encoded(whole)

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each hash, of two that it may have, and whether it is there."""
        one, two = (hashes & np.uint64(SLOTS - 1)).astype(np.int64), (hashes >> np.uint64(40) & np.uint64(SLOTS - 1)).astype(np.int64)
        in_one = self.keys[one] == hashes
        at = np.where(in_one, one, two)
        return at, in_one | (self.keys[two] == hashes)

    def _remember(self, hashes: np.ndarray, found: list[np.ndarray], n: np.ndarray, flat: np.ndarray) -> None:
        short = np.flatnonzero((n <= WIDTH) & (n > 0))
        own = hashes[short]
        one, two = (own & np.uint64(SLOTS - 1)).astype(np.int64), (own >> np.uint64(40) & np.uint64(SLOTS - 1)).astype(np.int64)
        # An empty place, or else one of the two by a bit of the hash.
        to = np.where((self.n[one] == 0) | ((self.n[two] > 0) & (own >> np.uint64(63) == 0)), one, two)
        last = np.unique(to[::-1], return_index=True)[1]
        keep = len(to) - 1 - last  # of several for one place the last
        to, short = to[keep], short[keep]
        rows = np.zeros((len(short), WIDTH), dtype=np.uint16)
        starts = np.cumsum(n) - n
        inside = np.arange(WIDTH) < n[short][:, None]
        rows[inside] = flat[(starts[short][:, None] + np.arange(WIDTH))[inside]]
        self.keys[to], self.n[to], self.ids[to] = hashes[short], n[short], rows
        for k in np.flatnonzero(n > WIDTH).tolist():
            if len(self.long) >= LONG:
                self.long.clear()
            self.long[int(hashes[k])] = found[k]

    def _parts(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of each part, and whether it is a whole word."""
        raw = np.frombuffer(data, dtype=np.uint8)
        kind = _CLASS[raw]
        edge = np.empty(len(raw), dtype=bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == _DIGIT
        odd = _WHOLE[raw]
        lead = np.flatnonzero(raw == 0xC3)
        values = _LOWER[raw]
        if len(lead):
            after = raw[lead + 1]
            upper = (after < 0x9F) & (after != 0x97)
            values[lead[upper] + 1] += np.uint64(0x20)
            odd[lead[(after == 0x97) | (after == 0xB7)]] = True
        special = np.flatnonzero(raw[:-1] == 0x3C)
        odd[special[raw[special + 1] == 0x7C]] = True
        whole_starts = np.empty(0, dtype=np.int64)
        if odd.any():
            starts, ends = word_bounds(raw)
            sums = np.zeros(len(raw) + 1, dtype=np.int32)
            np.cumsum(odd, out=sums[1:])
            is_odd = sums[ends] > sums[starts]
            whole_starts = starts[is_odd]
            cover = np.zeros(len(raw) + 1, dtype=np.int8)
            cover[whole_starts] += 1
            cover[ends[is_odd]] -= 1
            inside = np.cumsum(cover[:-1], dtype=np.int8).view(bool)
            edge &= ~inside
            edge[whole_starts] = True
            values[inside] = _KEPT[raw[inside]]
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(raw))
        text = kind[starts] != _SPACE
        starts, ends = starts[text], ends[text]
        whole = np.zeros(len(starts), dtype=bool)
        whole[np.searchsorted(starts, whole_starts)] = True
        return range_hashes(values, starts, ends), starts, ends, whole

    def _encode_piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of data, with the starts of its parts and the ids before each part and at the end."""
        if not data:
            return np.empty(0, np.uint16), np.empty(0, np.int64), np.zeros(1, np.int64)
        hashes, starts, ends, whole = self._parts(data)
        at, known = self._slots(hashes)
        n = np.where(known, self.n[at], 0).astype(np.int64)
        rows = self.ids[at[known]]
        missing = np.flatnonzero(~known)
        flat = from_ = None
        if len(missing):
            own, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            found: list[np.ndarray | None] = [self.long.get(h) for h in own.tolist()]
            new = np.array([k for k, x in enumerate(found) if x is None], dtype=np.int64)
            if len(new):
                lead = missing[first[new]]
                is_whole = whole[lead]
                text = lambda some: [data[s:e].decode() for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                new = np.concatenate([new[~is_whole], new[is_whole]])
                got = self._ids_of(text(lead[~is_whole]), text(lead[is_whole]))
                for k, ids in zip(new.tolist(), got, strict=True):
                    found[k] = ids
            counts = np.array([len(x) for x in found], dtype=np.int64)
            flat = np.concatenate(found)
            if len(new):
                self._remember(own, found, counts, flat)
            n[missing] = counts[which]
            from_ = (np.cumsum(counts) - counts)[which]
        before = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(n, out=before[1:])
        ids = np.empty(before[-1], dtype=np.uint16)
        held = rows[np.arange(WIDTH) < n[known][:, None]]
        if flat is None:
            return held, starts, before
        ids[np.repeat(known, n)] = held
        counts = n[missing]
        ids[np.repeat(~known, n)] = flat[np.arange(counts.sum()) + np.repeat(from_ - (np.cumsum(counts) - counts), counts)]
        return ids, starts, before

    def encode(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """Ids of each text (UTF-8), in order; texts are taken together up to a piece."""
        lot, held = [], 0

        def flush():
            ids, starts, before = self._encode_piece(b"\n".join(lot))
            cuts = before[np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in lot]]))]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                yield ids[low:high]

        for text in texts:
            data = text or b""
            if lot and held + len(data) > PIECE:
                yield from flush()
                lot, held = [], 0
            if len(data) > PIECE:
                yield np.concatenate([self._encode_piece(p)[0] for p in pieces(data)])
            else:
                lot.append(data)
                held += len(data) + 1
        if lot:
            yield from flush()
