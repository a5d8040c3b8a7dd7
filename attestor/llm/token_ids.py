"""Token ids of whole texts by the tokenizers library, with a memory for what recurs."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from attestor.llm.grams import rows_of, span_hashes

#: Longer units are not remembered; the memory has so many places, and starts anew when its ids are so many.
LONGEST, PLACES, STORED = 48, 1 << 20, 1 << 23
#: The id that ends each document.
END = 0
#: White space in ASCII as the tokenizer's patterns have it, and control signs that are taken for it to be safe.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
#: Classes of bytes: blank, letter, digit, sign, other white space, and all that is left to the library's own cutting.
_SPACE, _LETTER, _DIGIT, _SIGN, _WHITE, _OTHER = range(6)
CLASS = np.full(256, _OTHER, "u1")
CLASS[33:127] = _SIGN
CLASS[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
CLASS[48:58], CLASS[9:14], CLASS[32] = _DIGIT, _WHITE, _SPACE
#: Whether the usual pattern always parts two neighbouring classes.
PARTS = np.zeros((8, 8), bool)
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _SIGN), (_LETTER, _WHITE), (_DIGIT, _LETTER), (_DIGIT, _SIGN), (_DIGIT, _WHITE), (_SIGN, _LETTER), (_SIGN, _DIGIT), (_SIGN, _WHITE), (_WHITE, _LETTER), (_WHITE, _DIGIT), (_WHITE, _SIGN)):
    PARTS[_a, _b] = True


def _parted(raw: np.ndarray) -> np.ndarray:
    """Places before which a piece of the usual pattern surely begins, blanks left aside.

    Not after an apostrophe, which may take letters along, and not after white space that has more before it: its last
    sign is a piece of its own only where something follows.
    """
    kind = CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for two signs
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    cut = np.zeros(len(raw), bool)
    cut[1:] = PARTS.reshape(-1)[kind[:-1] * np.uint8(8) + kind[1:]]
    cut[1:] &= raw[:-1] != 39
    alone = np.zeros(len(raw), bool)
    alone[2:] = (kind[:-2] >= _LETTER) & (kind[:-2] <= _SIGN)
    cut[1:] &= (kind[:-1] != _WHITE) | alone[1:]
    return cut


def _blank_follows(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space, of Unicode too, begins at each of the places ``at`` (all of them within ``raw``)."""
    wide = np.concatenate([raw, np.zeros(2, "u1")])
    a, b, c = wide[at], wide[at + 1], wide[at + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
    quads = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    return BLANK[a] | two | three | quads


class IdEncoder:
    """Ids of texts, as ``encode(text, add_special_tokens=False)`` has them.

    A byte-level tokenizer with the usual pattern never joins across a blank that a word follows, nor across a change
    between ASCII letters, digits and signs, so texts are cut there, and a unit that was met before is looked up: all units
    of a run of texts at once, by a hash of their bytes. Any other tokenizer, and a text with doubled blanks or added
    tokens, goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        self.by_unit = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(PLACES, "u8")
        self.place = np.zeros(PLACES, "i8")
        self.size = np.full(PLACES, -1, "i4")
        self.store, self.used = np.zeros(STORED, self.dtype), 0

    def _ids(self, unit: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(unit.decode(), add_special_tokens=False).ids, self.dtype)

    def _units(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of each unit, whether it is a whole odd text). Texts without bytes have no unit."""
        row, n = rows_of(at), len(raw)
        first = np.unique(at[:-1][np.diff(at) > 0])
        if not self.by_unit:
            return first, np.ones(len(first), bool)
        blank = np.flatnonzero(raw == 32)
        last = np.zeros(n + 1, bool)
        last[at[1:]] = True  # the place after a text's last byte
        ends = last[blank + 1]
        double = ends.copy()
        double[~ends] = _blank_follows(raw, blank[~ends] + 1)
        odd = np.zeros(len(at) - 1, bool)
        odd[row[blank[double]]] = True
        if self.added:
            data = raw.tobytes()
            for token in self.added:
                found = data.find(token)
                while found >= 0:
                    odd[row[found]] = True
                    found = data.find(token, found + 1)
        is_start = _parted(raw)
        is_start[blank] = True
        if odd.any():
            is_start &= ~odd[row]
        is_start[first] = True
        start = np.flatnonzero(is_start)
        return start, odd[row[start]]

    def encode_many(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids), from the texts' bytes and their bounds that begin at 0."""
        if not len(raw):
            return np.zeros(0, self.dtype), np.zeros(len(at), "i8")
        if self.used > STORED // 2:
            self._clear()
        start, odd = self._units(raw, at)
        stop = np.append(start[1:], len(raw))
        long = odd | (stop - start > LONGEST)
        place, size = np.zeros(len(start), "i8"), np.zeros(len(start), "i8")
        short = np.flatnonzero(~long)
        h = span_hashes(raw, start[short], stop[short])
        slot = (h >> np.uint64(44)).astype("i8")
        hit = (self.key[slot] == h) & (self.size[slot] >= 0)
        place[short[hit]], size[short[hit]] = self.place[slot[hit]], self.size[slot[hit]]
        extra, more = [], self.used

        def put(ids: np.ndarray) -> int:
            nonlocal more
            extra.append(ids)
            more += len(ids)
            return more - len(ids)

        missed = np.flatnonzero(~hit)
        new, one, of = np.unique(h[missed], return_index=True, return_inverse=True)
        places, sizes = np.zeros(len(new), "i8"), np.zeros(len(new), "i8")
        for i, j in enumerate(short[missed[one]]):
            ids = self._ids(raw[start[j] : stop[j]].tobytes())
            places[i], sizes[i] = put(ids), len(ids)
        place[short[missed]], size[short[missed]] = places[of], sizes[of]
        kept = more
        if kept <= STORED:
            self.store[self.used : kept] = np.concatenate(extra) if extra else []
            slots = (new >> np.uint64(44)).astype("i8")
            self.key[slots], self.place[slots], self.size[slots] = new, places, sizes
            extra, self.used = [], kept
        for j in np.flatnonzero(long):
            ids = self._ids(raw[start[j] : stop[j]].tobytes())
            place[j], size[j] = put(ids), len(ids)
        whole = self.store[: self.used]
        total = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(place - total[:-1], size) + np.arange(total[-1])
        if extra:
            whole = np.concatenate([whole, *extra])
        return whole[source], total[np.searchsorted(start, at)]

    def encode(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers; null counts as empty."""
        raw = np.frombuffer((text or "").encode(), "u1")
        return bytes(little(self.encode_many(raw, np.array([0, len(raw)]))[0]))

    def encode_rows(self, raw: np.ndarray, at: np.ndarray, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """:func:`encode_many`, with the end id after each text if asked for."""
        ids, bounds = self.encode_many(raw, at)
        if not end:
            return ids, bounds
        n = len(at) - 1
        shifted = bounds + np.arange(n + 1)
        out = np.full(shifted[-1], END, self.dtype)
        keep = np.ones(len(out), bool)
        keep[shifted[1:] - 1] = False
        out[keep] = ids
        return out, shifted


def little(ids: np.ndarray) -> memoryview:
    """Ids as the bytes of little-endian unsigned 32-bit integers."""
    return memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")


def binary_rows(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each row of ids."""
    at = (bounds * ids.itemsize).astype("i8")
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


@lru_cache(maxsize=2)
def load(path: str) -> IdEncoder:
    return IdEncoder(path)
