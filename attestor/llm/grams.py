"""Vectorised n-grams and words over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd 64-bit multiplier of the rolling hashes.
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words: ASCII letters, and all bytes of characters beyond ASCII.
WORD_BYTE = np.array([chr(b).isalpha() or b > 127 for b in range(128)] + [True] * 128)


def rows_of(at: np.ndarray) -> np.ndarray:
    """The row of each byte."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def gram_ids(raw: np.ndarray, at: np.ndarray, size: int, bits: int, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed id) of each run of ``size`` bytes that lies within one row; ids have ``bits`` bits."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    code = np.full(n, size, "u8")
    for i in range(size):
        code *= np.uint64(257)
        code += raw[i : i + n]
    code *= MULT
    code >>= np.uint64(64 - bits)
    whole = row[:n] == row[size - 1 :]
    return row[:n][whole], code[whole].view("i8")


def _room(n: int) -> int:
    """Few different sizes, so that what is kept of the powers is met again."""
    return 1 << (18 if n <= 1 << 18 else max(20, (n - 1).bit_length()))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(MULT), -1, 1 << 64))
    ones = np.ones(size, "u8")
    return tuple(np.multiply.accumulate(np.concatenate([ones[:1], np.full(size - 1, m, "u8")])) for m in (MULT, inverse))


def span_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of each span. Spans of up to a few hundred bytes that differ have different hashes but by chance."""
    up, down = _powers(_room(len(raw)))
    total = np.zeros(len(raw) + 1, "u8")
    np.cumsum((raw + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return ((total[stop] - total[start]) * down[start] + (stop - start).astype("u8")) * MULT


def words(raw: np.ndarray, row: np.ndarray, inside: np.ndarray = WORD_BYTE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, row, 64-bit hashes) of each maximal run of ``inside`` bytes; runs end where rows end.

    Hashes have a column for the whole run, and one for each of its prefixes (0 where the run is no longer).
    """
    if not len(raw):
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros((0, 1 + len(prefixes)), "u8")
    letter = inside[raw]
    fresh = np.ones(len(raw), bool)
    fresh[1:] = (row[1:] != row[:-1]) | ~letter[:-1]
    start = np.flatnonzero(letter & fresh)
    last = np.ones(len(raw), bool)
    last[:-1] = (row[1:] != row[:-1]) | ~letter[1:]
    stop = np.flatnonzero(letter & last) + 1
    up, down = _powers(_room(len(raw)))
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum((raw.astype("u8") + np.uint64(1)) * up[: len(raw)], dtype="u8")])
    hashes = np.zeros((len(start), 1 + len(prefixes)), "u8")
    hashes[:, 0] = (total[stop] - total[start]) * down[start] * MULT
    for i, size in enumerate(prefixes, 1):
        longer = np.flatnonzero(stop - start > size)
        at = start[longer]
        hashes[longer, i] = ((total[at + size] - total[at]) * down[at] + np.uint64(size)) * MULT
    return start, row[start], hashes
