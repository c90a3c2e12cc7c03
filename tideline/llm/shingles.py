"""Word shingles of whole texts, hashed batch by batch in numpy.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a shingle is `width` consecutive words. A text with fewer words, but
not none, has one shingle: all its words. All hashes are 64 bit and depend on the bytes of the words alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of text handled at once; a longer text is one block of its own
BLOCK_BYTES = 500_000
_RNG = np.random.default_rng(20_240_229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a text column with about `limit` bytes: first row, last row + 1, their bytes, row starts. Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a block, and the number of words before each row (one entry more than rows)."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    low = _LOWER[raw]
    inside = ~_SPACE[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = starts[:-1][starts[:-1] < len(raw)]
    begins[cut] = inside[cut]
    at = np.flatnonzero(begins)
    before = np.searchsorted(at, starts)
    if not len(at):
        return np.zeros(0, np.uint64), before
    place = np.arange(at[0], len(raw)) - np.repeat(at, np.diff(np.append(at, len(raw))))
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(place.max()) + 1, _BASE, dtype=np.uint64))
        sums = np.add.reduceat(_BYTE[low[at[0] :]] * powers[place], at - at[0])
        return mix(sums), before


def shingle_hashes(raw: np.ndarray, starts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For every row of a block its distinct shingle hashes, ascending."""
    words, before = word_hashes(raw, starts)
    with np.errstate(over="ignore"):
        rows = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rows = (rows ^ words[k : k + len(rows)]) * _BASE + np.uint64(k + 1)
        rows = mix(rows)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rows[a : b - width + 1])
            elif b > a:
                one = np.uint64(b - a) * _BASE
                for w in words[a:b]:
                    one = mix(np.array([(one ^ w) * _BASE + np.uint64(7)], np.uint64))[0]
                yield np.array([one], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
