"""Content-chosen anchors: positions that any two equal strings of `span` bytes both choose at the same offset.

The anchors of a string are its `gram`-byte substrings of least hash. Two occurrences of the same string have the same least
hash at the same places, so repeated strings can be found by grouping anchors alone.
"""

from __future__ import annotations

import numpy as np

from tideline.llm.shingles import mix

GRAM = 64
_TOP = np.uint64(2**64 - 1)
_BASE = np.uint64(0xD1342543DE82EF95)
_BYTE = np.random.default_rng(7_919).integers(1, 2**64, 256, dtype=np.uint64)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_KEPT: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of a base, kept for the next call while they are of ordinary size."""
    if len(_KEPT.get(int(base), ())) < n:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        if n > 4_000_000:
            return p
        _KEPT[int(base)] = p
    return _KEPT[int(base)][:n]


class Prints:
    """Fingerprints of substrings of a byte block: equal where the bytes are equal, in whatever block and place."""

    def __init__(self, raw: np.ndarray) -> None:
        self.back = powers(_INVERSE, len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers(_BASE, len(raw) + 1)[:-1], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin])


def sliding(x: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over x[i : i + width] for every i (the end is filled up)."""
    n = len(x)
    rows = -(-(n + width) // width)
    grid = np.full(rows * width, np.uint64(fill), np.uint64)
    grid[:n] = x
    grid = grid.reshape(rows, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    back = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1 : n + width - 1])


def anchors(raw: np.ndarray, starts: np.ndarray, span: int, prints: Prints) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and rows of the anchors of a block whose rows begin at `starts` (one entry more than rows), and where the
    strings of `span` bytes that each one stands for first and last begin.

    A string's own anchor is the first of its substrings of least hash, so every string has one, and it depends on its bytes alone.
    """
    gram = min(GRAM, span)
    width = span - gram + 1
    n = len(raw)
    length = np.diff(starts)
    none = np.zeros(0, np.int64)
    if n < span or not (length >= span).any():
        return none, np.zeros(0, np.uint64), none, none, none
    fits = np.zeros(n + 1, np.int32)  # +1 where strings of `span` bytes begin to fit into a row, -1 where they end
    long = length >= span
    np.add.at(fits, starts[:-1][long], 1)
    np.add.at(fits, starts[1:][long] - span + 1, -1)
    whole = np.cumsum(fits[:n]) > 0
    hashes = np.full(n, _TOP, np.uint64)
    at = np.arange(n - gram + 1)
    hashes[: n - gram + 1] = prints.of(at, at + gram) >> np.uint64(1)
    least = np.where(whole, sliding(hashes, width, np.minimum, 2**64 - 1), np.uint64(0))
    most = sliding(least[::-1], width, np.maximum, 0)[::-1]
    found = np.flatnonzero(most == hashes)
    # strings that follow each other and have the same least hash are a run; its anchors share the run, each has those it is the first in
    edge = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])]))
    begin, end = edge, np.append(edge[1:], n)
    begin, end = begin[whole[edge]], end[whole[edge]]
    values, value = np.unique(least[begin], return_inverse=True)
    key = value * (n + 1) + begin
    order = np.argsort(key)
    run = order[np.searchsorted(key[order], np.searchsorted(values, hashes[found]) * (n + 1) + found, side="right") - 1]
    by_run = np.argsort(run, kind="stable")
    before = np.full(len(found), -1)
    before[by_run[1:]] = np.where(run[by_run[1:]] == run[by_run[:-1]], found[by_run[:-1]], -1)
    first, last = np.maximum(begin[run], before + 1), np.minimum(found, end[run] - 1)
    own = first <= last
    found, first, last = found[own], first[own], last[own]
    return found, hashes[found], np.searchsorted(starts, found, side="right") - 1, first, last
