"""Packing of documents into token windows: best fit by falling length, open windows in a segment tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import encoder
from tideline.llm.common import slices

CAPACITY, END_ID = 1024, 0
#: shorter pieces packed together by a task: at most so many token ids times the capacity are held
BLOCK_PIECES = 8192
#: tokens a window may lack before another document is cut to fill it
SLACK = 8
_SEQUENCES_BITS = 40


class OpenWindows:
    """Windows by their remaining capacity. The tree's leaf r counts the windows with room r, a node those of its leaves."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, window: int, room: int) -> None:
        self.windows[room].append(window)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node, count = room + self.leaves, self.count
        while node:
            count[node] += by
            node >>= 1

    def tightest(self, size: int) -> tuple[int, int] | None:
        """(window, room) of the least room of at least `size`, taken out; None if no window has it."""
        node, count = size + self.leaves, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, until a tree to the right holds a window
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return self.windows[room].pop(), room


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of item numbers: the longest item first, each into the tightest open window it fits. Ties in input order."""
    windows: list[list[int]] = []
    still_open = OpenWindows(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = still_open.tightest(sizes[i])
        if found is None:
            found = len(windows), capacity
            windows.append([])
        window, room = found
        windows[window].append(i)
        if room > sizes[i]:
            still_open.add(window, room - sizes[i])
    return windows


#: a run of an item: number, start, length
Run = tuple[int, int, int]


def fill_up(windows: list[list[Run]], capacity: int, slack: int) -> list[list[Run]]:
    """The windows after those with more than `slack` tokens of room were filled from the emptiest of them.

    A window is closed when a run had to be cut for it, so at most one cut is made for each. What is left of the last one is cut
    at powers of two, which need no padding.
    """
    fill = [sum(n for _, _, n in w) for w in windows]
    ragged = [k for k, n in enumerate(fill) if capacity - n > slack and n & (n - 1)]
    if not ragged:
        return windows
    out = [w for k, w in enumerate(windows) if k not in set(ragged)]
    ragged.sort(key=lambda k: -fill[k])
    emptiest = windows[ragged.pop()][:]
    for at, k in enumerate(ragged):
        window, room = windows[k][:], capacity - fill[k]
        while room > slack:
            if not emptiest:
                if len(ragged) - 1 <= at:
                    break
                emptiest = windows[ragged.pop()][:]
            item, start, n = emptiest.pop()
            taken = min(n, room)
            window.append((item, start, taken))
            room -= taken
            if taken < n:
                emptiest.append((item, start + taken, n - taken))
        if room <= slack:
            out.append(window)
        else:
            emptiest = window
        if len(ragged) - 1 <= at:
            break
    return out + (at_powers_of_two(emptiest, capacity, slack) if emptiest else [])


def at_powers_of_two(window: list[Run], capacity: int, slack: int) -> list[list[Run]]:
    """The runs of a window in windows that are full, within `slack` of it, or a power of two long."""
    left, out = sum(n for _, _, n in window), []
    if capacity - left <= slack:
        return [window]
    runs = window[::-1]
    while left:
        room, part = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            item, start, n = runs.pop()
            taken = min(n, room)
            part.append((item, start, taken))
            room -= taken
            if taken < n:
                runs.append((item, start + taken, n - taken))
        out.append(part)
    return out


_COLUMNS = {"start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}


class _Packer:
    """Rows of one task's pieces. Full windows leave at once; shorter pieces wait until a block of them is packed."""

    def __init__(self, kind: pa.DataType, capacity: int, block: int, slack: int, first_sequence: int) -> None:
        self.kind, self.capacity, self.block, self.slack, self.sequence = kind, capacity, block, slack, first_sequence
        self.waiting: list[tuple] = []  # document, its length, start of the piece, ids of the piece
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self._put(doc_id, len(ids), at, ids[at : at + self.capacity], 0)
            self.sequence += 1
        if whole < len(ids):
            self.waiting.append((doc_id, len(ids), whole, ids[whole:].copy()))
            if len(self.waiting) >= self.block:
                self.pack()

    def _put(self, doc_id, doc_tokens: int, start: int, ids: np.ndarray, offset: int) -> None:
        self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, self.sequence, offset))

    def pack(self) -> None:
        sizes = [len(x[3]) for x in self.waiting]
        windows = [[(i, 0, sizes[i]) for i in w] for w in best_fit_decreasing(sizes, self.capacity)]
        for window in fill_up(windows, self.capacity, self.slack):
            offset = 0
            for i, start, n in window:
                doc_id, doc_tokens, first, ids = self.waiting[i]
                self._put(doc_id, doc_tokens, first + start, ids[start : start + n], offset)
                offset += n
            self.sequence += 1
        self.waiting = []

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * (1 + len(_COLUMNS))
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (self.kind, *_COLUMNS.values()), strict=True)], names=["doc_id", *_COLUMNS])


def pack_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, block_pieces: int = BLOCK_PIECES, slack: int = SLACK) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row of docs.

    A document is its text's ids and the end id; one of more than `capacity` ids is first cut into full windows, which are
    sequences of their own, and what remains is a piece like a short document. Each task packs its pieces in blocks of at most
    `block_pieces`, best fit by falling length; windows that stay more than `slack` tokens short are filled by cutting pieces of
    the emptiest of them, and a block's last window is cut at powers of two, which need no padding. So a sequence is full, a power
    of two long, or at most `slack` short, also where all documents have one length that fits no window twice.

    Nothing is shuffled or gathered: encoding and packing happen in one pass, a task holds one block, and a task that is run again
    numbers its sequences alike. Null texts are empty (the end id alone), null doc_ids stay null, repeated rows are documents of
    their own, other columns are not read, an empty table gives no rows.
    """
    fields = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary), None
        kind, end = np.dtype(f"<u{encode.width}"), np.array([end_id], f"<u{encode.width}").tobytes()
        for batch in slices(batches, 200):
            packer = packer or _Packer(batch.schema.field(0).type, capacity, block_pieces, slack, TaskContext.get().partitionId() << _SEQUENCES_BITS)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, ids in zip(batch.column(0).to_pylist(), encode.encode(texts), strict=True):
                packer.add(i, np.frombuffer(ids + end, kind))
            yield packer.batch()
        if packer:
            packer.pack()
            yield packer.batch()

    kinds = fields.schema["doc_id"].dataType.simpleString()
    return fields.mapInArrow(run, f"doc_id {kinds}, " + ", ".join(f"{c} long" for c in _COLUMNS))
