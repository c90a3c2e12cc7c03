"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import base64
import json
import random
import re
import zlib
from array import array
from collections.abc import Iterator
from sys import byteorder

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import slices, stored

CAPACITY, END_ID = 1024, 2
#: pieces of one block, islands of a block, solutions of an island, children between migrations, migrations
BLOCK_PIECES, ISLANDS, POPULATION, CHILDREN, EPOCHS = 8192, 3, 6, 48, 3
_MEMO, _MEMO_CHARS = 600_000, 40
#: white space as the pattern knows it; its look-ahead overflows the library's stack on runs of a million
_RUN_CHARS = 100_000
_LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % _RUN_CHARS)


class Encoder:
    """Byte-level BPE ids of whole texts as little-endian 32-bit numbers.

    The vocabulary is a rank file: the same ids as the library `tokenizers` gives with the JSON file of that vocabulary. A text is
    cut at single spaces between other characters, where the pattern always starts a new word, and words are kept for reuse.
    `added` are the added tokens of that JSON file and their ids: a text is cut at them first; without them they are plain text.
    """

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None) -> None:
        with open(path, "rb") as f:  # a file of the installed library, found on every machine
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.encode_piece = encoding.encode_ordinary, encoding._encode_single_piece
        self.added = {t: np.array([i], dtype="<u4").tobytes() for t, i in (added or {}).items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.memo = _Memo(self._word)

    def _whole(self, text: str) -> bytes:
        ids = array("I", self.encode(text) if len(text) < _RUN_CHARS else self._long(text))
        if byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _long(self, text: str) -> list[int]:
        """Ids of a text whose long runs of white space are no matter of the pattern: a run is one piece, without its last
        character when other text follows."""
        ids, at = [], 0
        for run in _LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.encode(text[at : run.start()]) + self.encode_piece(text[run.start() : end])
            at = end
        return ids + self.encode(text[at:])

    def _word(self, word: str) -> bytes | None:
        if not word or word[0].isspace() or word[-1].isspace():
            return None  # white space beside the cut: the whole text must be encoded at once
        return self._whole(" " + word)

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return b"".join(self.added[x] if x in self.added else self._plain(x) for x in self.at_added.split(text) if x)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        words = text.split(" ")
        if len(words) < 2 or not words[0] or words[0][-1].isspace():
            return self._whole(text)
        try:
            return self._whole(words[0]) + b"".join(map(self.memo.__getitem__, words[1:]))
        except TypeError:  # a word that is None
            return self._whole(text)


class _Memo(dict):
    """Words seen lately, in two generations of at most _MEMO: frequent words move on to the next."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes | None:
        known = self.old.get(word, 0)
        value = self.make(word) if known == 0 else known
        if len(word) <= _MEMO_CHARS:
            if len(self) >= _MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


def _rank_file() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _added_tokens() -> dict[str, int]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: tuple[str, str] | None = None, capacity: int = CAPACITY, end_id: int = END_ID, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every text's ids and the end id after them.

    With `added`, added tokens in a text have their own ids, as `tokenizers` gives by default; else they are plain text.
    Only texts of more than `capacity` ids are cut, and all pieces but the first are full. Null texts are empty: the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(*(vocabulary or _rank_file()), _added_tokens() if added else None), np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                ids = encoder.ids(t.as_py() or "") + end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if k == 0 else capacity
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Numbered bins by the room they have left; the fullest that still fits an item is found at once."""

    def __init__(self, capacity: int, room: np.ndarray | None = None) -> None:
        self.capacity, self.n = capacity, 0 if room is None else len(room)
        self.by_room: dict[int, list[int]] = {}
        self.open = 0  # bit r: some bin has room r
        for b in np.flatnonzero(room).tolist() if self.n else []:
            self._file(b, int(room[b]))

    def _file(self, b: int, r: int) -> None:
        if r:
            self.by_room.setdefault(r, []).append(b)
            self.open |= 1 << r

    def best_fit(self, size: int) -> int:
        """The number of the bin an item goes to."""
        fits = self.open >> size
        if not fits:
            self.n += 1
            self._file(self.n - 1, self.capacity - size)
            return self.n - 1
        r = size + (fits & -fits).bit_length() - 1
        at = self.by_room[r]
        b = at.pop()
        if not at:
            self.open &= ~(1 << r)
        self._file(b, r - size)
        return b


def fitness(labels: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins, then unequal fill: full bins leave others with room."""
    fill = np.bincount(labels, weights=sizes)
    return -len(fill), float(((fill / capacity) ** 2).sum())


def first_solution(sizes: np.ndarray, capacity: int, noise: float, rng: random.Random) -> np.ndarray:
    """Best fit by falling size; noise shakes the order."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * (rng.random() - 0.5)))
    bins, labels = Bins(capacity), np.empty(len(sizes), np.int32)
    labels[order] = [bins.best_fit(size) for size in sizes[order].tolist()]
    return labels


def crossover(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """A child of `one` that takes whole well-filled bins of `two`.

    Bins of `one` that hold an injected item go; their other items, and those of the worst filled bins, are best-fitted anew.
    """
    fill = np.bincount(two, weights=sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    good = good[np.array([rng.random() < 0.5 for _ in good], dtype=bool)] if len(good) > 1 else good
    taken = np.zeros(len(fill), bool)
    taken[good] = True
    injected = taken[two]
    broken = np.zeros(int(one.max()) + 1, bool)
    broken[one[injected]] = True
    own = np.bincount(one, weights=sizes, minlength=len(broken))
    broken |= own < np.quantile(own, 0.02)
    kept = ~broken[one]
    # bins of `two`, then bins of `one`, are numbered anew without gaps
    labels, n = np.empty(len(sizes), np.int32), 0
    for old, at in ((two, injected), (one, kept)):
        used = np.zeros(int(old.max()) + 1, bool)
        used[old[at]] = True
        labels[at] = (n + np.cumsum(used) - 1)[old[at]]
        n += int(used.sum())
    placed = injected | kept
    bins = Bins(capacity, capacity - np.bincount(labels[placed], weights=sizes[placed], minlength=n).astype(np.int64))
    free = np.flatnonzero(~placed)
    free = free[np.argsort(-sizes[free], kind="stable")]
    labels[free] = [bins.best_fit(size) for size in sizes[free].tolist()]
    return labels


def evolve(population: list[np.ndarray], sizes: np.ndarray, capacity: int, children: int, rng: random.Random) -> list[np.ndarray]:
    """The island after `children` crossovers, best first; a child replaces the worst when it is better. Ends at the lower bound."""
    key = lambda x: fitness(x, sizes, capacity)
    ranked = sorted(population, key=key, reverse=True)
    bound = -(-int(sizes.sum()) // capacity)
    for _ in range(children):
        if len(ranked) < 2 or -key(ranked[0])[0] <= bound:
            break
        one, two = rng.sample(range(len(ranked)), 2)
        child = crossover(ranked[min(one, two)], ranked[max(one, two)], sizes, capacity, rng)
        if key(child) > key(ranked[-1]):
            ranked = sorted([*ranked[:-1], child], key=key, reverse=True)
    return ranked


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS, population: int = POPULATION, children: int = CHILDREN, epochs: int = EPOCHS) -> DataFrame:
    """pieces with sequence_id and offset, gapless from 0 in each sequence; a full piece is a sequence of its own.

    Blocks of about block_pieces shorter pieces are packed by themselves. Each block has `islands` populations that evolve in
    parallel tasks; after every epoch an island's best solution goes on to the next island. The best of all islands is the block's
    result. A task holds one block, whatever the input's size. Equal pieces are no special case; no pieces give no rows. Columns
    named pid, block, sequence_id or offset are replaced.
    """
    drop = [c for c in ("pid", "block", "sequence_id", "offset") if c in pieces.columns]
    pieces = stored(pieces.drop(*drop).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity).select("pid", "length")
    blocks = max(1, round(short.count() / block_pieces))
    short = short.withColumn("block", F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int"))
    data = short.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pid", "length"))).alias("items"))  # bounded by the block
    data = stored(data.select("block", "items.pid", "items.length").withColumnRenamed("pid", "pids").withColumnRenamed("length", "sizes"), "blocks")
    n_tasks = min(blocks * islands, 10_000)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _islands(batches, lambda sizes, _, rng: [first_solution(sizes, capacity, noise, rng) for noise in [0.0, *[0.05 * rng.random() for _ in range(population - 1)]]])

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _islands(batches, lambda _, held, rng: held)

    def _islands(batches: Iterator[pa.RecordBatch], start) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rng = random.Random(r["block"] * 1009 + r["island"] * 31 + r["epoch"])
                sizes = np.array(r["sizes"], dtype=np.int64)
                held = [np.frombuffer(x, dtype=np.int32) for x in r["solutions"]]
                ranked = evolve(start(sizes, held, rng), sizes, capacity, children, rng)
                n, spread = fitness(ranked[0], sizes, capacity)
                out = [[r["block"]], [r["island"]], [n], [spread], [[x.tobytes() for x in ranked[:population]]]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.binary())), strict=True)], names=["block", "island", "n", "spread", "solutions"])

    schema = "block int, island int, n long, spread double, solutions array<binary>"
    every = data.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = every.withColumn("solutions", F.array().cast("array<binary>")).withColumn("epoch", F.lit(0))
    take = ["block", "sizes", "island", "solutions", "epoch"]
    state = stored(state.select(*take).repartition(n_tasks, "block", "island").mapInArrow(begin, schema), "islands")
    for epoch in range(1, epochs):
        elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.slice("solutions", 1, 1).alias("elite"))
        met = state.join(elite, ["block", "island"]).select("block", "island", F.concat("elite", "solutions").alias("solutions"))
        met = met.join(data.select("block", "sizes"), "block").withColumn("epoch", F.lit(epoch))
        state = stored(met.select(*take).repartition(n_tasks, "block", "island").mapInArrow(go_on, schema), "islands")
    best = state.groupBy("block").agg(F.max(F.struct("n", "spread", (-F.col("island")).alias("i"), F.element_at("solutions", 1).alias("labels"))).alias("x"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                labels, sizes, pids = np.frombuffer(r["labels"], dtype=np.int32), np.array(r["sizes"], np.int64), np.array(r["pids"], np.int64)
                order = np.argsort(labels, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.concatenate([[True], labels[order][1:] != labels[order][:-1]])
                base = (ends - sizes[order])[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
                ids = labels[order].astype(np.int64) + (np.int64(r["block"]) << 24)
                yield pa.RecordBatch.from_arrays([pa.array(pids[order]), pa.array(ids), pa.array(ends - sizes[order] - base)], names=["pid", "sequence_id", "offset"])

    places = best.select("block", F.col("x.labels").alias("labels")).join(data, "block").mapInArrow(place, "pid long, sequence_id long, offset long")
    full = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", -F.col("pid") - 1).withColumn("offset", F.lit(0).cast("long"))
    return pieces.where(F.col("length") < capacity).join(places, "pid").unionByName(full).drop("pid")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs. Null doc_ids stay null."""
    return pack(token_pieces(docs, doc_id, text, capacity=capacity, added=added), capacity)
