"""Spelling variants: words one edit apart, found by k-d trees over letter counts, and the form each goes back to."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import slices, stored

#: letters of a word, of them the upper-case ones that are lowered
RUN, LOWERED = re.compile("[A-Za-zÀ-ÿ]+"), {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
MIN_LETTERS, MIN_COUNT, DROP_ONE_IN, FORM_TIMES = 5, 3, 97, 2
#: letters counted by themselves: a-z and U+00C0 to U+00FF; all others are counted together
_OTHER = 26 + 64
_SIZES = _OTHER + 1
#: words of a box, and letters of all of them; words sampled for the cuts; points of a leaf; pairs looked at together
BOX_WORDS, BOX_LETTERS, SAMPLE_WORDS, LEAF_POINTS, PAIRS = 32_768, 8_000_000, 65_536, 24, 1_000_000
#: words that a task counts before it passes them on
_COUNTED = 200_000


def run_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """word, n: how often each word of at least min_letters occurs, from min_count on.

    A word is a run of letters with A-Z lowered. Where drop_one_in divides h, the unsigned crc32 of `<doc_id>:<run>`, the run's code
    point h % length is left out first. Null texts hold no words; a null doc_id is written as the empty string; repeated rows count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for r, k in Counter(RUN.findall(t or "")).items():
                    r = r.lower() if r.isascii() else r.translate(LOWERED)
                    h = zlib.crc32(r.encode(), start)
                    if h % drop_one_in == 0:
                        at = h % len(r)
                        r = r[:at] + r[at + 1 :]
                    if len(r) >= min_letters:
                        total[r] += k
                if len(total) > _COUNTED:
                    yield _counts(total)
                    total = Counter()
        yield _counts(total)

    found = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


# letter counts


def letters_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    length = len(words[0])
    return np.array(words, dtype=f"U{length}").view(np.uint32).reshape(len(words), length)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    low, high = (letters >= 97) & (letters <= 122), (letters >= 0xC0) & (letters <= 0xFF)
    place = np.where(low, letters - 97, np.where(high, letters - 0xC0 + 26, _OTHER)).astype(np.int64)
    m = len(letters)
    flat = np.bincount((place + np.arange(m)[:, None] * _SIZES).ravel(), minlength=m * _SIZES)
    return flat.reshape(m, _SIZES).astype(np.int32)


@dataclass
class Node:
    """An inner node sends counts of `letter` up to `at` to the left; a leaf holds a box number or numbers of points."""

    letter: int = -1
    at: int = 0
    left: Node | None = None
    right: Node | None = None
    box: int = 0
    points: np.ndarray | None = None


def _cut(counts: np.ndarray) -> tuple[int, int] | None:
    """Letter and place of the cut that parts the points most evenly among those of the most spread letters; None if all are equal."""
    spread = counts.var(axis=0)
    best = None
    for letter in np.argsort(-spread, kind="stable")[:4]:
        if spread[letter] == 0:
            break
        column = counts[:, letter]
        middle = int(np.median(column))
        for at in (middle - 1, middle):
            left = int((column <= at).sum())
            if 0 < left < len(column):
                score = abs(2 * left - len(column))
                if best is None or score < best[0]:
                    best = score, int(letter), at
    return best and best[1:]


def search_tree(counts: np.ndarray, leaf_points: int = LEAF_POINTS) -> Node:
    """A k-d tree whose leaves hold at most leaf_points points, or more that are all equal."""

    def build(at: np.ndarray) -> Node:
        cut = _cut(counts[at]) if len(at) > leaf_points else None
        if cut is None:
            return Node(points=at)
        below = counts[at, cut[0]] <= cut[1]
        return Node(*cut, build(at[below]), build(at[~below]))

    return build(np.arange(len(counts)))


def box_tree(counts: np.ndarray, boxes: int) -> Node:
    """The top of a k-d tree, cut by a sample of points into about `boxes` boxes that are numbered from 0."""
    number = iter(range(1 << 62))

    def build(part: np.ndarray, n: int) -> Node:
        cut = _cut(part) if n > 1 and len(part) > 1 else None
        if cut is None:
            return Node(box=next(number))
        below = part[:, cut[0]] <= cut[1]
        left = min(n - 1, max(1, round(n * below.mean())))
        return Node(*cut, build(part[below], left), build(part[~below], n - left))

    return build(counts, boxes)


def leaves_within(tree: Node, counts: np.ndarray, more: int, fewer: int) -> Iterator[tuple[Node, np.ndarray]]:
    """Each leaf with the numbers of the rows of `counts` whose range reaches its box.

    The range holds points that have at most `more` additional letters and lack at most `fewer`; a box costs a row what its sides
    are beyond the row's counts. Sides are known from the cuts on the way down.
    """

    def down(node: Node, rows: np.ndarray, over: np.ndarray, under: np.ndarray, sides: dict[int, tuple[int, int]]) -> Iterator[tuple[Node, np.ndarray]]:
        if not len(rows):
            return
        if node.letter < 0:
            yield node, rows
            return
        low, high = sides.get(node.letter, (0, 1 << 30))
        have = counts[rows, node.letter]
        to_left = under - np.maximum(0, have - high) + np.maximum(0, have - node.at)
        keep = to_left <= fewer
        yield from down(node.left, rows[keep], over[keep], to_left[keep], sides | {node.letter: (low, node.at)})
        to_right = over - np.maximum(0, low - have) + np.maximum(0, node.at + 1 - have)
        keep = to_right <= more
        yield from down(node.right, rows[keep], to_right[keep], under[keep], sides | {node.letter: (node.at + 1, high)})

    none = np.zeros(len(counts), np.int32)
    yield from down(tree, np.arange(len(counts)), none, none, {})


#: letters that a near word may have in addition and lack, by the difference of its length
_RANGE = {0: (1, 1), 1: (1, 0), -1: (0, 1)}


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words in equal rows differ by exactly one replaced, inserted or deleted code point."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    short, long = (a, b) if a.shape[1] < b.shape[1] else (b, a)
    n = short.shape[1]
    head = np.cumprod(short == long[:, :n], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return head + tail >= n


def _masks(counts: np.ndarray) -> np.ndarray:
    """A bit for each letter held, letters 64 apart sharing one: an edit changes two bits at most."""
    out = np.zeros(len(counts), np.uint64)
    for letter in range(counts.shape[1]):
        out ^= (counts[:, letter] & 1).astype(np.uint64) << np.uint64(letter % 64)
    return out


class Box:
    """Words of one length, in code-point order, with a k-d tree over their letter counts."""

    def __init__(self, words: list[str], n: np.ndarray) -> None:
        self.words, self.n, self.letters = words, n, letters_of(words)
        self.counts = letter_counts(self.letters)
        self.masks, self.tree = _masks(self.counts), search_tree(self.counts)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number in `words`, number here) of words one edit apart; `words` are of one length."""
        letters = letters_of(words)
        counts = letter_counts(letters)
        masks = _masks(counts)
        more, fewer = _RANGE[self.letters.shape[1] - letters.shape[1]]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for leaf, rows in leaves_within(self.tree, counts, more, fewer):
            for at in range(0, len(leaf.points), 4096):  # a leaf of equal points may be large
                points = leaf.points[at : at + 4096]
                step = max(1, PAIRS // len(points))
                for k in range(0, len(rows), step):
                    part = rows[k : k + step]
                    close = np.bitwise_count(masks[part][:, None] ^ self.masks[points][None, :]) <= 2
                    i, j = np.nonzero(close)
                    i, j = part[i], points[j]
                    gap = self.counts[j] - counts[i]
                    within = (np.maximum(gap, 0).sum(axis=1) <= more) & (np.maximum(-gap, 0).sum(axis=1) <= fewer)
                    found.append((i[within], j[within]))
        pairs = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2
        keep = [one_edit(letters[pairs[0][k : k + step]], self.letters[pairs[1][k : k + step]]) for step in (max(1, PAIRS // letters.shape[1]),) for k in range(0, len(pairs[0]), step)]
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        return pairs[0][keep], pairs[1][keep]

    def summary(self, words: list[str]) -> list[tuple]:
        """(word, near words here, largest n of them, the smallest such word) of each of `words` that has any."""
        i, j = self.near(words)
        order = np.lexsort((j, -self.n[j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        sizes = np.diff(np.append(first, len(i)))
        return [(words[i[k]], int(size), int(self.n[j[k]]), self.words[j[k]]) for k, size in zip(first, sizes, strict=True)]


# over all words


def _box_words(length: int, box_words: int) -> int:
    return max(1, min(box_words, BOX_LETTERS // max(1, length)))


def _trees(words: DataFrame, box_words: int) -> dict[int, Node]:
    """Cuts for the lengths that need more than one box, from about SAMPLE_WORDS words, thinned by hash before they are sent: they
    only balance the boxes."""
    room = F.greatest(F.lit(1), F.least(F.lit(box_words), F.floor(F.lit(BOX_LETTERS) / F.greatest(F.col("length"), F.lit(1)))))
    many = words.groupBy("length").agg(F.count("*").alias("n")).where(F.col("n") > room)
    large = {r["length"]: -(-r["n"] // _box_words(r["length"], box_words)) for r in many.orderBy(F.desc("n")).limit(SAMPLE_WORDS).collect()}
    if not large:
        return {}
    sample = defaultdict(list)
    short = words.where(F.col("length") <= BOX_LETTERS // 8).select("word", "length")
    picked = short.where(F.pmod(F.xxhash64("word"), F.lit(max(1, words.count() // SAMPLE_WORDS))) == 0).limit(4 * SAMPLE_WORDS)
    for r in picked.collect():
        if r["length"] in large:
            sample[r["length"]].append(r["word"])
    return {n: box_tree(letter_counts(letters_of(found)), large[n]) for n, found in sample.items()}


_ROUTED = "length int, box int, part int, role int, word string, n long"


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], list[int]]]:
    """Words of one length at a time, in parts of bounded letters."""
    groups = defaultdict(list)
    for pair in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
        groups[len(pair[0])].append(pair)
    for length, pairs in groups.items():
        step = max(1, BOX_LETTERS // (4 * length))
        for at in range(0, len(pairs), step):
            words, n = zip(*pairs[at : at + step], strict=True)
            yield length, list(words), list(n)


def _placed(words: DataFrame, trees: dict[int, Node], parts: dict[tuple[int, int], int] | None) -> DataFrame:
    """Rows (length, box, part, role, word, n): each word as a point of its own box and, once `parts` are known, as a query of
    every box that its ranges reach: role 0 for points, 1 to 3 for queries one letter shorter, as long and one longer than the box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, some, n in _by_length(batch):
                counts = letter_counts(letters_of(some))
                for at in (length,) if parts is None else (length, length - 1, length + 1):
                    tree, (more, fewer) = trees.get(at, Node()), _RANGE[at - length]
                    if at == length:
                        for leaf, rows in leaves_within(tree, counts, 0, 0):
                            split = (parts or {}).get((at, leaf.box), 1)
                            yield _rows(at, leaf.box, [zlib.crc32(some[i].encode()) % split for i in rows], 0, some, n, rows)
                    if parts is not None:
                        for leaf, rows in leaves_within(tree, counts, more, fewer):
                            for part in range(parts.get((at, leaf.box), 1)):
                                yield _rows(at, leaf.box, [part] * len(rows), 2 + length - at, some, n, rows)

    return words.select("word", "n").mapInArrow(run, _ROUTED)


def _rows(length: int, box: int, part: list[int], role: int, words: list[str], n: list[int], rows: np.ndarray) -> pa.RecordBatch:
    m = len(rows)
    columns = [pa.array([length] * m, pa.int32()), pa.array([box] * m, pa.int32()), pa.array(part, pa.int32()), pa.array([role] * m, pa.int32()), pa.array([words[i] for i in rows], pa.string()), pa.array([n[i] for i in rows], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["length", "box", "part", "role", "word", "n"])


def near_words(words: DataFrame, box_words: int = BOX_WORDS) -> DataFrame:
    """word, n_near, best_n, best for every word (word, n; distinct) that has a word one edit away.

    n_near counts these words, best is the one of largest n (ties: the smallest in code-point order). One edit changes the letter
    counts by two at most: one letter more for an insertion, one less for a deletion, one of each for a replacement. Words of each
    length lie in boxes of a k-d tree; a word is sent to the boxes of its own and both neighbouring lengths that its range reaches,
    is searched there in the box's own tree, and pairs in range are compared letter by letter. A box holds box_words words at most,
    fewer of long ones; a box that the sampled cuts left larger, or that holds too many anagrams to be cut, is split in parts that
    all its queries visit. Pairs never leave a task, only their summary for each word does.
    """
    words = words.where(F.col("word").isNotNull() & (F.col("word") != "")).select("word", "n", F.char_length("word").alias("length"))
    trees = _trees(words, box_words)
    points = _placed(words, trees, None).groupBy("length", "box").agg(F.count("*").alias("m"))
    room = F.greatest(F.lit(1), F.least(F.lit(box_words), F.floor(F.lit(BOX_LETTERS) / F.col("length"))))
    too_large = points.where(F.col("m") > 2 * room).collect()  # at most one row for each 2 * box_words words
    parts = {(r["length"], r["box"]): -(-r["m"] // _box_words(r["length"], box_words)) for r in too_large}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, box = None, [], None
        for batch in batches:
            heads = np.stack([batch.column(c).to_numpy() for c in ("length", "box", "part", "role")])
            starts = [0, *(np.flatnonzero((np.diff(heads, axis=1) != 0).any(axis=0)) + 1).tolist()] if batch.num_rows else []
            for at, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                head, role = tuple(heads[:3, at]), heads[3, at]
                if head != key:
                    key, held, box = head, [], None
                some, n = batch.column("word")[at:end].to_pylist(), batch.column("n")[at:end].to_pylist()
                if role == 0:
                    held += zip(some, n, strict=True)
                elif held:
                    box = box or Box([w for w, _ in held], np.array([x for _, x in held], np.int64))
                    step = max(1, BOX_LETTERS // (4 * len(some[0])))
                    found = [x for k in range(0, len(some), step) for x in box.summary(some[k : k + step])]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])

    groups = ["length", "box", "part"]
    routed = _placed(words, trees, parts).repartition(*groups).sortWithinPartitions(*groups, "role", "word")
    found = routed.mapInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("x")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("x.less")).alias("best_n"), "x.best")


def follow(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) without a circle: each round jumps twice as far, until nothing moves."""
    jumps = stored(links.select("word", F.col("form").alias("root")), "jumps")
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = stored(jumps.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "jumps")
        if not after.where("moved").limit(1).count():
            return after.select("word", "root")
        jumps = after.drop("moved")


def spelling_forms(words: DataFrame, times: int = FORM_TIMES, box_words: int = BOX_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of words (word, n; distinct).

    A word's form is its near word of largest n if that is at least `times` the word's n, else null; root follows forms to the
    last. A form is more frequent than its word, so forms never lead in a circle. Words without a near word have n_near 0. No words
    give no rows; null and empty words are left out; columns beside word and n are not kept.
    """
    words = stored(words.select("word", "n"), "words")
    near = stored(near_words(words, box_words), "near")
    strong = F.col("best_n") >= times * F.col("n")
    judged = words.where(F.col("word").isNotNull() & (F.col("word") != "")).join(near, "word", "left")
    judged = judged.select("word", F.when(strong, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best_n")).alias("form_n"))
    judged = stored(judged, "forms")
    roots = follow(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
