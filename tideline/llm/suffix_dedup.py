"""Removal of long repeated byte strings by suffix arrays.

Every string of `span` bytes belongs to one anchor, chosen by its bytes alone. The regions around anchors that occur again are dealt to
shards by anchor, so equal strings meet in one shard and shards need no merging. Each shard sorts its suffixes by Larsson-Sadakane
refinement and gets the common prefixes of neighbours by Kasai's rule. Anchors with more regions than a shard holds are divided by content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.anchors import GRAM, Prints, anchors
from tideline.llm.common import BROADCAST_BYTES, broadcast_if_small, slices, stored
from tideline.llm.shingles import blocks, mix

SPAN = 400
SHARD_BYTES = 1_500_000
_STRIP = 64


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number, zeros past the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(raw), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(raw)] << np.uint64(8 * (7 - k))
    return out


def suffix_array(raw: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions sorted by their first `depth` bytes or more, their ranks then (equal bytes, equal rank), and whether a position
    shares at least half of `depth` (or 8 bytes, if that is less) with a neighbour in the order.

    Larsson-Sadakane: suffixes sorted by h bytes form groups; only groups of several are sorted again, by the rank h bytes on.
    """
    n = len(raw)
    first = _words(raw)
    order = np.argsort(first, kind="stable")
    first = first[order]
    new = np.concatenate([[True], first[1:] != first[:-1]]) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[:n][order] = start + 1  # 0 is the rank past the end
    h = 8
    unsorted = _several(start)
    close = np.zeros(n, bool)
    close[order[unsorted]] = True
    while h < depth and len(unsorted):
        at = order[unsorted]
        ahead = rank[np.minimum(at + h, n)]
        place = np.argsort(rank[at] * (n + 1) + ahead, kind="stable")
        at, ahead, own = at[place], ahead[place], rank[at[place]]
        order[unsorted] = at
        differs = np.concatenate([[True], (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])])
        start = np.maximum.accumulate(np.where(differs, unsorted, 0))
        rank[at] = start + 1
        unsorted = unsorted[_several(start)]
        h *= 2
        if h <= depth // 2:
            close[:] = False
            close[order[unsorted]] = True
    return order, rank[:n], close


def _several(start: np.ndarray) -> np.ndarray:
    """Indexes whose group start is shared with a neighbour."""
    same = np.concatenate([[False], start[1:] == start[:-1]]) if len(start) else np.zeros(0, bool)
    return np.flatnonzero(same | np.concatenate([same[1:], [False]])) if len(start) else np.zeros(0, np.int64)


def common_prefixes(raw: np.ndarray, order: np.ndarray, rank: np.ndarray, close: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix, up to `limit`, of each suffix in order with the one before; 0 for positions that are not close to any.

    Kasai: a position's common prefix is at least that of the position before it less one. Strips of neighbouring positions
    go on side by side, each from one position to the next. Suffixes of equal rank are tied at `limit` or more and in any order,
    so they need no comparison and hand nothing on.
    """
    n = len(raw)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    before[~close] = -1
    tied = np.zeros(n, bool)
    tied[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    limits = np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))  # least number of 1, 2, ... bytes
    words = np.concatenate([_words(raw), np.zeros(limit + 8, np.uint64)])
    strips = np.arange(0, n, _STRIP)
    h = np.zeros(len(strips), np.int64)
    found = np.zeros(n, np.int64)
    for step in range(_STRIP):
        at = strips + step
        live = np.flatnonzero(at < n)
        found[at[live[tied[at[live]]]]] = limit
        live = live[(before[at[live]] >= 0) & ~tied[at[live]]]
        h = np.maximum(h - 1, 0)
        dead = np.ones(len(strips), bool)
        dead[live] = False
        h[dead] = 0
        grow = live
        while len(grow):
            i = at[grow] + h[grow]
            j = before[at[grow]] + h[grow]
            apart = words[i] ^ words[j]
            same = 8 - np.searchsorted(limits, apart, side="right")
            same = np.minimum(same, n - np.maximum(i, j))
            h[grow] += same
            grow = grow[(same == 8) & (h[grow] < limit)]
        h[live] = np.minimum(h[live], limit)
        found[at[live]] = h[live]
    return found[order]


def _holds(starts: np.ndarray, n: int, span: int) -> np.ndarray:
    """Positions from which `span` bytes lie in one region."""
    ends = np.repeat(starts[1:], np.diff(starts))
    return np.arange(n) + span <= ends


def repeats_in_shard(raw: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Whether the `span` bytes from a position start anywhere else in the shard, both within a region."""
    n = len(raw)
    order, rank, close = suffix_array(raw, span)
    lcp = common_prefixes(raw, order, rank, close, span)
    fits = _holds(starts, n, span)
    run = np.cumsum(lcp < span)
    many = np.bincount(run, weights=fits[order], minlength=int(run[-1]) + 1 if n else 1)
    out = np.zeros(n, bool)
    out[order] = (many[run] > 1) & fits[order]
    return out


class Shard:
    """Regions of a shard as one byte string, and back from positions to texts."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]]) -> None:
        self.rows = rows
        self.raw = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int64)

    def spans(self, hit: np.ndarray, span: int) -> list[tuple[int, int, int, int]]:
        """Covered runs (text, n_bytes, begin, end) of windows that begin at hits."""
        cover = np.zeros(len(self.raw) + 1, np.int64)
        at = np.flatnonzero(hit)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + span, -1)
        inside = np.cumsum(cover[:-1]) > 0
        begins = np.zeros(len(inside), bool)
        begins[self.starts[:-1][self.starts[:-1] < len(inside)]] = True
        edge = np.concatenate([[True], inside[1:] != inside[:-1]]) | begins
        cut = np.append(np.flatnonzero(edge), len(inside))
        out = []
        region = np.searchsorted(self.starts, cut[:-1], side="right") - 1
        for a, b, r in zip(cut[:-1].tolist(), cut[1:].tolist(), region.tolist(), strict=True):
            if inside[a]:
                t, n, lo, _ = self.rows[r]
                base = lo - int(self.starts[r])
                out.append((t, n, base + a, base + b))
        return out


_RANGE = ["t", "n", "lo", "hi"]
_SPANS = "t long, n long, lo long, hi long"


def _span_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (zip(*rows, strict=True) if rows else ((), (), (), ()))], names=["t", "n", "lo", "hi"])


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions (a, c, t, n, lo, hi, ...) by anchor a and content c: the ranges of those that occur whole more than once, and one
    region of each content of the anchors that have several, one of them once at least. An anchor that occurs once repeats nothing."""
    twice = rows.groupBy("a").agg(F.count("*").alias("k"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("k > 1").select("a", (F.col("c1") != F.col("c2")).alias("mixed"))
    twice = stored(twice, "anchors")
    again = stored(rows.join(broadcast_if_small(twice, 24), "a"), "anchors")
    mixed = again.where("mixed")
    others = [x for x in rows.columns if x not in ("a", "c")]
    contexts = stored(mixed.groupBy("a", "c").agg(F.count("*").alias("k"), F.min(F.struct(*others)).alias("one")), "contexts")
    alike = stored(contexts.where("k > 1").select("a", "c"), "contexts")
    whole = again.where("NOT mixed").select(*_RANGE).union(mixed.join(broadcast_if_small(alike, 24), ["a", "c"]).select(*_RANGE))
    part = contexts.join(contexts.where("k = 1").select("a").distinct(), "a", "left_semi").select("a", "one.*")
    return whole, stored(part, "contexts")


def _too_large(part: DataFrame, shard_bytes: int) -> DataFrame:
    """The anchors with more bytes in their regions than a shard holds: at most one for each `shard_bytes` of the regions."""
    return stored(part.groupBy("a").agg(F.sum(F.col("hi") - F.col("lo")).alias("b")).where(F.col("b") > shard_bytes).select("a"), "anchors")


def _halves(regions: DataFrame, span: int) -> DataFrame:
    """Every region as two: of the strings that begin `near` to `far` bytes before their anchor, the nearer and the farther half.

    All strings of a half hold the same bytes around the anchor, the more the fewer they are; these and the old anchor are the new one. A
    half of a single distance has one content, so halving ends.
    """
    middle = F.floor((F.col("near") + F.col("far")) / 2)
    ends = F.array(F.struct(F.col("near").alias("u"), middle.alias("v")), F.struct((middle + 1).alias("u"), F.col("far").alias("v")))
    out = regions.withColumn("h", F.explode(ends)).where("h.u <= h.v").select("*", "h.u", "h.v")
    out = out.withColumn("x", F.expr(f"greatest(u, at - (hi - lo - {span}))")).withColumn("y", F.expr("least(v, at)")).where("x <= y")
    kernel = F.expr(f"substring(data, CAST(at - u + 1 AS INT), CAST({span} - (v - u) AS INT))")
    data = F.expr(f"substring(data, CAST(at - y + 1 AS INT), CAST({span} + y - x AS INT))")
    out = out.select(F.xxhash64("a", "u", kernel).alias("a"), "t", "n", F.expr("lo + at - y").alias("lo"), F.expr(f"lo + at - x + {span}").alias("hi"), F.col("y").alias("at"), F.col("u").alias("near"), F.col("v").alias("far"), data.alias("data"))
    return out.withColumn("c", F.xxhash64("data", "at"))


def repeated_spans(docs: DataFrame, text: str = "text", span: int = SPAN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """t, n, lo, hi: byte ranges of texts that are covered by strings of `span` bytes which also start anywhere else.

    t is the text's xxhash64 and n its bytes; ranges may overlap. Strings never cross texts; equal texts repeat each other.
    A region holds the strings of one anchor in one place. Anchors that occur once repeat nothing, and regions that occur whole again are
    covered; what is left, one region of each content, is cut out and goes to the shard of its anchor.
    """
    reach = span - min(GRAM, span)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t = batch.column(1).to_numpy(zero_copy_only=False)
            for first, _, raw, starts in blocks(batch.column(0)):
                prints = Prints(raw)
                at, a, row, lo, last = anchors(raw, starts, span, prints)
                hi = last + span
                c = prints.of(lo, hi) ^ mix((at - lo).astype(np.uint64) + np.uint64(1))
                cols = [a.view(np.int64), c.view(np.int64), t[first + row], starts[row + 1] - starts[row], lo - starts[row], hi - starts[row], at - lo]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["a", "c", "t", "n", "lo", "hi", "at"])

    texts = docs.where(F.octet_length(text) >= span).select(F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    found = stored(texts.mapInArrow(occurrences, "a long, c long, t long, n long, lo long, hi long, at long"), "anchors")
    out, part = _settle(found)

    wanted = stored(part.groupBy("t", "n").agg(F.collect_list(F.struct("a", "lo", "hi", "at")).alias("parts")), "wanted")
    size = wanted.agg(F.coalesce(F.sum(F.size("parts") * 32 + 64), F.lit(0))).first()[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # copies of a text are cut once by each task
        for batch in slices(batches, 100):
            rows, data = [], []
            for r in batch.to_pylist():
                if (r["t"], r["n"]) not in done:
                    done.add((r["t"], r["n"]))
                    raw = r["text"].encode()
                    rows += [(p["a"], r["t"], r["n"], p["lo"], p["hi"], p["at"]) for p in r["parts"]]
                    data += [raw[p["lo"] : p["hi"]] for p in r["parts"]]
            cols = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols), pa.array(data, pa.binary())], names=["a", "t", "n", "lo", "hi", "at", "data"])

    asked = broadcast_if_small(wanted, 0 if size <= BROADCAST_BYTES else 2**40)
    texts = texts.withColumn("n", F.octet_length("text").cast("long"))
    regions = texts.join(asked, ["t", "n"]).select("t", "n", "text", "parts").mapInArrow(cut, "a long, t long, n long, lo long, hi long, at long, data binary")
    regions = stored(regions.withColumns({"near": F.lit(0).cast("long"), "far": F.lit(reach).cast("long")}), "regions")

    large = _too_large(part, shard_bytes)
    ready = regions.join(F.broadcast(large), "a", "left_anti")
    while large.take(1):  # at most as often as `reach` can be halved
        halves = stored(_halves(regions.join(F.broadcast(large), "a", "left_semi"), span), "regions")
        whole, part = _settle(halves.drop("data"))
        out = out.union(whole)
        regions = stored(halves.drop("c").join(part.select("a", "t", "n", "lo"), ["a", "t", "n", "lo"], "left_semi"), "regions")
        large = _too_large(part, shard_bytes)
        ready = ready.unionByName(regions.join(F.broadcast(large), "a", "left_anti").select(*ready.columns))

    def within(members: pa.Table) -> pa.Table:
        keys = zip(*(members.column(x).to_pylist() for x in ("t", "n", "lo")), strict=True)
        rows = dict(zip(keys, members.column("data").to_pylist(), strict=True))  # a text may be cut by several tasks
        s = Shard([(*key, data) for key, data in sorted(rows.items())])
        return pa.Table.from_batches([_span_batch(s.spans(repeats_in_shard(s.raw, s.starts, span), span))])

    total = ready.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0))).first()[0]
    n = 2 * max(1, -(-total // shard_bytes))
    shards = ready.select(F.pmod(F.xxhash64("a"), F.lit(n)).alias("shard"), "t", "n", "lo", "data").repartition(min(n, 10_000), "shard")
    return out.union(shards.groupBy("shard").applyInArrow(within, _SPANS))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of a text, ordered by lo: those that touch become one."""
    for batch in batches:
        parts = batch.column(2)
        flat, row = parts.flatten(), np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False))
        shift = row.astype(np.int64) << 33  # texts are below 2^31 bytes
        lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) + shift for k in (0, 1))
        new = np.concatenate([[True], lo[1:] > np.maximum.accumulate(hi)[:-1]]) if len(lo) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        end = np.maximum.reduceat(hi, begin) if len(begin) else hi
        offsets = np.searchsorted(row[begin], np.arange(len(parts) + 1)).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(lo[begin] - shift[begin]), pa.array(end - shift[begin])], names=["lo", "hi"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), runs)], names=["__t", "__n", "__parts"])


def remove_repeats(docs: DataFrame, text: str = "text", span: int = SPAN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with spans (begin, end: maximal removed byte runs) and kept (the remaining bytes); such columns are replaced.

    A byte goes when a string of `span` bytes that covers it also starts anywhere else in any text, as the input stands. Null is empty.
    Every row stays; repeated rows of `span` bytes or more lose all. No rows give no rows.
    """
    docs = docs.drop("spans", "kept")
    ranges = repeated_spans(docs, text, span, shard_bytes).groupBy("t", "n").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("parts"))
    ranges = stored(ranges.mapInArrow(_merged, "__t long, __n long, __parts array<struct<lo: long, hi: long>>"), "ranges")
    size = ranges.agg(F.coalesce(F.sum(F.size("__parts") * 16 + 64), F.lit(0))).first()[0]
    keys = (F.xxhash64(docs[text]) == F.col("__t")) & (F.octet_length(docs[text]).cast("long") == F.col("__n"))
    joined = docs.join(broadcast_if_small(ranges, 0 if size <= BROADCAST_BYTES else 2**40), keys, "left").drop("__t", "__n")
    names, at = docs.columns, docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans, kept = [], []
            for t, parts in zip(batch.column(at), batch.column(len(names)), strict=True):
                data, runs, out, end = (t.as_py() or "").encode(), [], [], 0
                for p in parts.as_py() or []:
                    runs.append({"begin": p["lo"], "end": p["hi"]})
                for r in runs:
                    out.append(data[end : r["begin"]])
                    end = r["end"]
                out.append(data[end:])
                spans.append(runs)
                kept.append(b"".join(out))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(spans, kind), pa.array(kept, pa.binary())], names=[*names, "spans", "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(cut, f"{fields}, spans array<struct<begin: long, end: long>>, kept binary")
