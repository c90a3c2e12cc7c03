"""The trie of conversations' shared beginnings, with totals of every subtree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stored
from tideline.llm.tree_sums import subtree_sums
from tideline.operators.ordered import running, sliced

#: conversations whose ids are this close share a beginning; it has fewer turns than the second number
FAMILY, HEADS = 5, 9
#: ids of one chunk of a list of members
CHUNK = 1024
_HALF = 0xFFFFFFFF


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), hashes one and two of (role, text), and the text's UTF-8 bytes, by turn (null first), role and text.

    Null roles and texts are empty. Rows without conv_id take no part; repeated rows are turns of their own.
    """
    clean = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # beginnings decide where slices are cut, so that no whole text is sampled; inside a slice rows are sorted in full
    clean = clean.withColumns({"role_begin": F.substring("role", 1, 32), "text_begin": F.substring("text", 1, 32)})
    slices = sliced(clean, ["conv"], ["turn", "role_begin", "text_begin"])
    placed = running(clean, ["conv"], ["turn", "role", "text"], {"pos": ("count", F.lit(1))}, slices=slices)
    content = F.xxhash64("role", "text"), F.xxhash64(F.lit("two"), "text", "role")
    return placed.select("conv", F.col("pos").cast("long").alias("pos"), content[0].alias("one"), content[1].alias("two"), F.octet_length("text").cast("long").alias("bytes"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations): each conversation c begins with the first h turns of conversation c - c % 5, h = crc32(c) % 9, and
    goes on with its own turns after the first h. rows: conv, pos, one, two, bytes, turns (of the conversation); conversations:
    conv and turns, those without a turn too."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    first = sizes.select(F.col("conv").alias("base"), F.least("own", F.lit(HEADS - 1)).alias("there"))
    convs = sizes.select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base")).join(first, "base", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = convs.select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns"))
    convs = stored(convs, "conversations")
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv", "base")
    columns = ["conv", "pos", "one", "two", "bytes", "turns"]
    begun = convs.join(heads, "base").where("pos <= taken").select(*columns)
    own = turns.join(convs.select("conv", "h", "taken", "turns"), "conv").where("pos > h").withColumn("pos", F.col("taken") + F.col("pos") - F.col("h"))
    return begun.unionByName(own.select(*columns)), convs.select("conv", "turns")


def _halves(x: Column) -> tuple[Column, Column]:
    return x.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(x, 32)


def prefixes(rows: DataFrame) -> DataFrame:
    """rows with key1, key2, the 128-bit name of the first `pos` turns, and above1, above2, that of the first pos - 1.

    A name is a hash of sums of hashes of (place, turn): running sums, which need no turn of a long conversation to wait for all
    before it in one task. The halves are summed apart, so no sum overflows.
    """
    halves = [p for name in ("one", "two") for p in _halves(F.xxhash64(F.lit(name), "pos", "one", "two"))]
    names = [f"part{i}" for i in range(4)]
    valued = rows.select("*", *[v.alias(n) for n, v in zip(names, halves, strict=True)])
    summed = running(valued, ["conv"], ["pos"], {f"sum{i}": ("sum", F.col(n)) for i, n in enumerate(names)})

    def name_of(pos: Column, sums: list[Column]) -> list[Column]:
        return [F.xxhash64(pos, *sums[:2]), F.xxhash64(pos, *sums[2:])]

    here, above = [F.col(f"sum{i}") for i in range(4)], [F.col(f"sum{i}") - F.col(f"part{i}") for i in range(4)]
    keys = [*name_of(F.col("pos"), here), *name_of(F.col("pos") - 1, above)]
    return summed.select("conv", "pos", "bytes", "turns", *[k.alias(n) for k, n in zip(keys, ("key1", "key2", "above1", "above2"), strict=True)])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(key1, key2, ends_sha256) of ends (key1, key2, conv): the hash of each key's ids, ascending and comma-joined.

    Ids are joined in chunks of at most CHUNK neighbouring numbers first; a key's chunks are then hashed in order as they stream
    past, so no list of ids is ever held.
    """
    chunks = ends.groupBy("key1", "key2", F.floor(F.col("conv") / F.lit(CHUNK)).alias("chunk")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    chunks = chunks.select("key1", "key2", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for one, two, ids in zip(*(batch.column(c).to_pylist() for c in ("key1", "key2", "ids")), strict=True):
                if (one, two) != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (one, two), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            if out:
                yield _digests(out)
        if key:
            yield _digests([(*key, digest.hexdigest())])

    arranged = chunks.repartition("key1", "key2").sortWithinPartitions("key1", "key2", "chunk")
    return arranged.mapInArrow(run, "key1 long, key2 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key1", "key2", "ends_sha256"])


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per distinct beginning of conversations: rows (conv, pos from 1 without gaps, one, two, bytes, turns) and convs (conv,
    turns; those without turns too).

    conv_id (the smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves and saved_tokens (over the
    subtree: childless nodes, and (n_convs - 1) * bytes of each node's last turn), ends_sha256 (members that end here). The root
    has depth 0 and no parent. No conversations give no rows.
    """
    members = stored(prefixes(rows), "prefixes")
    zero = F.lit(0).cast("long")
    start = F.xxhash64(zero, zero, zero)
    nodes = members.groupBy("key1", "key2").agg(F.min("conv").alias("conv_id"), F.min("pos").alias("depth"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("above1").alias("above1"), F.min("above2").alias("above2"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(start.alias("key1"), start.alias("key2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("bytes"), none.alias("above1"), none.alias("above2"))
    nodes = stored(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    above = nodes.select(F.col("key1").alias("above1"), F.col("key2").alias("above2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = stored(nodes.join(above, ["above1", "above2"], "left").drop("above1", "above2"), "nodes")
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    totals = subtree_sums(nodes.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = members.where("pos = turns").select("key1", "key2", "conv").unionByName(convs.where("turns = 0").select(start.alias("key1"), start.alias("key2"), "conv"))
    out = nodes.join(totals, "id").join(ends_digest(ends), ["key1", "key2"], "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie of the rebuilt conversations of (conv_id, turn, role, text); other columns are not read."""
    rows, convs = rebuilt(stored(ordered_turns(conversations), "turns"))
    return prefix_trie(rows, convs)
