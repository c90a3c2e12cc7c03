"""Sharding by a weighted hash tree: region, rack, shard."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import broadcast_if_small, stored

#: rows numbered by one task
SLOT_ROWS = 100_000
_UNIT = float(2**53)


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """Leaves of the tree. A rack or region weighs what its leaves weigh."""

    leaves: tuple[Leaf, ...]

    @staticmethod
    def even(shards: int, per_rack: int = 5, racks: int = 2) -> Tree:
        """Shards 0 .. shards - 1, `per_rack` to a rack and `racks` to a region."""
        return Tree(tuple(Leaf(i // (per_rack * racks), i // per_rack, i) for i in range(shards)))

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own: no draw among the others changes, so rows move only into it."""
        top = max(self.leaves, key=lambda x: x.shard)
        return Tree((*self.leaves, Leaf(max(x.region for x in self.leaves) + 1, max(x.rack for x in self.leaves) + 1, top.shard + 1, weight)))

    def reweighted(self, shard: int, weight: float) -> Tree:
        """Another weight for a shard: rows move only between subtrees on the path to it and their siblings."""
        return Tree(tuple(replace(x, weight=weight) if x.shard == shard else x for x in self.leaves))

    def children(self, level: str, parent: str | None) -> dict[int, dict[int, float]]:
        """parent id -> child id -> weight."""
        found: dict[int, dict[int, float]] = {}
        for leaf in self.leaves:
            if leaf.weight > 0:
                below = found.setdefault(getattr(leaf, parent) if parent else 0, {})
                child = getattr(leaf, level)
                below[child] = below.get(child, 0.0) + leaf.weight
        return found


def _descend(key: Column, tree: Tree, level: str, parent: str | None, at: Column) -> Column:
    """The child of least -ln(u) / weight, where u in (0, 1) is a hash of key, level and child."""
    options = tree.children(level, parent)
    entries = [F.array(*(F.struct(F.lit(c).alias("id"), F.lit(float(w)).alias("w")) for c, w in sorted(below.items()))) for _, below in sorted(options.items())]
    table = F.map_from_arrays(F.array(*map(F.lit, sorted(options))), F.array(*entries))

    def draw(c: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(level), c["id"], key), 11).cast("double")
        return F.struct((-F.log((bits + 0.5) / _UNIT) / c["w"]).alias("draw"), c["id"].alias("id"))

    return F.array_min(F.transform(F.element_at(table, at), draw))["id"]


def with_shard(df: DataFrame, key: str, tree: Tree, to: str = "shard") -> DataFrame:
    """df with the shard of `key` in column `to` (a column of that name is replaced). No shuffle.

    The descent draws a region, a rack of it and a shard of that; a child wins with a chance in proportion to its weight. Equal
    keys get equal shards; a null key is a key like any other. A change of a weight changes only draws along its path.
    """
    k, names = F.coalesce(F.col(key).cast("string"), F.lit("")), ("__region", "__rack")
    out = df.withColumn(names[0], _descend(k, tree, "region", None, F.lit(0)))
    out = out.withColumn(names[1], _descend(k, tree, "rack", "region", F.col(names[0])))
    return out.withColumn(to, _descend(k, tree, "shard", "rack", F.col(names[1]))).drop(*names)


def shard_slots(docs: DataFrame, tree: Tree, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law `key`, shard, slot and grown_shard of every row of docs (doc_id, text).

    size is the UTF-8 bytes of the text (null: none) plus 16, text_crc32 that of the bytes (null: none, so 0). Slots are gapless
    from 0 in each shard: equal rows are counted first, buckets of a shard are numbered by themselves and start where the one
    before ends, so neither a shard nor a repeated row is one task's work. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    rows = with_shard(with_shard(rows, "doc_id", tree), "doc_id", tree.grown(), "grown_shard")
    buckets = max(1, docs.count() // (len(tree.leaves) * slot_rows))
    rows = stored(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets))), "slots")
    sizes = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "slots")
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    rows = rows.join(broadcast_if_small(sizes, 48), ["shard", "bucket"])
    block = 4096  # copies written out at once
    rows = rows.withColumn("part", F.explode(F.expr(f"sequence(0L, (copies - 1) div {block})")))
    rows = rows.withColumn("copy", F.explode(F.expr(f"sequence(part * {block}, least(copies, (part + 1) * {block}) - 1)")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("ahead") + F.col("copy")).alias("slot"), "grown_shard")


def write_shards(df: DataFrame, key: str, tree: Tree, path: str, files_per_shard: int = 1) -> None:
    """Parquet folders shard=N below path; a shard is written by `files_per_shard` tasks."""
    out = with_shard(df, key, tree).withColumn("__file", F.pmod(F.xxhash64(key), F.lit(files_per_shard)))
    out.repartition(len(tree.leaves) * files_per_shard, "shard", "__file").drop("__file").write.partitionBy("shard").parquet(path)
