"""Helpers of the operators: stored tables, checked broadcasts, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import shared_dir

#: a table is sent to all executors only below this many bytes
BROADCAST_BYTES = 32_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once to the shared folder and read again: lineage ends here and no executor holds the only copy."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint when the counted rows of a stored table fit; else the table itself, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def slices(batches, rows: int = 1000):
    """Arrow batches of at most `rows` rows: what a task makes of one is bounded by that."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def components(edges: DataFrame, kind: str = "long") -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component the least node it reaches.

    Large-star and small-star steps in turn, on written tables, until no edge changes; the edges end as stars around the
    least nodes. Each step groups edges by a node with a map-side minimum, so a hub costs one row per task. Nodes are any type
    Spark can order. Null nodes are ignored; no edges give no rows.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "edges")
    while True:
        # every neighbour above a node is tied to the least node next to it
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every neighbour below a node, and the node, are tied to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        after = stored(down.distinct(), "edges")
        if _same(pairs, after):
            break
        pairs = after
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct())


def _same(one: DataFrame, two: DataFrame) -> bool:
    def print_of(df: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())

    return print_of(one) == print_of(two)
