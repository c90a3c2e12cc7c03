"""Totals of all subtrees of a forest by parallel tree contraction: rake leaves, compress unary chains, expand again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stored


def _chains(unary: DataFrame, values: list[str]) -> DataFrame:
    """id, bottom and the values summed from the node to the end of its chain, for nodes (id, next, values) with one child.

    Pointers double: each round a node takes over the pointer and the sum of the node it points to. A node whose pointer has
    left the chain is finished and only looked up from then on, so a chain of any length needs a round for each doubling and the
    open nodes of a round have pointers of their own.
    """
    now = stored(unary.select("id", F.col("next").alias("bottom"), *values, F.lit(False).alias("finished")), "chains")
    while not now.where("NOT finished").isEmpty():
        beyond = now.select(F.col("id").alias("bottom"), F.col("bottom").alias("further"), *[F.col(v).alias(f"{v}_more") for v in values], F.col("finished").alias("ended"))
        met = now.where("NOT finished").join(beyond, "bottom", "left")
        moved = met.select("id", F.coalesce("further", "bottom").alias("bottom"), *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values], F.coalesce("ended", F.lit(True)).alias("finished"))
        now = stored(now.where("finished").unionByName(moved), "chains")
    return now.drop("finished")


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """(id, values): each value summed over the node's subtree, itself included, for nodes (id long, parent long or null, values long).

    Rounds of joins contract the tree: chains of nodes with one child are folded into the node below them, then leaves are added to
    their parents and leave, until nothing is left. Each round keeps branching nodes only, so at most half as many leaves remain,
    and long chains do not add rounds. Afterwards the rounds are undone from the last to the first: the total of a folded node is
    what its chain held plus the total of the chain's end. Sums over a parent's leaves and counts of children are combined before
    the shuffle, so a node with any share of all children is no hot task; joins that read one chain's end for a chain with a large
    share of all nodes are split by adaptive execution. Several roots are several trees; ids are distinct; no nodes give no rows.
    """
    edges = [f"{v}_edge" for v in values]
    add = lambda v, more: (F.col(v) + F.coalesce(more, F.lit(0))).alias(v)
    # an edge to a parent holds what was folded into it; the parent is owed that as well
    active = stored(tree.select("id", "parent", *values, *[F.lit(0).cast("long").alias(e) for e in edges]), "tree")
    folded: list[DataFrame] = []
    raked: list[DataFrame] = []
    while not active.isEmpty():
        kids = active.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"), F.min("id").alias("next"), *[F.sum(e).alias(f"{e}_below") for e in edges])
        known = stored(active.join(kids, "id", "left"), "degrees")
        unary = known.where("kids = 1")
        chains = _chains(unary.select("id", "next", *[(F.col(v) + F.col(f"{v}_edge_below")).alias(v) for v in values]), values)
        folded.append(chains)
        # the end of a chain goes to where the chain's top was: the top is no other chain node's child
        tops = unary.join(unary.select(F.col("next").alias("id")), "id", "left_anti").select("id", F.col("parent").alias("above"), *edges)
        ends = chains.join(tops, "id").select(F.col("bottom").alias("id"), "above", F.lit(True).alias("ends"), *[(F.col(v) + F.col(e)).alias(f"{e}_new") for v, e in zip(values, edges, strict=True)])
        moved = known.where("kids IS NULL OR kids > 1").join(ends, "id", "left")
        rest = [F.when(F.col("ends"), F.col("above")).otherwise(F.col("parent")).alias("parent"), *[F.coalesce(f"{e}_new", e).alias(e) for e in edges]]
        rest = stored(moved.select("id", "kids", *values, *rest), "contracted")
        leaves = rest.where("kids IS NULL")
        raked.append(leaves.select("id", *values))
        given = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(*[F.sum(F.col(v) + F.col(e)).alias(f"{v}_more") for v, e in zip(values, edges, strict=True)])
        grown = rest.where("kids IS NOT NULL").join(given, "id", "left")
        active = stored(grown.select("id", "parent", *[add(v, f"{v}_more") for v in values], *edges), "tree")
    totals: list[DataFrame] = []
    for chains, leaves in zip(reversed(folded), reversed(raked), strict=True):
        totals.append(leaves)
        ends = reduce(DataFrame.unionByName, totals).select(F.col("id").alias("bottom"), *[F.col(v).alias(f"{v}_more") for v in values])
        back = chains.join(ends, "bottom").select("id", *[(F.col(v) + F.col(f"{v}_more")).alias(v) for v in values])
        totals.append(stored(back, "totals"))
    return reduce(DataFrame.unionByName, totals) if totals else active.select("id", *values)
