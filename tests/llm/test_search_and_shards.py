from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import documents, empty
from tideline.llm.shard_tree import Tree, shard_slots, with_shard
from tideline.llm.topk import histogram_topk, quantized


def best(vectors: dict, queries, k: int) -> set:
    out = set()
    for q in queries:
        rows = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(rows)}
    return out


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    raw = {i: [float(x) for x in rng.normal(size=6).round(1)] for i in range(1, 150)}
    raw |= {i: [0.5, -0.5, 0.0, 1.0, 0.25, 0.0] for i in range(200, 260)}  # many ties
    bad = [(300, None), (301, [float("nan")] * 6), (302, [None] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([*raw.items(), *bad], "id long, v array<double>").withColumn("vec", F.lit("clash"))
    q = quantized(df, "id", "v")
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in raw.items()}
    assert {r["id"]: r["vec"] for r in q.collect()} == whole
    for k, bins, rows in ((7, 256, 4096), (40, 4, 16)):  # one strip, many strips and rounds
        got = {tuple(r) for r in histogram_topk(q.where("id % 20 = 0"), q, k, bins=bins, query_rows=rows, candidate_rows=rows).collect()}
        assert got == best(whole, [i for i in whole if i % 20 == 0], k)


def test_topk_small_and_empty(spark):
    df = spark.createDataFrame([(20, [1]), (21, [2, 3]), (22, []), (22, [])], "id long, vec array<long>")
    got = {tuple(r) for r in histogram_topk(df.where("id = 20"), df, 20).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == {(20, 1, 21, 2), (20, 2, 22, 0), (20, 3, 22, 0)}
    assert histogram_topk(df.limit(0), df, 3).count() == 0
    assert histogram_topk(df.where("id = 20"), df.limit(0), 3).count() == 0


def test_shards(spark):
    docs = documents(spark)
    rows = shard_slots(docs, Tree.even(40), slot_rows=1).collect()
    texts = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    slots: dict = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_slots(empty(spark), Tree.even(40)).count() == 0


def test_weights_move_rows_within_their_subtree(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "k").withColumn("region", F.lit(1))
    tree = Tree.even(40)
    out = with_shard(with_shard(with_shard(ids, "k", tree, "a"), "k", tree.grown(), "b"), "k", tree.reweighted(7, 3.0), "c").collect()
    share = Counter(r["a"] for r in out)
    assert set(share) == set(range(40)) and max(share.values()) < 1.25 * 1000 and min(share.values()) > 0.75 * 1000
    assert {r["b"] for r in out if r["a"] != r["b"]} == {40}
    # shard 7 is in rack 1 and region 0: rows that stay in other regions do not move
    assert all(r["c"] < 10 for r in out if r["a"] != r["c"])
    assert Counter(r["c"] for r in out)[7] > 2 * 1000


def test_very_many_equal_rows(spark):
    rows = shard_slots(spark.range(20_000).select(F.lit(5).alias("doc_id"), F.lit("x").alias("text")), Tree.even(40)).collect()
    assert sorted(r["slot"] for r in rows) == list(range(20_000)) and len({r["shard"] for r in rows}) == 1
