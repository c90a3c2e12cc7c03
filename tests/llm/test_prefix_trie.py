"""The conversation trie and the tree contraction against plain recursion."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tideline.llm import prefix_trie, tree_sums
from tideline.llm.queries import QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(found)] for c, found in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(node)).encode()).hexdigest())
        for node, m in members.items()
    )


def rows_of(df):
    assert df.columns == COLUMNS and all(t in ("bigint", "string") for _, t in df.dtypes)
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1], r))


SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed):
    """Shared beginnings, copies, ties, repeated rows, nulls, one very long conversation, ids far apart."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), *range(2000, 2012), 10**12, 10**12 + 3, -7]:
        n = rng.choice([0, 1, 2, 5, 9, 12])
        for t in range(n):
            rows.append((c, t, rng.choice(["user", None, ""]), rng.choice(["a", "é", None, "", "long text " * 30])))
    copy = [(t, "user", f"same {t}") for t in range(12)]
    rows += [(c, *x) for c in range(100, 160) for x in copy]
    rows += [(300, t, "user", f"turn {t}") for t in range(350)]
    rows += [(400, None, "user", "b"), (400, None, "user", "a"), (400, 0, "x", "y"), (400, 0, "x", "y"), (None, 0, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_trie(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS conv", "2 AS id", "'x' AS parent", "3 AS pos")
    assert rows_of(prefix_trie.conversation_trie(df)) == sorted(brute(rows), key=lambda r: (r[0], r[1], r))


def test_hot_conversation(hot):
    rows = made(7)
    assert rows_of(prefix_trie.conversation_trie(hot.createDataFrame(rows, SCHEMA))) == sorted(brute(rows), key=lambda r: (r[0], r[1], r))


def test_small_tables(spark):
    assert rows_of(prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA))) == []
    assert rows_of(prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []
    one = [(3, None, None, None)]
    assert rows_of(prefix_trie.conversation_trie(spark.createDataFrame(one, SCHEMA))) == brute(one)


def test_long_lists_of_members(spark):
    rows = [(c * 7, 0, "user", "same") for c in range(3000)]
    got = rows_of(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted(brute(rows), key=lambda r: (r[0], r[1], r))


@pytest.mark.parametrize("shape", ["chain", "star", "random", "broom", "forest", "none"])
def test_contraction(spark, shape):
    rng = random.Random(shape)
    n = {"chain": 300, "star": 300, "none": 0}.get(shape, 400)
    parent = {
        "chain": lambda i: i - 1 if i else None,
        "star": lambda i: 0 if i else None,
        "random": lambda i: rng.randrange(max(0, i - 6), i) if i else None,
        "broom": lambda i: (i - 1 if i < 150 else 149) if i else None,
        "forest": lambda i: None if i % 40 == 0 else rng.randrange(i - i % 40, i),
        "none": lambda i: None,
    }[shape]
    rows = [(i * 11 - 5, p if p is None else p * 11 - 5, rng.randint(0, 9), 1) for i in range(n) for p in [parent(i)]]
    want = {i: [x, y] for i, _, x, y in rows}
    for i, p, _, _ in reversed(rows):
        if p is not None:
            want[p] = [a + b for a, b in zip(want[p], want[i])]
    got = tree_sums.subtree_sums(spark.createDataFrame(rows, "id long, parent long, x long, y long"), ["x", "y"]).collect()
    assert len(got) == n and {r["id"]: [r["x"], r["y"]] for r in got} == want


def test_query(spark):
    from tests.conftest import SMALL

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op13_prefix_trie"](spark, SMALL)) == sorted(brute(rows), key=lambda r: (r[0], r[1], r))
