"""Groups that cross slices must give what whole groups give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.oracle import connect, difference
from tideline.catalogue import all_oracles, all_queries
from tideline.operators import health
from tideline.operators.ordered import numbered, previous, sliced

NAMES = [
    "result_blocks", "insert_rows", "latency_percentiles", "speedup", "ewma_per_statement", "dirty_transaction",
    "failure_breaker", "cdc_state_machine", "sync_monitor", "counter_increase", "group_to_list", "nested_orders",
    "rules_by_table", "write_catch_up_compat",
]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_sliced_equals_sql(hot, con, name):
    diff = difference(all_queries()[name](hot, SMALL), con, all_oracles()[name])
    assert diff is None, diff


def skewed(spark, n=3000, seed=5):
    """A third of the rows has one key; some keys and values are NULL; many rows share one time."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.34 else rnd.choice([None, *[f"k{j}" for j in range(40)]])
        ts = 100 if rnd.random() < 0.3 else rnd.randrange(1000)
        rows.append((i, key, ts, rnd.choice([None, *range(50)]), rnd.random() < 0.4))
    return rows, spark.createDataFrame(rows, "id int, key string, ts bigint, x int, ok boolean")


def test_hot_key_is_cut_evenly(hot):
    rows, df = skewed(hot)
    hot.conf.set("tideline.slice.rows", "200")
    s = sliced(df, ["key"], ["ts", "id"])
    found = s.df.groupBy("_slice").agg(F.count("*").alias("n"), F.min(F.struct("key", "ts", "id")).alias("a"), F.max(F.struct("key", "ts", "id")).alias("b")).orderBy("_slice").collect()
    assert sum(r["n"] for r in found) == len(rows) and len(found) == s.slices >= 10
    assert max(r["n"] for r in found) < 500
    place = lambda r: tuple((v is not None, v) for v in r)
    assert all(place(x["b"]) < place(y["a"]) for x, y in zip(found, found[1:]))


def test_numbered_and_previous(hot):
    rows, df = skewed(hot)
    got = {r["id"]: r for r in previous(numbered(df, ["key"], ["ts", "id"]), ["key"], ["ts", "id"], ["x"]).collect()}
    by_key: dict = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        by_key.setdefault(r[1], []).append(r)
    for seq in by_key.values():
        before = None
        for i, r in enumerate(seq, start=1):
            assert got[r[0]]["rn"] == i
            assert got[r[0]]["prev_x"] == before
            before = r[3]


def test_global_numbering(hot):
    rows, df = skewed(hot)
    got = sorted((r["rn"], r["ts"], r["id"]) for r in numbered(df, [], ["ts", "id"]).collect())
    want = [(i, r[2], r[0]) for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), start=1)]
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_ewma_matches_the_recurrence(hot, seed):
    rows, df = skewed(hot, seed=seed)
    got = {r["key"]: r for r in health.ewma_per_statement(df, "key", "x", ["ts", "id"]).collect()}
    want: dict = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        if r[1] is None or r[3] is None:
            continue
        avg, n = want.get(r[1], (None, 0))
        want[r[1]] = (float(r[3]) if avg is None else (avg * 4 + r[3]) / 5, n + 1)
    assert set(got) == set(want)
    for k, (avg, n) in want.items():
        assert got[k]["executions"] == n
        assert got[k]["ewma"] == pytest.approx(avg, rel=1e-9)


@pytest.mark.parametrize("seed", [1, 2])
def test_breaker_matches_a_loop(hot, seed):
    rows, df = skewed(hot, seed=seed)
    out = health.failure_breaker(df.filter(F.col("key").isNotNull()), "key", ["ts", "id"], "ok", 3, 60)
    got = {r["id"]: (r["refused"], r["failures"]) for r in out.collect()}
    state: dict = {}
    for i, key, ts, _, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        if key is None:
            continue
        n, until = state.get(key, (0, 0))
        refused = n >= 3 and ts <= until
        if not refused:
            n, until = (0, 0) if ok else (n + 1, max(until, ts + 60) if n + 1 >= 3 else until)
        state[key] = (n, until)
        assert got[i] == (refused, n)


def test_many_rows_per_instant(hot):
    """Above 1000 rows a group, with a map beside the order columns."""
    from tideline.operators import relational, series

    rng = random.Random(3)
    rows = [(f"2024-01-01 00:0{i % 3}:00", "m", {"host": f"h{i}", "zone": "z"}, rng.choice([1.0, 2.0, float(i)])) for i in range(7000)]
    samples = hot.createDataFrame(rows, "ts string, name string, labels map<string,string>, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(str(r["ts"]), r["place"], r["labels"]["host"]) for r in series.topk(samples, 2000).collect()}
    want = set()
    for ts in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == ts), key=lambda r: (-r[3], sorted(r[2].items())))
        want |= {(ts, i, r[2]["host"]) for i, r in enumerate(group[:2000], start=1)}
    assert got == want and len(got) == 6000
    few = relational.top_k_per_instant(samples, "ts", [F.desc("value"), F.asc(F.col("labels")["host"])], 1500)
    assert few.groupBy("ts").count().filter("count = 1500").count() == 3
