"""Streams: the same input in one batch or several gives the same table; a replay changes nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tideline.bindings import cdc_records, statement_log, table
from tideline.catalogue.cdc import order_changes, order_snapshot
from tideline.operators import cdc, health, series
from tideline.session import shared_dir
from tideline.sources import changes as ch, sinks as sk
from tideline.sources.replica import Replica
from tideline.streaming import fold, stateful as stf


def feed(spark, df, root, order, parts):
    """Files written one after the other in ``order``, one file per micro-batch."""
    n = df.count()
    rows = df.orderBy(*order).collect()
    for i in range(parts):
        piece = rows[n * i // parts : n * (i + 1) // parts]
        spark.createDataFrame(piece, df.schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def finish(q):
    q.awaitTermination()
    assert q.exception() is None


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


ORDERS = {"order": ["ts", "seq"], "op": "op"}


@pytest.mark.parametrize("parts", [1, 4])
def test_replica_does_not_depend_on_the_batches(spark, parts):
    root = shared_dir(spark, "t-upsert")
    snap, changes = order_snapshot(spark, SMALL), order_changes(spark, SMALL)
    sk.write_base(snap, f"{root}/replica", ["o_orderkey"], 4)
    stream = feed(spark, changes, root, ["ts", "seq"], parts)
    finish(sk.upsert_sink(stream, f"{root}/replica", ["o_orderkey"], f"{root}/cp", compact_after=3, **ORDERS))
    got = rows(sk.read_replica(spark, f"{root}/replica"))
    assert got == rows(cdc.cdc_apply(snap, changes, ["o_orderkey"]))
    sk.compact_replica(spark, f"{root}/replica")
    assert rows(sk.read_replica(spark, f"{root}/replica")) == got
    assert sk.compact_replica(spark, f"{root}/replica") == -1


def test_replayed_batch_and_late_compaction(spark):
    root = shared_dir(spark, "t-replay")
    snap, changes = order_snapshot(spark, SMALL), order_changes(spark, SMALL)
    sk.write_base(snap, root, ["o_orderkey"], 4)
    apply = lambda at, i: sk.apply_changes(changes.filter(F.col("ts") == at), i, root, ["o_orderkey"], **ORDERS)
    for i, at in enumerate((10, 20, 30)):
        apply(at, i)
    want = rows(sk.read_replica(spark, root))
    assert want == rows(cdc.cdc_apply(snap, changes, ["o_orderkey"]))
    apply(20, 1)
    assert rows(sk.read_replica(spark, root)) == want
    sk.compact_replica(spark, root)
    apply(30, 2)  # the last batch comes again after it was folded in
    assert rows(sk.read_replica(spark, root)) == want
    assert rows(sk.read_replica(spark, root, before=0)) == rows(snap)


def test_new_source_column_reaches_the_replica(spark):
    root = shared_dir(spark, "t-schema")
    sk.write_base(spark.createDataFrame([(1, "a")], "id int, v string"), root, ["id"], 2)
    sk.apply_changes(spark.createDataFrame([("u", 1, 1, 1, "b")], "_op string, _ts int, _seq int, id int, v string"), 0, root, ["id"])
    sk.apply_changes(spark.createDataFrame([("c", 2, 1, 2, "c", 7)], "_op string, _ts int, _seq int, id int, v string, w int"), 1, root, ["id"])
    sk.apply_changes(spark.createDataFrame([("u", 3, 1, 1, 9)], "_op string, _ts int, _seq int, id int, w int"), 2, root, ["id"])
    got = {r["id"]: (r["v"], r["w"]) for r in sk.read_replica(spark, root).collect()}
    assert got == {1: (None, 9), 2: ("c", 7)}


CHANGE = "_op string, _ts long, _seq long, k long, v string"


def test_replica_is_merged_without_a_shuffle(spark):
    root = shared_dir(spark, "t-buckets")
    sk.write_base(spark.range(1000).selectExpr("id AS k", "'a' AS v"), root, ["k"], 8)
    for i in range(3):
        sk.apply_changes(spark.createDataFrame([("u", i, 0, 7, f"b{i}"), ("d", i, 1, 50 + i, None)], CHANGE), i, root, ["k"])
    df = sk.read_replica(spark, root)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 997 and df.filter("k = 7").first()["v"] == "b2"
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("tideline_")]:
        spark.sql(f"DROP TABLE {name}")  # another session has to open it from its manifest
    assert rows(sk.read_replica(spark, root)) == rows(df)


def test_only_full_buckets_are_compacted(spark):
    root = shared_dir(spark, "t-compact")
    sk.write_base(spark.range(400).selectExpr("id AS k", "'a' AS v"), root, ["k"], 8)
    bucket = lambda k: spark.range(1).select(F.pmod(F.hash(F.lit(k).cast("long")), F.lit(8)).alias("b")).first()["b"]
    here, other = 7, next(k for k in range(8, 400) if bucket(k) != bucket(7))
    for i in range(4):
        rows_ = [("u", i, 0, here, f"b{i}")] + ([("u", i, 0, other, "once")] if i == 0 else [])
        sk.apply_changes(spark.createDataFrame(rows_, CHANGE), i, root, ["k"], compact_after=3)
    m = Replica.open(spark, root).manifest
    assert set(m.floors) == {str(bucket(here))} and m.pending == {str(bucket(here)): 1, str(bucket(other)): 1}
    parts = spark.read.parquet(f"{root}/data")
    compacted = parts.filter(F.col("_at") == m.floors[str(bucket(here))])
    assert 0 < compacted.count() < 400 and {r["b"] for r in compacted.select(F.pmod(F.hash("k"), F.lit(8)).alias("b")).distinct().collect()} == {bucket(here)}
    want = sorted([(k, "b3" if k == here else "once" if k == other else "a") for k in range(400)], key=str)
    assert rows(sk.read_replica(spark, root)) == want
    for i in range(4, 12):  # old versions and the parts that only they name go
        sk.apply_changes(spark.createDataFrame([("u", i, 0, k, "z") for k in range(400)], CHANGE), i, root, ["k"], compact_after=2)
    assert {r["v"] for r in sk.read_replica(spark, root).collect()} == {"z"} and sk.read_replica(spark, root).count() == 400
    assert spark.read.parquet(f"{root}/data").select("_at").distinct().count() <= 8


def test_a_late_older_change_loses_against_a_compacted_delete(spark):
    root = shared_dir(spark, "t-late")
    sk.apply_changes(spark.createDataFrame([("c", 1, 1, 1, "a"), ("c", 1, 2, None, "n")], CHANGE), 0, root, ["k"], buckets=2)
    sk.apply_changes(spark.createDataFrame([("d", 9, 1, 1, None)], CHANGE), 1, root, ["k"])
    sk.compact_replica(spark, root)
    sk.apply_changes(spark.createDataFrame([("u", 5, 1, 1, "late"), ("u", 5, 2, 2, "new")], CHANGE), 2, root, ["k"])
    assert rows(sk.read_replica(spark, root)) == [(2, "new"), (None, "n")]
    sk.apply_changes(spark.createDataFrame([], CHANGE), 3, root, ["k"])
    assert sk.read_replica(spark, root).count() == 2
    with pytest.raises(ValueError):
        sk.write_base(spark.createDataFrame([(1, 2)], "k long, _at long"), shared_dir(spark, "t-taken"), ["k"])
    with pytest.raises(ValueError):
        sk.read_replica(spark, shared_dir(spark, "t-none"))


def test_change_messages(spark):
    root = shared_dir(spark, "t-json")
    lines = [
        '{"op":"c","ts":1,"seq":1,"id":"m1","after":{"k":1,"v":"a"}}',
        '{"op":"d","ts":2,"seq":1,"id":"m2","before":{"k":1,"v":"a"}}',
        '{"op":"r","ts":1,"seq":2,"id":"m3","after":{"k":2,"v":"b"},"source":{"db":"x"}}',
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{root}/in")
    finish(sk.append_sink(ch.change_stream(spark, f"{root}/in", "k int, v string"), f"{root}/out", f"{root}/cp"))
    got = {(r["_op"], r["k"], r["v"]) for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == {("c", 1, "a"), ("d", 1, "a"), ("r", 2, "b")}


@pytest.mark.parametrize("parts", [3])
def test_monitor_stream_equals_batch(spark, parts):
    stf.use_rocksdb(spark)
    root = shared_dir(spark, "t-monitor")
    records = cdc_records(spark, SMALL)
    stream = feed(spark, records, root, ["ts", "seq"], parts)
    finish(sk.append_sink(stf.sync_monitor_stream(stream, "job_id"), f"{root}/out", f"{root}/cp"))
    got = spark.read.parquet(f"{root}/out")
    assert rows(got) == rows(cdc.sync_monitor(records, "job_id").select(*got.columns))


@pytest.mark.parametrize("parts", [1, 3])
def test_ewma_stream_equals_batch(hot, parts):
    root = shared_dir(hot, "t-ewma")
    log = statement_log(hot, SMALL).select("client_uuid", "execution_time", "timestamp", F.col("id").cast("long").alias("id"))
    stream = feed(hot, log, root, ["timestamp", "id"], parts)
    finish(fold.ewma_stream(stream, "client_uuid", "execution_time", ["timestamp", "id"], f"{root}/out", f"{root}/cp", buckets=4))
    want = {r["client_uuid"]: r for r in health.ewma_per_statement(log, "client_uuid", "execution_time", ["timestamp", "id"]).collect()}
    got = sk.read_replica(hot, f"{root}/out").collect()
    assert len(got) == len(want)
    for r in got:
        assert r["executions"] == want[r["client_uuid"]]["executions"]
        assert r["ewma"] == pytest.approx(want[r["client_uuid"]]["ewma"], rel=1e-9)


def test_retained_events_leave_as_newer_ones_arrive(spark):
    root = shared_dir(spark, "t-retain")
    data = [(i, None if i % 5 == 0 else f"s{i % 3}", 100 * (i * 37 % 60)) for i in range(60)]
    df = spark.createDataFrame(data, "id long, s string, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    for k in range(4):
        part = df.filter(F.col("id").between(15 * k, 15 * k + 14))
        part.unionByName(df.filter(F.col("id") == 15 * k)).unionByName(df.filter(F.col("id") == 3)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    for name, n, by, age in [("subject", 4, ["s"], None), ("all", 7, [], None), ("both", 3, ["s"], "20 minutes"), ("age", None, [], "20 minutes")]:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        finish(fold.retain_stream(stream, ["id"], ["ts"], f"{root}/{name}", f"{root}/cp-{name}", n, by, age, buckets=2))
        keep = [r for r in data if not age or r[2] >= max(x[2] for x in data) - 1200]
        groups: dict = {}
        for r in sorted(keep, key=lambda r: -r[2]):
            groups.setdefault(r[1] if by else 0, []).append(r[0])
        want = {i for g in groups.values() for i in (g if n is None else g[:n])}
        assert {r["id"] for r in sk.read_replica(spark, f"{root}/{name}").collect()} == want, name


def test_duplicates_within_the_window_of_arrival(spark):
    root = shared_dir(spark, "t-dedup")
    schema = "id string, ts timestamp"
    base = "2024-01-01 00:00:"
    batches = [[("a", base + "00"), ("b", base + "01")], [("a", base + "50")], [("z", "2024-01-01 01:00:00")], [("late", base + "05")], [("a", "2024-01-01 02:00:30")]]
    for b in batches:
        df = spark.createDataFrame(b, "id string, ts string").select("id", F.col("ts").cast("timestamp").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    finish(sk.append_sink(stf.stream_dedup(stream, "id"), f"{root}/out", f"{root}/cp"))
    got = sorted(r["id"] for r in spark.read.parquet(f"{root}/out").collect())
    # the window is over arrival: a first-seen message stays however old it is
    assert got == ["a", "b", "late", "z"]


def test_windows_run_on_a_stream(spark):
    root = shared_dir(spark, "t-window")
    ev = table(spark, SMALL, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "view", "hit").otherwise("miss").alias("outcome"))
    stream = feed(spark, ev, root, ["ts"], 2)
    out = series.tumbling_outcomes(stream.withWatermark("ts", "1 hour"), "1 day")
    q = out.writeStream.format("memory").queryName("t_window").outputMode("complete").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
    finish(q)
    assert rows(spark.table("t_window")) == rows(series.tumbling_outcomes(ev, "1 day"))


def test_shared_folder_is_read_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_dir(spark, "x")
    assert "/x-" in path and (root is None or path.startswith(root))
    assert shared_dir(spark, "x") != path


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session(), "x")


def test_fold_stream_goes_on_after_a_restart(hot):
    """Two runs from one checkpoint, new files in between; hot keys are cut into slots."""
    root = shared_dir(hot, "t-fold")
    records = cdc_records(hot, SMALL)
    half = records.count() // 2
    for cond in (F.col("seq") < half, F.col("seq") >= half):
        records.filter(cond).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = hot.readStream.schema(records.schema).parquet(f"{root}/in")
        finish(fold.monitor_fold_stream(stream, "job_id", f"{root}/out", f"{root}/cp"))
    got = hot.read.parquet(f"{root}/out/rows").drop("batch_id")
    want = cdc.sync_monitor(records, "job_id")
    assert rows(got) == rows(want.select(*got.columns))


def test_a_replayed_fold_starts_from_the_states_before_it(spark):
    from tideline.operators.ordered import fold_states, ordered_fold

    records = cdc_records(spark, SMALL)
    narrow, step, schema = cdc.monitor_fold(records, "job_id")
    half = narrow.count() // 2
    a, b = narrow.filter(F.col("seq") < half), narrow.filter(F.col("seq") >= half)
    states = fold_states(a, ["job_id"], ["ts", "seq"], step)
    second = ordered_fold(b, ["job_id"], ["ts", "seq"], step, schema, states)
    want = cdc.sync_monitor(records, "job_id").filter(F.col("seq") >= half)
    assert rows(second) == rows(want)


def test_counter_steps_wait_for_late_samples(spark):
    import random

    stf.use_rocksdb(spark)
    root = shared_dir(spark, "t-counter")
    rng = random.Random(4)
    rows_ = []
    for series_, start in (("a", 10**6), ("b", 10**6 + 5)):
        value = 0.0
        for t in range(200):
            value = 0.0 if rng.random() < 0.05 else value + rng.randrange(4)
            rows_.append((start + 10 * t, "c", {"x": series_} if series_ == "a" else {}, value))
    order = sorted(range(len(rows_)), key=lambda i: rows_[i][0] + rng.choice([0, 0, 0, 250]))  # up to 250 s late
    schema = "sec long, name string, labels map<string,string>, value double"
    for k in range(0, len(order), 80):
        part = spark.createDataFrame([rows_[i] for i in order[k : k + 80]], schema).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    end = spark.createDataFrame([(10**9, "end", {}, 0.0)], schema).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    end.write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    steps = stf.counter_steps_stream(stream, "600 seconds")
    finish(sk.append_sink(steps, f"{root}/out", f"{root}/cp"))
    samples = spark.createDataFrame(rows_, schema).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    want = series.counter_steps(samples).select("name", "_labels", "ts", "value", "step")
    assert rows(spark.read.parquet(f"{root}/out")) == rows(want)


class _Store:
    """A state variable in memory that counts its calls."""

    def __init__(self) -> None:
        self.held, self.calls = {}, 0

    def _called(self, out=None):
        self.calls += 1
        return out

    def exists(self):
        return self._called(() in self.held)

    def get(self):
        return self._called(self.held[()])

    def update(self, value):
        self._called(self.held.update({(): value}))

    def clear(self):
        self._called(self.held.clear())

    def keys(self):
        return self._called(iter(list(self.held)))

    def iterator(self):
        return self._called(iter(list(self.held.items())))

    def getValue(self, key):
        return self._called(self.held[key])

    def updateValue(self, key, value):
        self._called(self.held.update({key: value}))

    def removeKey(self, key):
        self._called(self.held.pop(key))


def test_counter_steps_call_the_store_by_slices_not_samples(spark, monkeypatch):
    """One series in three micro-batches with late, repeated and waiting samples: few calls, steps as over the sorted samples."""
    import random
    from types import SimpleNamespace

    import pandas as pd

    made = []
    monkeypatch.setattr(stf, "CounterProcessor", lambda *a, real=stf.CounterProcessor: made.append(real(*a)) or made[-1])
    schema = "ts timestamp, name string, labels map<string,string>, value double"
    spark.createDataFrame([], schema).write.parquet(empty := f"{shared_dir(spark, 't-empty')}/in")
    stf.counter_steps_stream(spark.readStream.schema(schema).parquet(empty), "1 hour")
    p, stores, timers = made[0], [], set()
    new = lambda *a: stores.append(_Store()) or stores[-1]
    p.init(SimpleNamespace(getMapState=new, getValueState=new, registerTimer=timers.add, deleteTimer=timers.discard))
    rng, second = random.Random(2), 1_000_000
    samples = [(1_700_000_000 * second + i * second + rng.randrange(second), float(rng.randrange(50))) for i in range(20_000)]
    came = sorted(samples, key=lambda s: s[0] + rng.choice([0, 0, 1500 * second]))
    out = []
    for i in range(3):
        rows = pd.DataFrame(came[i * 7000 : (i + 1) * 7000], columns=["micros", "value"])
        list(p.handleInputRows(("s",), iter([rows[:4000], pd.concat([rows[4000:], rows[:5]]), rows[:0]]), None))
        mark = min([s[0] for s in came[(i + 1) * 7000 :]], default=10**18) // 1000 - 1
        while timers and min(timers) <= mark:
            timers.discard(min(timers))
            out += [part for part in p.handleExpiredTimer(("s",), SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m), None)]
    got = pd.concat(out)
    steps = [0.0] + [b - a if b >= a else b for (_, a), (_, b) in zip(samples, samples[1:])]
    assert list(zip(got["micros"], got["value"], got["step"])) == [(*s, d) for s, d in zip(samples, steps)]
    assert sum(s.calls for s in stores) < 5000
