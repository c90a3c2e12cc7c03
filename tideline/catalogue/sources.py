"""Reading, cataloguing and growing tables; replication with streams."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from tideline.bindings import RECORDS_SQL, cdc_records, counters, statement_log, table
from tideline.catalogue.base import query
from tideline.catalogue.cdc import APPLIED, SHOWN, _fold, order_changes, order_snapshot
from tideline.catalogue.health import BREAKER, EWMA, breaker_calls
from tideline.catalogue.series import K, STEPS, WINDOWED, _r, _text
from tideline.operators import series as se
from tideline.operators.cdc import MONITOR_SCHEMA
from tideline.session import shared_dir
from tideline.sources import catalog as ct, changes as ch, sinks as sk, snapshot as sn
from tideline.streaming import fold as fo, stateful as stf

ROW = "id bigint, seq bigint, op string"
BUCKETS = 16

# ---- reading -----------------------------------------------------------------


@query("snapshot_read", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def snapshot_read(spark, sf):
    return sn.snapshot_read(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("snapshot_splits", 'SELECT min(o_orderkey) AS lower, max(o_orderkey) AS upper, count(*) AS "rows", CAST(ceil(count(*) / 8096.0) AS BIGINT) AS partitions FROM orders')
def snapshot_splits(spark, sf):
    return sn.plan_splits(sn.key_bounds(table(spark, sf, "orders"), "o_orderkey"))


NAMES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query("table_catalog", f"""SELECT table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY column_index) AS INTEGER) AS ordinal, column_name FROM duckdb_columns()
WHERE table_name IN ({', '.join(repr(n) for n in NAMES)})""")
def table_catalog(spark, sf):
    listing = ct.table_catalog(spark, {n: table(spark, sf, n) for n in NAMES})
    return listing.select("table_name", "ordinal", "column_name")


# three key columns per invented table, one per supplier; tables without a key give rows without a column
KEYS_SQL = """keys AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'T' ELSE 't' END || (s_suppkey // 3) AS table_name, 3 - s_suppkey % 3 AS key_seq,
CASE WHEN s_suppkey // 3 % 9 <> 4 THEN 'c' || s_suppkey END AS column_name FROM supplier),
kc AS (SELECT lower(table_name) AS table_name, COALESCE(string_agg(column_name, ',' ORDER BY key_seq), '') AS key_columns FROM keys GROUP BY 1)"""


def _keys(spark, sf):
    s = F.col("s_suppkey")
    owner = F.floor(s / 3)
    rows = table(spark, sf, "supplier").select(
        F.concat(F.when(s % 2 == 0, "T").otherwise("t"), owner.cast("string")).alias("table_name"), (F.lit(3) - s % 3).alias("key_seq"),
        F.when(owner % 9 != 4, F.concat(F.lit("c"), s.cast("string"))).alias("column_name"),
    )
    return ct.key_catalog(rows)


@query("key_catalog", f"WITH {KEYS_SQL} SELECT * FROM kc")
def key_catalog(spark, sf):
    return _keys(spark, sf)


@query("sink_mode", f"""WITH {KEYS_SQL}, t AS (SELECT 'T' || c_custkey AS table_name FROM customer)
SELECT t.table_name, kc.key_columns, CASE WHEN kc.key_columns IS NULL THEN 'default' WHEN kc.key_columns = '' THEN 'append' ELSE 'upsert' END AS mode
FROM t LEFT JOIN kc ON lower(t.table_name) = kc.table_name""")
def sink_mode(spark, sf):
    tables = table(spark, sf, "customer").select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("table_name"))
    return ct.sink_mode(tables, _keys(spark, sf))


# ---- streams -----------------------------------------------------------------


def _envelopes(spark, sf):
    """Change records of the orders as JSON messages; every fifth one is delivered twice."""
    rows = order_changes(spark, sf)
    row = F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("seq"), F.col("o_orderstatus").alias("op"))
    deleted = F.col("op") == "d"
    message = rows.select(
        "op", "ts", "seq", F.concat_ws("-", "o_orderkey", "ts", "seq").alias("id"),
        F.when(deleted, row).alias("before"), F.when(~deleted, row).alias("after"),
    )
    return message.unionByName(message.filter(F.col("after.id") % 5 == 1))


def _run(q):
    q.awaitTermination()
    return q


@contextmanager
def _local_state_partitions(spark):
    """A stateful stream opens one store per shuffle partition; on one machine 8 are enough."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set(key, str(min(int(before), 8)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query("change_stream", APPLIED)
def change_stream(spark, sf):
    """Change files -> stream -> keyed replica over the snapshot -> its rows; the table's columns are named like the envelope's."""
    root = shared_dir(spark, "change-stream")
    _envelopes(spark, sf).write.json(f"{root}/in")
    names = dict(zip(("o_orderkey", "o_custkey", "o_orderstatus"), ("id", "seq", "op")))
    sk.write_base(order_snapshot(spark, sf).withColumnsRenamed(names), f"{root}/replica", ["id"], BUCKETS)
    stream = ch.change_stream(spark, f"{root}/in", ROW)
    _run(sk.upsert_sink(stream, f"{root}/replica", ["id"], f"{root}/cp", buckets=BUCKETS))
    return sk.read_replica(spark, f"{root}/replica").withColumnsRenamed({v: k for k, v in names.items()})


@query("upsert_sink", APPLIED)
def upsert_sink(spark, sf):
    """Several micro-batches, one of them written twice, buckets compacted after two of them, then all."""
    root = shared_dir(spark, "upsert-sink")
    changes = order_changes(spark, sf)
    sk.write_base(order_snapshot(spark, sf), root, ["o_orderkey"], BUCKETS)
    for batch_id, at in [(0, 10), (1, 20), (1, 20), (2, 30)]:
        sk.apply_changes(changes.filter(F.col("ts") == at), batch_id, root, ["o_orderkey"], ["ts", "seq"], "op", compact_after=2)
    sk.compact_replica(spark, root)
    return sk.read_replica(spark, root)


@query("append_sink", "SELECT event_id, user_id, event_type FROM events")
def append_sink(spark, sf):
    root = shared_dir(spark, "append-sink")
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    ev.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{root}/in")
    _run(sk.append_sink(stream, f"{root}/out", f"{root}/cp"))
    return spark.read.parquet(f"{root}/out")


@query("stream_dedup", "SELECT event_id, event_type FROM events")
def stream_dedup(spark, sf):
    """Every event is sent, a third of them twice; each id leaves once."""
    root = shared_dir(spark, "dedup")
    ev = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    ev.unionByName(ev.filter(F.col("event_id") % 3 == 0)).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{root}/in")
    with _local_state_partitions(spark):
        _run(sk.append_sink(stf.stream_dedup(stream, "event_id"), f"{root}/out", f"{root}/cp"))
    return spark.read.parquet(f"{root}/out").select("event_id", "event_type")


@query("checkpointed_run", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def checkpointed_run(spark, sf):
    """Runs twice from one checkpoint; the second run finds nothing new."""
    root = shared_dir(spark, "checkpointed")
    ev = table(spark, sf, "events").select("event_id", "event_type")
    ev.write.parquet(f"{root}/in")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    for _ in range(2):
        stream = spark.readStream.schema(ev.schema).parquet(f"{root}/in")
        _run(sk.checkpointed_run(stream, write, f"{root}/cp"))
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _in_time_order(spark, df, root, cut, parts=3):
    """Write ``df`` as ``parts`` files, one after the other along ``cut`` (a value in [0, parts))."""
    for i in range(parts):
        df.filter(cut == i).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


@query("event_log_read", RECORDS_SQL.replace("records AS (", "WITH records AS (", 1) + " SELECT job_id, count(*) AS n, max(ts) AS last_ts FROM records GROUP BY 1")
def event_log_read(spark, sf):
    root = shared_dir(spark, "event-log")
    records = cdc_records(spark, sf)
    records.write.json(f"{root}/in")
    stream = ch.event_log_read(spark, f"{root}/in", records.schema)
    _run(sk.append_sink(stream, f"{root}/out", f"{root}/cp"))
    return spark.read.parquet(f"{root}/out").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


@query("sync_monitor_stream", _fold("true") + SHOWN)
def sync_monitor_stream(spark, sf):
    """The state machine as a stateful stream over three micro-batches."""
    stf.use_rocksdb(spark)
    root = shared_dir(spark, "monitor")
    records = cdc_records(spark, sf)
    stream = _in_time_order(spark, records, root, F.floor(F.col("seq") * 3 / _size(records, "seq")))
    out = stf.sync_monitor_stream(stream, "job_id")
    with _local_state_partitions(spark):
        _run(sk.append_sink(out, f"{root}/out", f"{root}/cp"))
    return spark.read.parquet(f"{root}/out").select("job_id", "ts", "seq", *MONITOR_SCHEMA.names)


def _size(df, col):
    return df.agg((F.max(col) + 1).alias("n")).first()["n"]


@query("ewma_stream", EWMA + "SELECT client_uuid, round(ewma, 4) AS ewma, executions FROM e")
def ewma_stream(spark, sf):
    """Running averages over three micro-batches, kept by the keyed replica."""
    root = shared_dir(spark, "ewma")
    log = statement_log(spark, sf).select("client_uuid", "execution_time", "timestamp", F.col("id").cast("long").alias("id"))
    stream = _in_time_order(spark, log, root, F.floor(F.col("id") * 3 / _size(log, "id")))
    _run(fo.ewma_stream(stream, "client_uuid", "execution_time", ["timestamp", "id"], f"{root}/out", f"{root}/cp", buckets=BUCKETS))
    return sk.read_replica(spark, f"{root}/out").select("client_uuid", F.round("ewma", 4).alias("ewma"), "executions")


@query("monitor_fold_stream", _fold("true") + SHOWN)
def monitor_fold_stream(spark, sf):
    """The same machine, every micro-batch folded with the batch operator."""
    root = shared_dir(spark, "monitor-fold")
    records = cdc_records(spark, sf)
    stream = _in_time_order(spark, records, root, F.floor(F.col("seq") * 3 / _size(records, "seq")))
    _run(fo.monitor_fold_stream(stream, "job_id", f"{root}/out", f"{root}/cp"))
    return spark.read.parquet(f"{root}/out/rows").select("job_id", "ts", "seq", *MONITOR_SCHEMA.names)


@query("breaker_stream", BREAKER)
def breaker_stream(spark, sf):
    root = shared_dir(spark, "breaker")
    calls = breaker_calls(spark, sf)
    stream = _in_time_order(spark, calls, root, F.floor(F.col("event_id") * 3 / _size(calls, "event_id")))
    _run(fo.breaker_stream(stream, "key", ["ts", "event_id"], "ok", f"{root}/out", f"{root}/cp"))
    return spark.read.parquet(f"{root}/out/rows").drop("batch_id")


def _late_counters(spark, sf, root):
    """The counters in batches of five days; every seventh sample arrives a batch late. A last sample, years on, moves the watermark."""
    samples, files = counters(spark, sf), 4
    late = (F.unix_micros("ts") % 7 == 0).cast("int")
    batch = F.floor(F.dayofmonth("ts") / 5).cast("int") + late
    last = samples.limit(1).withColumn("ts", F.lit("2099-01-01").cast("timestamp")).withColumn("name", F.lit("heartbeat"))
    for i in range(8):
        samples.filter(batch == i).repartition(files).write.mode("append").parquet(f"{root}/in")
    last.write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")


@query("counter_rate_stream", K + f", {STEPS} " + WINDOWED.format(agg="round(sum(step) / 3600, 9)"))
def counter_rate_stream(spark, sf):
    """counter_rate over a stream with late samples: steps behind the watermark go to a sink, windows are taken of the sink."""
    stf.use_rocksdb(spark)
    root = shared_dir(spark, "counter-steps")
    steps = stf.counter_steps_stream(_late_counters(spark, sf, root), "11 days")
    with _local_state_partitions(spark):
        _run(sk.append_sink(steps, f"{root}/out", f"{root}/cp"))
    rates = se.increase_of_steps(spark.read.parquet(f"{root}/out"), 3600, 900).withColumn("value", F.col("value") / 3600)
    return _text(rates, _r("value", 9))


@query("stream_union", """SELECT event_type AS subject, epoch_us(ts) AS us, event_id AS seq, value, NULL AS k FROM events
UNION ALL SELECT 'props', epoch_us(ts), event_id, NULL, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) FROM events""")
def stream_union(spark, sf):
    """Two feeds, the second a third of the time behind the first and sent in part twice; repeated records leave by the watermark
    of both."""
    root = shared_dir(spark, "union")
    ts, seq = F.col("ts").cast("timestamp"), F.col("event_id").alias("seq")
    ev = table(spark, sf, "events")
    a = ev.select(F.col("event_type").alias("subject"), ts.alias("ts"), seq, "value")
    b = ev.select(F.lit("props").alias("subject"), ts.alias("ts"), seq, F.get_json_object("props", "$.k").cast("int").alias("k"))
    day = F.floor((F.dayofmonth("ts") - 1) / 10).cast("int")
    b = b.unionByName(b.filter(F.col("seq") % 9 == 0))
    first = _in_time_order(spark, a, f"{root}/a", day)
    second = _in_time_order(spark, b, f"{root}/b", F.floor((F.dayofmonth("ts") - 1) / 5).cast("int"), 6)
    feeds = ch.stream_union(first, second, watermarks=[("ts", "1 day"), ("ts", "2 days")])
    with _local_state_partitions(spark):
        _run(sk.append_sink(feeds.dropDuplicatesWithinWatermark(["subject", "seq"]), f"{root}/out", f"{root}/cp"))
    return spark.read.parquet(f"{root}/out").select("subject", F.unix_micros("ts").alias("us"), "seq", "value", "k")


@query("retain_last_n_stream", """SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
FROM events) WHERE rn <= 1500""")
def retain_last_n_stream(spark, sf):
    """The newest events per type while batches arrive, every other record out of its time."""
    root = shared_dir(spark, "retain")
    ev = table(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    cut = F.when(F.col("event_id") % 2 == 0, F.col("event_id") * 3 / _size(ev, "event_id")).otherwise(F.col("event_id") % 3)
    stream = _in_time_order(spark, ev, root, F.floor(cut))
    _run(fo.retain_stream(stream, ["event_id"], ["ts", "event_id"], f"{root}/out", f"{root}/cp", 1500, ["event_type"], buckets=BUCKETS))
    return sk.read_replica(spark, f"{root}/out").select("event_id", "event_type")


@query("retain_max_age_stream", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 36 HOUR")
def retain_max_age_stream(spark, sf):
    root = shared_dir(spark, "retain-age")
    ev = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    stream = _in_time_order(spark, ev, root, F.floor(F.col("event_id") * 3 / _size(ev, "event_id")))
    _run(fo.retain_stream(stream, ["event_id"], ["ts"], f"{root}/out", f"{root}/cp", max_age="36 hours", buckets=BUCKETS))
    return sk.read_replica(spark, f"{root}/out").select("event_id")


@query("state_change_feed_stream", _fold("true") + "SELECT job_id, ts, seq, state FROM fold WHERE rn > 0 AND pub ORDER BY ts DESC, seq DESC LIMIT 1000")
def state_change_feed_stream(spark, sf):
    """Published transitions of the stateful monitor, of which the newest thousand are retained as they arrive."""
    stf.use_rocksdb(spark)
    root = shared_dir(spark, "state-feed")
    records = cdc_records(spark, sf)
    stream = _in_time_order(spark, records, root, F.floor(F.col("seq") * 3 / _size(records, "seq")))
    feed = stf.sync_monitor_stream(stream, "job_id").filter("published").select("job_id", "ts", "seq", "state")
    with _local_state_partitions(spark):
        _run(fo.retain_stream(feed, ["job_id", "ts", "seq"], ["ts", "seq", "job_id"], f"{root}/out", f"{root}/cp", 1000, buckets=BUCKETS))
    return sk.read_replica(spark, f"{root}/out")
