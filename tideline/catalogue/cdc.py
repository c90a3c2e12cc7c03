"""Change records, retention and the sync-state machine (batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.bindings import RECORDS_SQL, cdc_records, table
from tideline.catalogue.base import query
from tideline.operators import cdc

# ---- changes -----------------------------------------------------------------
# the snapshot holds all orders, and every order has changes by the last digit of its key; 8 and 9 insert a row of a new key as well
def order_snapshot(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


def order_changes(spark, sf):
    """Change records in no particular order: op, ts, seq and the row."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    d, key = F.col("o_orderkey") % 10, F.col("o_orderkey")

    def change(op, ts, seq, status, new=False, more=0):
        fields = {"op": F.lit(op), "ts": F.lit(ts).cast("long"), "seq": F.lit(seq).cast("long"), "o_orderkey": -key if new else key, "o_custkey": F.col("o_custkey") + more, "o_orderstatus": F.lit(status) if status else F.col("o_orderstatus")}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    plan = (
        F.when(d == 0, F.array(change("u", 10, 1, "A")))
        .when(d == 1, F.array(change("u", 10, 2, "U2"), change("u", 10, 1, "U1")))
        .when(d == 2, F.array(change("d", 10, 2, "X"), change("u", 10, 1, "U1")))
        .when(d == 3, F.array(change("d", 10, 1, "X"), change("c", 30, 1, "R")))
        .when(d == 4, F.array(change("d", 30, 1, "X"), change("u", 20, 1, "U1"), change("u", 10, 1, "U0")))
        .when(d == 5, F.array(change("u", 20, 1, None, more=1)))
        .when(d == 6, F.array(change("u", 30, 1, "L"), change("u", 10, 1, "E")))
        .when(d == 7, F.array(change("u", 20, 1, "S1"), change("u", 20, 2, "S2"), change("d", 10, 1, "X")))
        .when(d == 8, F.array(change("u", 20, 1, "U", new=True), change("c", 10, 1, "C", new=True)))
        .otherwise(F.array(change("u", 10, 1, "K"), change("c", 10, 1, "C", new=True), change("d", 30, 1, "X", new=True)))
    )
    return rows.select(F.explode(plan).alias("c")).select("c.*")


APPLIED = """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 5 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE o_orderkey % 10 WHEN 0 THEN 'A'
 WHEN 1 THEN 'U2' WHEN 3 THEN 'R' WHEN 6 THEN 'L' WHEN 7 THEN 'S2' WHEN 9 THEN 'K' ELSE o_orderstatus END AS o_orderstatus
FROM orders WHERE o_orderkey % 10 NOT IN (2, 4) UNION ALL SELECT -o_orderkey, o_custkey, 'U' FROM orders WHERE o_orderkey % 10 = 8"""


@query("cdc_apply", APPLIED)
def cdc_apply(spark, sf):
    return cdc.cdc_apply(order_snapshot(spark, sf), order_changes(spark, sf), ["o_orderkey"])


@query("schema_change", """SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier
UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer""")
def schema_change(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return cdc.schema_change(s, c)


# ---- retention ---------------------------------------------------------------


@query("retain_last_n", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def retain_last_n(spark, sf):
    return cdc.retain_last_n(table(spark, sf, "events").select("event_id", "ts"), order=["ts", "event_id"]).select("event_id")


@query("retain_last_n_subject", """SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
FROM events) WHERE rn <= 1500""")
def retain_last_n_subject(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return cdc.retain_last_n(rows, 1500, "event_type", ["ts", "event_id"]).select("event_id", "event_type")


@query("retain_max_age", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 HOUR")
def retain_max_age(spark, sf):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return cdc.retain_max_age(table(spark, sf, "events"), now).select("event_id")


# ---- state machine -----------------------------------------------------------

FOLD = """WITH RECURSIVE {records}, rec AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS rn FROM records WHERE {where}),
fold AS (
 SELECT job_id, 0::BIGINT AS rn, 0::BIGINT AS ts, 0::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::VARCHAR AS state, 0::BIGINT AS last_event, 0::BIGINT AS upd,
  0::BIGINT AS sync_start, 0::BIGINT AS sink_mark, -1::BIGINT AS prev_source, 0::BIGINT AS last_pub, false AS pub FROM (SELECT DISTINCT job_id FROM rec)
 UNION ALL
 SELECT job_id, rn, ts, seq, kind, CASE WHEN kind = 'write' THEN 'INCREMENTAL_SYNCING' ELSE COALESCE(put, state) END,
  CASE WHEN put IS NOT NULL THEN ts ELSE last_event END, CASE WHEN put IS NOT NULL OR kind = 'write' THEN ts ELSE upd END,
  CASE WHEN kind = 'write' THEN ts WHEN caught THEN 0 ELSE sync_start END,
  CASE WHEN caught THEN 0 WHEN marked AND sink_mark <= 0 THEN sink_written ELSE sink_mark END,
  CASE WHEN grew THEN source_received ELSE prev_source END,
  CASE WHEN put IS NOT NULL AND (put <> 'INCREMENTAL_SYNCING' OR ts - last_pub > 30000) THEN ts ELSE last_pub END,
  put IS NOT NULL AND (put <> 'INCREMENTAL_SYNCING' OR ts - last_pub > 30000)
 FROM (SELECT *, CASE WHEN kind = 'event' THEN CASE WHEN event_type IN ('JOB_START', 'SOURCE_START') THEN 'SNAPSHOT_SYNCING'
   WHEN event_type IN ('JOB_FAIL', 'TASK_FAIL') THEN 'FAILED'
   WHEN event_type IN ('READER_CLOSE', 'ENUMERATOR_CLOSE', 'LIFECYCLE_READER_CLOSE') AND state = 'SNAPSHOT_SYNCING' THEN 'INCREMENTAL_SYNCING'
   WHEN event_type IN ('CHECKPOINT_COMPLETED', 'BATCH_CHECKPOINT') AND COALESCE(state, 'INCREMENTAL_IDLE') IN ('INCREMENTAL_IDLE', 'INCREMENTAL_SYNCING') THEN 'INCREMENTAL_SYNCING' END
  WHEN kind = 'tick' THEN CASE WHEN grew THEN 'INCREMENTAL_SYNCING' WHEN quiet OR {at_once} THEN
   CASE WHEN caught OR (NOT marked AND cur = 'INCREMENTAL_SYNCING' AND quiet) THEN 'INCREMENTAL_IDLE' ELSE cur END END END AS put
  FROM (SELECT *, marked AND sink_mark > 0 AND sink_written > sink_mark AS caught FROM
  (SELECT *, kind = 'tick' AND NOT grew AND cur = 'INCREMENTAL_SYNCING' AND sync_start > 0 AS marked FROM
  (SELECT r.job_id, r.rn, r.ts, r.seq, r.kind, r.event_type, r.source_received, r.sink_written, f.state, f.last_event, f.upd, f.sync_start, f.sink_mark,
   f.prev_source, f.last_pub, r.kind = 'tick' AND r.source_received > f.prev_source AS grew, COALESCE(f.state, 'INCREMENTAL_SYNCING') AS cur,
   r.ts - f.last_event >= 30000 AS quiet FROM fold f JOIN rec r ON r.job_id = f.job_id AND r.rn = f.rn + 1)))))
"""


def _fold(where: str, compat: bool = False) -> str:
    return FOLD.format(records=RECORDS_SQL, where=where, at_once="false" if compat else "caught")


SHOWN = "SELECT job_id, ts, seq, state, state = 'INCREMENTAL_IDLE' AS available, last_event AS last_event_time, upd AS update_time, pub AS published FROM fold WHERE rn > 0"
SHOWN = SHOWN.replace("state = 'INCREMENTAL_IDLE' AS", "COALESCE(state = 'INCREMENTAL_IDLE', false) AS")


def _kind(spark, sf, *kinds):
    return cdc_records(spark, sf).filter(F.col("kind").isin(*kinds))


@query("cdc_state_machine", _fold("kind = 'event'") + "SELECT job_id, ts, seq, state FROM fold WHERE rn > 0")
def cdc_state_machine(spark, sf):
    return cdc.cdc_state_machine(_kind(spark, sf, "event"), "job_id", ["ts", "seq"]).select("job_id", "ts", "seq", "state")


@query("idle_detector", _fold("kind = 'tick'") + SHOWN)
def idle_detector(spark, sf):
    return cdc.idle_detector(_kind(spark, sf, "tick"), "job_id").drop("kind")


@query("write_catch_up", _fold("kind IN ('tick', 'write')") + SHOWN)
def write_catch_up(spark, sf):
    writes = _kind(spark, sf, "write").select("job_id", "ts", "seq")
    return cdc.write_catch_up(writes, _kind(spark, sf, "tick").drop("event_type"), "job_id").drop("kind")


@query("write_catch_up_compat", _fold("kind IN ('tick', 'write')", True) + SHOWN)
def write_catch_up_compat(spark, sf):
    writes = _kind(spark, sf, "write").select("job_id", "ts", "seq")
    return cdc.write_catch_up(writes, _kind(spark, sf, "tick").drop("event_type"), "job_id", compat=True).drop("kind")


@query("sync_monitor", _fold("true") + SHOWN)
def sync_monitor(spark, sf):
    return cdc.sync_monitor(cdc_records(spark, sf), "job_id").drop("kind")


@query("state_change_feed", _fold("true") + "SELECT job_id, ts, seq, state FROM fold WHERE rn > 0 AND pub ORDER BY ts DESC, seq DESC LIMIT 1000")
def state_change_feed(spark, sf):
    states = cdc.sync_monitor(cdc_records(spark, sf), "job_id")
    return cdc.state_change_feed(states, "job_id").select("job_id", "ts", "seq", "state")
