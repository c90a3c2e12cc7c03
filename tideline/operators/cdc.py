"""Change records and the sync-state machine, batch side.

The streaming twins are in ``tideline.streaming``; both use :func:`monitor_step`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tideline.operators.machine import Machine
from tideline.operators.ordered import best_per_key, ordered_fold, running, top_n_per_group

# --- fixed values -------------------------------------------------------------
IDLE_MS = 30_000
FEED_EVERY_MS = 30_000
FEED_KEEP = 1000
SUBJECT_KEEP = 10_000
MAX_AGE = "1 hour"
SNAPSHOT, SYNCING, IDLE, FAILED = "SNAPSHOT_SYNCING", "INCREMENTAL_SYNCING", "INCREMENTAL_IDLE", "FAILED"
START_EVENTS = ["JOB_START", "SOURCE_START"]
CLOSE_EVENTS = ["READER_CLOSE", "ENUMERATOR_CLOSE", "LIFECYCLE_READER_CLOSE"]
ACTIVITY_EVENTS = ["CHECKPOINT_COMPLETED", "BATCH_CHECKPOINT"]
FAIL_EVENTS = ["JOB_FAIL", "TASK_FAIL"]
# ------------------------------------------------------------------------------


def latest_per_key(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last change of every key; changes that are equal in order count once."""
    return best_per_key(changes, keys, order[0], [F.col(c).desc_nulls_last() for c in order])


def cdc_apply(snapshot: DataFrame, changes: DataFrame, keys: list[str], op: str = "op", order: list[str] = ("ts", "seq")) -> DataFrame:
    """Table after the changes: the last change per key wins, deletes (``d``) remove, new keys are added.

    Columns that only the changes have are added to the result.
    """
    last = latest_per_key(changes, keys, list(order))
    kept = last.filter(F.col(op) != "d").drop(op, *order)
    untouched = snapshot.join(last.select(*keys), keys, "left_anti")
    return untouched.unionByName(kept, allowMissingColumns=True)


def schema_change(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of both; columns missing on one side are NULL there."""
    return target.unionByName(batch, allowMissingColumns=True)


def retain_last_n(df: DataFrame, n: int = FEED_KEEP, by: str | None = None, order: list[str] = ("ts",)) -> DataFrame:
    """Newest ``n`` rows, of the whole feed or per subject."""
    newest = [F.col(c).desc() for c in order]
    if by is None:
        return df.orderBy(*newest).limit(n)
    return top_n_per_group(df, [by], newest, n, name="_keep", keep=False)


def retain_max_age(df: DataFrame, now: Column, age: str = MAX_AGE, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts) >= now - F.expr(f"INTERVAL {age}"))


def cdc_state_machine(events: DataFrame, key: str, order: list[str], event: str = "event_type") -> DataFrame:
    """State after every job event.

    Starts and failures set the state whatever it was, so only what happened since the last of them
    counts: running maxima give its place and whether a close or a checkpoint followed. That makes the
    machine a window query, slice by slice for tables of any size.
    """
    kind = (
        F.when(F.col(event).isin(START_EVENTS), "start")
        .when(F.col(event).isin(CLOSE_EVENTS), "close")
        .when(F.col(event).isin(ACTIVITY_EVENTS), "activity")
        .when(F.col(event).isin(FAIL_EVENTS), "fail")
    )
    rows = events.withColumn("_kind", kind)
    at = F.struct(*order)

    def place(*kinds: str) -> tuple[str, Column]:
        return "max", F.when(F.col("_kind").isin(*kinds), at)

    run = running(
        rows, [key], order,
        {
            "_reset": ("max", F.when(F.col("_kind").isin("start", "fail"), F.struct(*order, F.col("_kind").alias("k")))),
            "_close": place("close"),
            "_active": place("activity"),
        },
    )
    reset_at = F.struct(*[F.col(f"_reset.{c}").alias(c) for c in order])
    closed = F.coalesce(F.col("_close") > reset_at, F.lit(False))
    state = (
        F.when(F.col("_reset.k") == "fail", FAILED)
        .when((F.col("_reset.k") == "start") & closed, SYNCING)
        .when(F.col("_reset.k") == "start", SNAPSHOT)
        .when(F.col("_active").isNotNull(), SYNCING)
    )
    return run.select(*events.columns, state.alias("state"))


def new_monitor_state() -> dict:
    return {"state": None, "last_event": 0, "update": 0, "sync_start": 0, "sink_mark": 0, "prev_source": -1, "published": 0}


def monitor_step(s: dict, rec: dict, compat: bool = False, idle_ms: int = IDLE_MS, every_ms: int = FEED_EVERY_MS) -> bool:
    """Apply one record to the state of one table in place; True when the change is published.

    rec: ts (ms), kind event / tick / write, event_type, source_received, sink_written. A tick that finds
    the replica caught up keeps the IDLE state at once; ``compat`` writes it only when the table has been
    quiet for ``idle_ms``.
    """
    now = rec["ts"]

    def put(state: str) -> bool:
        s["state"], s["last_event"], s["update"] = state, now, now
        if state != SYNCING or now - s["published"] > every_ms:
            s["published"] = now
            return True
        return False

    if rec["kind"] == "write":
        s["state"], s["sync_start"], s["update"] = SYNCING, now, now
        return False

    if rec["kind"] == "event":
        event, current = rec["event_type"], s["state"]
        if event in START_EVENTS:
            return put(SNAPSHOT)
        if event in FAIL_EVENTS:
            return put(FAILED)
        if event in CLOSE_EVENTS and current == SNAPSHOT:
            return put(SYNCING)
        if event in ACTIVITY_EVENTS and current in (None, IDLE, SYNCING):
            return put(SYNCING)
        return False

    if rec["source_received"] > s["prev_source"]:
        s["prev_source"] = rec["source_received"]
        return put(SYNCING)
    current, caught_up = s["state"] or SYNCING, False
    quiet = now - s["last_event"] >= idle_ms
    if current == SYNCING and s["sync_start"] > 0:
        if s["sink_mark"] <= 0:
            s["sink_mark"] = rec["sink_written"]
        elif rec["sink_written"] > s["sink_mark"]:
            current, caught_up = IDLE, True
            s["sync_start"], s["sink_mark"] = 0, 0
    elif current == SYNCING and quiet:
        current = IDLE
    if quiet or (caught_up and not compat):
        return put(current)
    return False


MONITOR_SCHEMA = T.StructType(
    [
        T.StructField("state", T.StringType()),
        T.StructField("available", T.BooleanType()),
        T.StructField("last_event_time", T.LongType()),
        T.StructField("update_time", T.LongType()),
        T.StructField("published", T.BooleanType()),
    ]
)


def monitor_row(s: dict, published: bool) -> tuple:
    return s["state"], s["state"] == IDLE, s["last_event"], s["update"], published


class Monitor(Machine):
    """:func:`monitor_step` over rows with ``kept`` columns."""

    columns = ["ts", "kind", "event_type", "source_received", "sink_written"]
    categories = {"state": [None, SNAPSHOT, SYNCING, IDLE, FAILED]}
    seen = {r: ("ts", False) for r in ("last_event", "update", "sync_start", "published")}
    seen["prev_source"] = ("CASE WHEN kind = 'tick' THEN source_received END", True)
    seen["sink_mark"] = ("CASE WHEN kind = 'tick' THEN sink_written END", False)

    def __init__(self, kept: list[str], compat: bool) -> None:
        self.kept, self.compat = kept, compat

    def start(self) -> dict:
        return new_monitor_state()

    def advance(self, state: dict, record: dict) -> tuple:
        return monitor_row(state, monitor_step(state, record, self.compat))

    def output(self, rows: pd.DataFrame, shown: list[tuple]) -> pd.DataFrame:
        return pd.concat([rows[self.kept].reset_index(drop=True), pd.DataFrame(shown, columns=MONITOR_SCHEMA.names)], axis=1)


def monitor_fold(records: DataFrame, key: str, order: list[str] = ("ts", "seq"), compat: bool = False):
    """(rows, machine, schema) of the monitor, for the batch and the streaming fold."""
    wanted = {"kind": "string", "event_type": "string", "source_received": "bigint", "sink_written": "bigint"}
    for c, t in wanted.items():
        if c not in records.columns:
            records = records.withColumn(c, F.lit(None).cast(t))
    counts = {"source_received", "sink_written"}
    narrow = records.select(key, *order, *[F.coalesce(c, F.lit(0)).alias(c) if c in counts else F.col(c) for c in wanted])
    kept = [key, *order, "kind"]
    return narrow, Monitor(kept, compat), T.StructType([*[narrow.schema[c] for c in kept], *MONITOR_SCHEMA.fields])


def sync_monitor(records: DataFrame, key: str, order: list[str] = ("ts", "seq"), compat: bool = False) -> DataFrame:
    """State of each table after each record (events, metric ticks and write marks in one feed)."""
    narrow, machine, out_schema = monitor_fold(records, key, order, compat)
    return ordered_fold(narrow, [key], list(order), machine, out_schema)


def idle_detector(metrics: DataFrame, key: str, order: list[str] = ("ts", "seq"), compat: bool = False) -> DataFrame:
    """Ticks only: SYNCING while the source count grows, IDLE after 30 quiet seconds."""
    return sync_monitor(metrics.withColumn("kind", F.lit("tick")), key, order, compat)


def write_catch_up(
    writes: DataFrame, metrics: DataFrame, key: str, order: list[str] = ("ts", "seq"), compat: bool = False
) -> DataFrame:
    """Ticks and write marks: a written table is IDLE again once its sink count passed the mark."""
    both = metrics.withColumn("kind", F.lit("tick")).unionByName(
        writes.withColumn("kind", F.lit("write")), allowMissingColumns=True
    )
    return sync_monitor(both, key, order, compat)


def state_change_feed(states: DataFrame, key: str, order: list[str] = ("ts", "seq"), keep: int = FEED_KEEP) -> DataFrame:
    """Published transitions of :func:`sync_monitor`, the newest ``keep`` of them."""
    return retain_last_n(states.filter("published"), keep, order=[*order, key])
