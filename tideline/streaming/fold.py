"""Ordered folds over a stream whose keys may be of any size.

Each micro-batch is folded with the batch operator, so a key that fills most of a batch is cut into slices
and spread over the cluster. The state per key lives in a keyed replica next to the output. Both are
written per batch id: a batch that runs again starts from the states before it and overwrites its rows.
``tideline.streaming.stateful`` keeps state in Spark's own store instead, with less delay but one task per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tideline.operators.cdc import monitor_fold
from tideline.operators.health import breaker_fold, ewma_after, ewma_partials
from tideline.operators.machine import Machine
from tideline.operators.ordered import fold, top_n_per_group
from tideline.session import stored
from tideline.sources.replica import BUCKETS
from tideline.sources.sinks import apply_changes, checkpointed_run, read_replica


def _before(spark: SparkSession, target: str, batch_id: int) -> DataFrame | None:
    """A replica's rows before a batch; None when there was nothing."""
    try:
        return read_replica(spark, target, before=batch_id)
    except ValueError:
        return None


def _change(rows: DataFrame, op: str, batch_id: int) -> DataFrame:
    return rows.withColumns({"_op": F.lit(op), "_ts": F.lit(batch_id).cast("long"), "_seq": F.lit(0).cast("long")})


def fold_stream(
    stream: DataFrame, keys: list[str], order: list[str], machine: Machine, out_schema: T.StructType, target: str, checkpoint: str,
    available_now: bool = True,
):
    """Rows of the fold go to ``target/rows/batch_id=N``, states to ``target/state``."""
    states = f"{target}/state"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        initial = _before(spark, states, batch_id)
        rows, ends = fold(batch, keys, order, machine, out_schema, initial)
        rows.write.mode("overwrite").parquet(f"{target}/rows/batch_id={batch_id}")
        apply_changes(_change(ends, "u", batch_id), batch_id, states, keys)

    return checkpointed_run(stream, write, checkpoint, available_now)


def breaker_stream(stream: DataFrame, key: str, order: list[str], ok: str, target: str, checkpoint: str, threshold: int = 3, open_ms: int = 60_000):
    rows, machine, schema = breaker_fold(stream, key, order, ok, threshold, open_ms)
    return fold_stream(rows, [key], order, machine, schema, target, checkpoint)


def monitor_fold_stream(records: DataFrame, key: str, target: str, checkpoint: str, order: list[str] = ("ts", "seq"), compat: bool = False):
    rows, machine, schema = monitor_fold(records, key, order, compat)
    return fold_stream(rows, [key], list(order), machine, schema, target, checkpoint)


def ewma_stream(
    stream: DataFrame, key: str, value: str, order: list[str], target: str, checkpoint: str, w: int = 4, available_now: bool = True,
    buckets: int = BUCKETS,
):
    """Averages (key, ewma, executions) in the replica at ``target``: a micro-batch is one partial state per key, whatever a key's
    share of it, and is put after the state before it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parts = ewma_partials(batch, key, value, order, w)
        before = _before(batch.sparkSession, target, batch_id)
        if before is None:
            before = batch.sparkSession.createDataFrame([], T.StructType([parts.schema[key], T.StructField("ewma", T.DoubleType()), T.StructField("executions", T.LongType())]))
        old = before.select(F.col(key).alias("_key"), F.col("ewma").alias("_ewma"), F.col("executions").alias("_n"))
        met = parts.join(old, parts[key] == old["_key"], "left")
        after = met.select(key, ewma_after(F.col("_ewma")).alias("ewma"), (F.col("executions") + F.coalesce("_n", F.lit(0))).alias("executions"))
        apply_changes(_change(after, "u", batch_id), batch_id, target, [key], buckets=buckets)

    return checkpointed_run(stream, write, checkpoint, available_now)


def retain_stream(
    stream: DataFrame, ids: list[str], order: list[str], target: str, checkpoint: str, n: int | None = None, by: list[str] = (),
    max_age: str | None = None, available_now: bool = True, buckets: int = BUCKETS,
):
    """Keeps the newest ``n`` events of each ``by`` (of the whole feed without it), and none older than ``max_age`` before the newest
    event so far (``order[0]``, a timestamp), in the replica at ``target``.

    Events leave the replica as newer ones arrive: a micro-batch reads the retained events of the subjects it has, ranks them with
    its own and writes what came and what went. ``ids`` tell events apart; one that comes again counts once.
    """
    newest = [F.col(c).desc() for c in order]

    def same(a: DataFrame, b: DataFrame, columns: list[str]):
        return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[f"_{c}"]) for c in columns))

    def named(d: DataFrame, columns: list[str]) -> DataFrame:
        return d.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct()

    def write(batch: DataFrame, batch_id: int) -> None:
        came = stored(batch.dropDuplicates(ids).withColumn("_new", F.lit(True)), "came")
        held = _before(batch.sparkSession, target, batch_id)
        limit = None
        if held is not None:
            old = held.withColumn("_new", F.lit(False))
            if max_age:
                limit = came.select(order[0]).unionByName(held.select(order[0])).agg(F.max(order[0])).first()[0]
            if by:
                touched = named(came, list(by))
                here = old.join(touched, same(old, touched, list(by)), "left_semi")
                if limit is not None:
                    here = here.unionByName(old.filter(F.col(order[0]) < F.lit(limit) - F.expr(f"INTERVAL {max_age}"))).dropDuplicates(ids)
                old = here
            old = stored(old, "held")
            known = named(old, ids)
            both = old.unionByName(came.join(known, same(came, known, ids), "left_anti"))
        else:
            both = came
            if max_age:
                limit = came.agg(F.max(order[0])).first()[0]
        kept = both if limit is None else both.filter(F.col(order[0]) >= F.lit(limit) - F.expr(f"INTERVAL {max_age}"))
        if n is not None:
            kept = top_n_per_group(kept, list(by), newest, n, keep=False) if by else kept.orderBy(*newest).limit(n)
        kept = stored(kept, "kept")
        changes = _change(kept.filter("_new").drop("_new"), "u", batch_id)
        if held is not None:
            stay = named(kept, ids)
            gone = old.join(stay, same(old, stay, ids), "left_anti").drop("_new")
            changes = changes.unionByName(_change(gone, "d", batch_id))
        apply_changes(changes, batch_id, target, ids, buckets=buckets)

    return checkpointed_run(stream, write, checkpoint, available_now)
