"""Replica targets: keyed (upsert) and append-only, and the runs that feed them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.sources.replica import BUCKETS, COMPACT_AFTER, ID, OP, SEQ, TS, Replica

# --- fixed values -------------------------------------------------------------
COMMIT_EVERY = "3 seconds"
# ------------------------------------------------------------------------------


def write_base(df: DataFrame, target: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new replica that holds a snapshot, one row per key."""
    Replica.create(df.sparkSession, target, keys, df.schema, buckets).load(df)


def apply_changes(
    batch: DataFrame, batch_id: int, target: str, keys: list[str], order: list[str] = (TS, SEQ), op: str = OP,
    buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER,
) -> None:
    """The changes of one micro-batch: ``op`` (``d`` deletes) and two whole numbers to order by, beside the row's columns.

    A replica that is not there yet begins with this batch. A batch that comes again replaces what it wrote.
    """
    spark = batch.sparkSession
    changes = batch.withColumnsRenamed({c: r for c, r in zip((op, *order), (OP, TS, SEQ)) if c != r})
    try:
        newest = Replica.open(spark, target)
        if newest.manifest.batch > batch_id:
            return  # long since applied
        replica = Replica.open(spark, target, before=batch_id) if newest.manifest.batch == batch_id else newest
    except ValueError:
        rows = changes.drop(OP, TS, SEQ, ID).schema
        replica = Replica.create(spark, target, keys, rows, buckets)
    replica.apply(changes, batch_id, compact_after)


def read_replica(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """Current rows of a keyed replica; columns added by later batches are included.

    ``before`` leaves out that batch and later ones (what a replayed batch has to start from).
    """
    return Replica.open(spark, target, before).read()


def compact_replica(spark: SparkSession, target: str) -> int:
    """Compacts all buckets that have changes; returns the last batch folded in, -1 when there was none."""
    replica = Replica.open(spark, target)
    return replica.compact().manifest.batch if replica.manifest.pending else -1


def upsert_sink(
    stream: DataFrame, target: str, keys: list[str], checkpoint: str, order: list[str] = (TS, SEQ), op: str = OP,
    available_now: bool = True, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER,
):
    """Stream of changes into a keyed replica."""

    def write(batch: DataFrame, batch_id: int) -> None:
        apply_changes(batch, batch_id, target, keys, order, op, buckets, compact_after)

    return checkpointed_run(stream, write, checkpoint, available_now)


def append_sink(stream: DataFrame, target: str, checkpoint: str, available_now: bool = True):
    """Stream into an append-only replica; the file sink's own log makes it exactly-once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now).start(target)


def _trigger(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=COMMIT_EVERY)


def checkpointed_run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Micro-batches every 3 seconds (or all that is there), restarted from ``checkpoint`` after a failure.

    ``sink(batch, batch_id)`` may see a batch id again after a restart and must overwrite, not add.
    """
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now).start()
