"""Change and event feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

# bounds a micro-batch; a restart with a backlog then works it off in pieces
FILES_PER_TRIGGER = 1000
ROWS_PER_TRIGGER = 50_000_000


def change_stream(spark: SparkSession, path: str, row_schema: str, per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Stream of JSON change files: _op, _ts, _seq, _id of the message and the columns of the row, whatever their names.

    Deletes carry the row in ``before``; every other record in ``after``.
    """
    reader = spark.readStream.format("json").schema(_envelope(row_schema)).option("maxFilesPerTrigger", per_trigger)
    return flatten_changes(reader.load(path))


def kafka_changes(spark: SparkSession, servers: str, topic: str, row_schema: str) -> DataFrame:
    """The same from a Kafka topic, read from its beginning. Needs the Kafka source on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", ROWS_PER_TRIGGER)
        .load()
    )
    return flatten_changes(raw.select(F.from_json(F.col("value").cast("string"), _envelope(row_schema)).alias("m")).select("m.*"))


def _envelope(row_schema: str) -> str:
    return f"op string, ts bigint, seq bigint, id string, before struct<{row_schema}>, after struct<{row_schema}>"


def flatten_changes(records: DataFrame) -> DataFrame:
    """The envelope under names that begin with an underscore, then the row: a table may have columns op, ts, seq or id itself."""
    row = F.when(F.col("op") == "d", F.coalesce("before", "after")).otherwise(F.col("after"))
    envelope = [F.col(c).alias(f"_{c}") for c in ("op", "ts", "seq", "id")]
    taken = {"_op", "_ts", "_seq", "_id"} & set(records.schema["after"].dataType.names)
    if taken:
        raise ValueError(f"reserved column names: {sorted(taken)}")
    return records.select(*envelope, row.alias("_row")).select("_op", "_ts", "_seq", "_id", "_row.*")


def event_log_read(spark: SparkSession, path: str, schema: str, per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """State events from the beginning of the log; the checkpoint of the query keeps the position."""
    reader = spark.readStream.format("json").schema(schema).option("latestFirst", "false")
    return reader.option("maxFilesPerTrigger", per_trigger).load(path)


def stream_union(*streams: DataFrame, watermarks: list[tuple[str, str] | None] | None = None) -> DataFrame:
    """Fan-in of several feeds; fields a feed lacks are NULL.

    ``watermarks``: per feed the time column (of one name in all feeds) and how late its own records may be. Feeds may run apart:
    the session's ``spark.sql.streaming.multipleWatermarkPolicy`` joins their watermarks, and its default, the smallest, waits for
    the feed that lags. The checkpoint of the query keeps a position per feed.
    """
    if watermarks:
        streams = [s.withWatermark(*w) if w else s for s, w in zip(streams, watermarks, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
