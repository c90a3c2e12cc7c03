"""Log lines: flattening nested stream answers and filtering them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.functions.sql_text import trace_id

# --- fixed values -------------------------------------------------------------
SLOW_LOG_PATTERN = "慢查询|slow|timeout|耗时.*ms"
RESULT_SCHEMA = "array<struct<stream: map<string,string>, values: array<array<string>>>>"
# ------------------------------------------------------------------------------


def log_flatten(df: DataFrame, result: str = "result") -> DataFrame:
    """result[].values[] -> one row per line, newest first. Nanosecond text becomes a ms timestamp."""
    streams = df.select(F.explode(result).alias("s"))
    lines = streams.select(F.col("s.stream").alias("stream"), F.explode("s.values").alias("v"))

    def label(name: str, default: str):
        return F.coalesce(F.nullif(F.try_element_at("stream", F.lit(name)), F.lit("")), F.lit(default))

    ms = F.floor(F.element_at("v", 1).cast("decimal(20,0)") / 1_000_000).cast("long")
    message = F.element_at("v", 2)
    return lines.select(
        F.timestamp_millis(ms).alias("ts"),
        message.alias("message"),
        label("service", "unknown").alias("service"),
        label("level", "INFO").alias("level"),
        label("container_name", "unknown").alias("container"),
        trace_id(message).alias("trace_id"),
    ).orderBy(F.desc("ts"), "message")


def log_filter(
    logs: DataFrame,
    service: str | None = None,
    level: str | None = None,
    container: str | None = None,
    search: str | None = None,
    trace: str | None = None,
    default_services: str = ".*",
) -> DataFrame:
    """Equality on service, level and container ("all" or nothing: no filter), contains on the text.

    Without a service the pattern ``default_services`` has to cover the whole service name.
    """
    def given(v: str | None) -> bool:
        return bool(v) and v != "all"

    logs = logs.filter(F.col("service") == service if given(service) else F.col("service").rlike(f"^(?:{default_services})$"))
    if given(level):
        logs = logs.filter(F.col("level") == level)
    if given(container):
        logs = logs.filter(F.col("container") == container)
    for text in (search, trace):
        if text:
            logs = logs.filter(F.col("message").contains(text))
    return logs


def slow_log_filter(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("message").rlike(SLOW_LOG_PATTERN))


def error_log_filter(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("level") == "ERROR")
