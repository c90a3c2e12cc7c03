"""Rates, latency, moving averages, alerts and breakers over a statement log or an outcome feed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tideline.operators.machine import Machine
from tideline.operators.ordered import exact_quantiles, ordered_fold, running

# --- fixed values -------------------------------------------------------------
SLOW_RATE_LIMIT = 0.10
HIT_RATE_TARGET = 0.80
HIT_RATE_MIN_DECISIONS = 100
CPU_LIMIT = 85
SLOW_MS = 5000
# ------------------------------------------------------------------------------

OUTCOMES = ["hit", "miss", "skip", "success", "error"]


def _count(outcome: str) -> Column:
    return F.count_if(F.col("outcome") == outcome)


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def outcome_counts(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(*[_count(o).alias(o) for o in OUTCOMES])


def hit_rate(events: DataFrame, by: list[str] = ()) -> DataFrame:
    hits, misses = _count("hit"), _count("miss")
    return events.groupBy(*by).agg(_ratio(hits, hits + misses, 0.0).alias("hit_rate"))


def slow_rate(log: DataFrame, ms: int = SLOW_MS, by: list[str] = ()) -> DataFrame:
    slow = F.count_if(F.col("execution_time") > ms)
    return log.groupBy(*by).agg(_ratio(slow, F.count(F.lit(1)), 0.0).alias("slow_rate"))


def success_rate(log: DataFrame, by: list[str] = ()) -> DataFrame:
    n, errors = F.count(F.lit(1)), F.count_if(F.col("has_error"))
    return log.groupBy(*by).agg(_ratio((n - errors) * 100, n, 100.0).alias("success_rate"))


def mean_time(log: DataFrame, by: list[str] = ()) -> DataFrame:
    return log.groupBy(*by).agg(F.coalesce(F.avg("execution_time"), F.lit(0.0)).alias("mean_time"))


def performance_summary(events: DataFrame, by: list[str] = (), ms: int = SLOW_MS) -> DataFrame:
    """All figures of a scope in one pass. ``events`` has outcome and execution_time.

    Hits, misses and skips are decisions; success and error rows are executions and make up the query
    count and the time figures.
    """
    run = F.col("outcome").isin("success", "error")
    queries = F.count_if(run)
    slow = F.count_if(run & (F.col("execution_time") > ms))
    hits, misses = _count("hit"), _count("miss")
    return events.groupBy(*by).agg(
        queries.alias("total_queries"),
        slow.alias("slow_queries"),
        hits.alias("cache_hits"),
        misses.alias("cache_misses"),
        _count("skip").alias("cache_skips"),
        _count("error").alias("errors"),
        _ratio(hits, hits + misses, 0.0).alias("hit_rate"),
        _ratio(slow, queries, 0.0).alias("slow_rate"),
        _ratio((queries - _count("error")) * 100, queries, 100.0).alias("success_rate"),
        F.coalesce(F.avg(F.when(run, F.col("execution_time"))), F.lit(0.0)).alias("mean_time"),
    )


def threshold_alerts(summary: DataFrame, by: list[str] = (), cpu: str | None = None) -> DataFrame:
    """One row per broken limit: alert, level, current value and threshold."""

    def alert(cond: Column, name: str, level: str, current: Column, limit: float) -> Column:
        return F.when(
            cond,
            F.struct(
                F.lit(name).alias("alert"),
                F.lit(level).alias("level"),
                current.cast("double").alias("current"),
                F.lit(float(limit)).alias("threshold"),
            ),
        )

    decisions = F.col("cache_hits") + F.col("cache_misses")
    alerts = [
        alert(F.col("slow_rate") > SLOW_RATE_LIMIT, "slow_query", "warning", F.col("slow_rate"), SLOW_RATE_LIMIT),
        alert(
            (F.col("hit_rate") < HIT_RATE_TARGET) & (decisions > HIT_RATE_MIN_DECISIONS),
            "cache_hit_rate",
            "warning",
            F.col("hit_rate"),
            HIT_RATE_TARGET,
        ),
    ]
    if cpu:
        alerts.append(alert(F.col(cpu) > CPU_LIMIT, "cpu", "error", F.col(cpu), CPU_LIMIT))
    return summary.select(*by, F.inline(F.array_compact(F.array(*alerts))))


def latency_percentiles(df: DataFrame, by: list[str], value: str, qs=(0.5, 0.95, 0.99)) -> DataFrame:
    return exact_quantiles(df, list(by), value, {f"p{q * 100:g}".replace(".", "_"): q for q in qs})


def speedup(df: DataFrame, by: list[str] = (), kind: str = "kind", value: str = "latency") -> DataFrame:
    """Median latency on the source over median latency on the replica."""
    medians = exact_quantiles(df.filter(F.col(kind).isin("original", "cached")), [*by, kind], value, {"p50": 0.5})
    wide = medians.groupBy(*by).agg(
        F.max(F.when(F.col(kind) == "original", F.col("p50"))).alias("p50_original"),
        F.max(F.when(F.col(kind) == "cached", F.col("p50"))).alias("p50_cached"),
    )
    return wide.withColumn("speedup", F.col("p50_original") / F.nullif(F.col("p50_cached"), F.lit(0.0)))


def ewma_partials(log: DataFrame, key: str, value: str, order: list[str], w: int = 4) -> DataFrame:
    """(key, first, factor, total, executions): what some rows of a key do to its average.

    avg = (avg * w + x) / (w + 1) is linear, so any run of rows turns the average before it into ``before * factor + total``, and
    two runs one after the other into (f1 * f2, t1 * f2 + t2). A row ``r`` places from the end weighs decay^(r-1) / (w + 1).
    Weights only shrink (to 0 on long series), nothing is divided by them. Sums combine map-side, and the places come from sliced
    windows, so one statement may own any share of the log.
    """
    decay, gain = w / (w + 1), 1 / (w + 1)
    rows = log.filter(F.col(key).isNotNull() & (F.col(value) >= 0)).select(key, *order, F.col(value).cast("double").alias("_x"))
    ranked = running(rows, [key], order, {"_r": ("count", F.lit(1))}, descending=True)
    n = F.max("_r")
    return ranked.groupBy(key).agg(
        F.max_by("_x", "_r").alias("first"),
        F.pow(F.lit(decay), n).alias("factor"),
        F.sum(F.col("_x") * F.pow(F.lit(decay), F.col("_r") - 1) * gain).alias("total"),
        n.cast("long").alias("executions"),
    )


def ewma_after(before: Column) -> Column:
    """The average after the rows of :func:`ewma_partials`; without one before, the first value counts as it."""
    return F.coalesce(before, F.col("first")) * F.col("factor") + F.col("total")


def ewma_per_statement(log: DataFrame, key: str, value: str, order: list[str], w: int = 4) -> DataFrame:
    """First value, then avg = (avg * w + x) / (w + 1) along ``order``; count kept."""
    return ewma_partials(log, key, value, order, w).select(key, ewma_after(F.lit(None).cast("double")).alias("ewma"), "executions")


def slow_classification(ewma: DataFrame) -> DataFrame:
    """Slow: twice the plain mean of all statement averages, once that mean is above 1 ms."""
    overall = ewma.agg(F.coalesce(F.avg("ewma"), F.lit(0.0)).alias("overall")).scalar()
    out = ewma.withColumn("overall", overall)
    return out.withColumn("is_slow", (F.col("overall") > 1.0) & (F.col("ewma") >= F.col("overall") * 2.0))


def dirty_transaction(
    log: DataFrame,
    session: str = "session",
    txn: str = "txn",
    order: list[str] = ("ts",),
    write: str = "is_write",
    active: str = "in_transaction",
    read_only: str = "read_only",
) -> DataFrame:
    """Reads that must skip the replica: inside an active read-write transaction after its first write.

    Without a session there is no write mark, so everything in such a transaction skips.
    """
    flagged = running(
        log, [session, txn], list(order), {"_dirty": ("max", F.coalesce(F.col(write), F.lit(False)).cast("int"))}, inclusive=False
    )
    dirty = F.when(F.col(session).isNull(), True).otherwise(F.coalesce(F.col("_dirty"), F.lit(0)) == 1)
    applies = F.coalesce(F.col(active), F.lit(False)) & ~F.coalesce(F.col(read_only), F.lit(False))
    return flagged.withColumn("skip", applies & ~F.coalesce(F.col(write), F.lit(False)) & dirty).drop("_dirty")


def failure_breaker(
    log: DataFrame, key: str, order: list[str], ok: str, threshold: int = 3, open_ms: int = 60_000
) -> DataFrame:
    """Replays a failure breaker over a log; ``order[0]`` is the time in ms.

    ``threshold`` failures without a success in between open it for ``open_ms``: calls up to and at the
    end are refused and do not count. After that one more failure opens it again; a success clears it.
    """
    narrow, machine, out_schema = breaker_fold(log, key, order, ok, threshold, open_ms)
    return ordered_fold(narrow, [key], order, machine, out_schema)


class Breaker(Machine):
    def __init__(self, key: str, order: list[str], threshold: int, open_ms: int) -> None:
        self.columns, self.kept, self.threshold, self.open_ms = [order[0], "_ok"], [key, *order], threshold, open_ms
        self.seen = {"until": (f"`{order[0]}` + {open_ms}", False)}

    def start(self) -> dict:
        return {"n": 0, "until": 0}

    def advance(self, state: dict, record: dict) -> tuple:
        now, good = (record[c] for c in self.columns)
        refused = state["n"] >= self.threshold and state["until"] >= now
        if not refused and good:
            state["n"], state["until"] = 0, 0
        elif not refused:
            state["n"] += 1
            if state["n"] >= self.threshold and state["until"] < now + self.open_ms:
                state["until"] = now + self.open_ms
        return refused, state["n"], state["until"]

    def output(self, rows: pd.DataFrame, shown: list[tuple]) -> pd.DataFrame:
        return pd.concat([rows[self.kept].reset_index(drop=True), pd.DataFrame(shown, columns=["refused", "failures", "open_until"])], axis=1)


def breaker_fold(log: DataFrame, key: str, order: list[str], ok: str, threshold: int = 3, open_ms: int = 60_000):
    """(rows, machine, schema) of the breaker, for the batch and the streaming fold."""
    narrow = log.select(key, *order, F.col(ok).cast("boolean").alias("_ok"))
    out_schema = T.StructType(
        [
            *[narrow.schema[c] for c in (key, *order)],
            T.StructField("refused", T.BooleanType()),
            T.StructField("failures", T.IntegerType()),
            T.StructField("open_until", T.LongType()),
        ]
    )
    return narrow, Breaker(key, list(order), threshold, open_ms), out_schema
