"""Counters, gauges and histograms as one long table: ts, name, labels MAP<STRING,STRING>, value.

Results are given on a grid: ``ts`` is the evaluation instant (a multiple of the step) and a window of
length L at instant e covers the samples with e - L <= ts < e.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tideline.operators.ordered import previous, top_n_per_group
from tideline.operators.relational import offset_delta

# --- fixed values -------------------------------------------------------------
SCRAPE_SECONDS = 15
# span of the view in seconds -> step in seconds
STEPS = [(7 * 86400, 3600), (86400, 300), (6 * 3600, 60), (0, 15)]
# ------------------------------------------------------------------------------


def step_for(span_seconds: int) -> int:
    """Grid step for a view of the given length."""
    return next(step for above, step in STEPS if span_seconds > above or above == 0)


def label_key(labels: Column | str) -> Column:
    """Comparable form of a label map: sorted (key, value) pairs."""
    return F.array_sort(F.map_entries(labels))


def _seconds(ts: Column | str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def _instant(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def metric_samples(df: DataFrame, ts: str, labels: list[str], metrics: list[str], every: int = SCRAPE_SECONDS) -> DataFrame:
    """Long sample table from wide readings: per series the last reading of every scrape interval."""
    at = _instant(F.floor(_seconds(ts) / every) * every)
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in labels]), F.array(*[F.col(c).cast("string") for c in labels]))
    last = df.groupBy(at.alias("ts"), *labels).agg(*[F.max_by(F.col(m).cast("double"), ts).alias(m) for m in metrics])
    long = last.select(
        "ts", pairs.alias("labels"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).alias("value")) for m in metrics])).alias("s"),
    )
    return long.select("ts", "s.name", "labels", "s.value").filter(F.col("value").isNotNull())


def label_filter(samples: DataFrame, conds: dict[str, tuple[str, str]]) -> DataFrame:
    """``=``, ``!=``, ``=~`` and ``!~`` on labels; patterns cover the whole value, a missing label is ''."""
    for name, (op, want) in conds.items():
        value = F.coalesce(F.try_element_at("labels", F.lit(name)), F.lit(""))
        test = value == want if op in ("=", "!=") else value.rlike(f"^(?:{want})$")
        samples = samples.filter(~test if op.startswith("!") else test)
    return samples


def _windows(df: DataFrame, keys: list[str], value: str, length: int, step: int, how) -> DataFrame:
    """Sliding windows: samples are first folded into slices of gcd(length, step), then slices are spread."""
    g = math.gcd(length, step)
    sliced = df.groupBy(*keys, (F.floor(_seconds("ts") / g) * g).alias("_b")).agg(how(value).alias("_v"))
    first = F.ceil((F.col("_b") + g) / step) * step
    last = F.floor((F.col("_b") + length) / step) * step
    ends = F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long")))
    return (
        sliced.select(*keys, "_v", F.explode(ends).alias("_e"))
        .groupBy(*keys, "_e")
        .agg(how("_v").alias("value"))
        .select(*keys, _instant(F.col("_e")).alias("ts"), "value")
    )


def _with_series(samples: DataFrame) -> DataFrame:
    return samples.withColumn("_labels", label_key("labels"))


def _restore(df: DataFrame) -> DataFrame:
    return df.select("ts", "name", F.map_from_entries("_labels").alias("labels"), "value")


def counter_steps(samples: DataFrame) -> DataFrame:
    """Increase of every sample over the one before in its series; after a reset the value itself."""
    rows = _with_series(samples).select("name", "_labels", "ts", "value")
    lagged = previous(rows, ["name", "_labels"], ["ts"], ["value"])
    step = F.when(F.col("value") >= F.col("prev_value"), F.col("value") - F.col("prev_value")).when(
        F.col("prev_value").isNotNull(), F.col("value")
    )
    return lagged.withColumn("step", F.coalesce(step, F.lit(0.0)))


def increase_of_steps(steps: DataFrame, window: int, step: int) -> DataFrame:
    """Increase over the trailing ``window`` seconds at every ``step``, from :func:`counter_steps` or its stream."""
    return _restore(_windows(steps, ["name", "_labels"], "step", window, step, F.sum))


def counter_increase(samples: DataFrame, window: int, step: int) -> DataFrame:
    """Increase over the trailing ``window`` seconds at every ``step``."""
    return increase_of_steps(counter_steps(samples), window, step)


def counter_rate(samples: DataFrame, window: int, step: int) -> DataFrame:
    return counter_increase(samples, window, step).withColumn("value", F.col("value") / window)


def max_over_time(samples: DataFrame, window: int, step: int) -> DataFrame:
    return _restore(_windows(_with_series(samples), ["name", "_labels"], "value", window, step, F.max))


def _aggregate(samples: DataFrame, labels: list[str], agg: Column) -> DataFrame:
    kept = [F.coalesce(F.try_element_at("labels", F.lit(c)), F.lit("")).alias(c) for c in labels]
    out = samples.groupBy("ts", *kept).agg(agg.alias("value"))
    names, values = F.array(*[F.lit(c) for c in labels]), F.array(*[F.col(c) for c in labels])
    empty = F.create_map().cast("map<string,string>")
    return out.select("ts", (F.map_from_arrays(names, values) if labels else empty).alias("labels"), "value")


def sum_by(samples: DataFrame, labels: list[str] = ()) -> DataFrame:
    return _aggregate(samples, list(labels), F.sum("value"))


def count_by(samples: DataFrame, labels: list[str] = ()) -> DataFrame:
    return _aggregate(samples, list(labels), F.count("value").cast("double"))


def max_by(samples: DataFrame, labels: list[str] = ()) -> DataFrame:
    return _aggregate(samples, list(labels), F.max("value"))


def label_vector_join(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Pairs of samples with equal instant and equal labels (all, or those in ``on``): left, right."""

    def keyed(df: DataFrame, name: str) -> DataFrame:
        key = label_key("labels") if on is None else F.array(
            *[F.struct(F.lit(c).alias("key"), F.coalesce(F.try_element_at("labels", F.lit(c)), F.lit("")).alias("value")) for c in on]
        )
        return df.select("ts", key.alias("_k"), F.col("value").alias(name))

    joined = keyed(a, "left").join(keyed(b, "right"), ["ts", "_k"])
    return joined.select("ts", F.map_from_entries("_k").alias("labels"), "left", "right")


def vector_ratio(a: DataFrame, b: DataFrame, scale: float = 1, on: list[str] | None = None, part_of_sum: bool = False) -> DataFrame:
    """a / b * scale per instant and labels; ``part_of_sum`` divides by a + b. NULL where the divisor is 0."""
    joined = label_vector_join(a, b, on)
    below = F.col("left") + F.col("right") if part_of_sum else F.col("right")
    return joined.select("ts", "labels", (F.col("left") / F.nullif(below, F.lit(0.0)) * scale).alias("value"))


def offset(samples: DataFrame, seconds: int = 60) -> DataFrame:
    """Change against the same series ``seconds`` earlier."""
    out = offset_delta(_with_series(samples), ["name", "_labels"], "ts", "value", seconds)
    return out.select("ts", "name", F.map_from_entries("_labels").alias("labels"), "value", "delta")


def topk(samples: DataFrame, k: int = 5) -> DataFrame:
    """The k largest samples of every instant; equal values by label order."""
    rows = _with_series(samples)
    out = top_n_per_group(rows, ["ts"], [F.desc("value"), F.asc("name"), F.asc("_labels")], k, name="place")
    return out.drop("_labels")


def histogram_quantile(q: float, buckets: DataFrame, by: list[str]) -> DataFrame:
    """Quantile of cumulative buckets (ts, ``by``, le DOUBLE with +Infinity, value) by interpolation.

    Counts of equal ``le`` are added first, so a group holds one entry per bucket bound. A rank in the
    last bucket gives the bound below it; an empty histogram or one without +Inf gives NULL.
    """
    summed = buckets.groupBy(*by, "ts", "le").agg(F.sum("value").alias("c"))
    grouped = summed.groupBy(*by, "ts").agg(F.array_sort(F.collect_list(F.struct("le", "c"))).alias("b"))
    inf = F.lit(float("inf"))
    n = F.size("b")
    total = F.element_at("b", -1)["c"]
    rank = F.lit(q) * total
    hit = F.array_position(F.transform("b", lambda x: x["c"] >= rank), True).cast("int")
    staged = grouped.withColumn("_i", hit).withColumn("_n", n).withColumn("_total", total).withColumn("_rank", rank)
    here = F.element_at("b", F.col("_i"))
    before = F.when(F.col("_i") > 1, F.try_element_at("b", F.col("_i") - 1))
    low, low_count = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["c"], F.lit(0.0))
    usable = (F.col("_n") >= 2) & (F.element_at("b", -1)["le"] == inf) & (F.col("_total") > 0) & (F.col("_i") > 0)
    value = (
        F.when(~usable, F.lit(None).cast("double"))
        .when(F.col("_i") == F.col("_n"), F.element_at("b", F.col("_n") - 1)["le"])
        .when((F.col("_i") == 1) & (here["le"] <= 0), here["le"])
        .otherwise(low + (here["le"] - low) * (F.col("_rank") - low_count) / F.nullif(here["c"] - low_count, F.lit(0.0)))
    )
    return staged.select(*by, "ts", value.alias("value"))


def tumbling_outcomes(events: DataFrame, width: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Hits and misses per tumbling window; runs unchanged on a stream."""
    return (
        events.groupBy(F.window(ts, width))
        .agg(F.count_if(F.col("outcome") == "hit").alias("hits"), F.count_if(F.col("outcome") == "miss").alias("misses"))
        .select(F.col("window.start").alias("start"), "hits", "misses")
    )
