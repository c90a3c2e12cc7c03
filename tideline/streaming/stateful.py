"""Streaming twins of the ordered operators.

State per key is one small record. Rows of a micro-batch are sorted before they are applied; across
batches the order of arrival counts. Needs the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.operators.cdc import MONITOR_SCHEMA, monitor_row, monitor_step, new_monitor_state
from tideline.operators.series import label_key

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = T.StructType([T.StructField("s", T.StringType())])
#: a sample that waits; samples of a piece; slices of the allowed lateness
_SAMPLE = np.dtype([("at", "<i8"), ("value", "<f8")])
_PIECE, _SLICES = 65_536, 32


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def stream_dedup(stream: DataFrame, id_col: str, within: str = "120 seconds") -> DataFrame:
    """Drop message ids that were seen before within the window; older ids leave the state.

    The window is over the time of arrival, so a message that is sent late but for the first time stays.
    """
    arrived = stream.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", within)
    return arrived.dropDuplicatesWithinWatermark([id_col]).drop("__arrived")


class _Ordered(StatefulProcessor):
    """Sorts the rows of a batch and keeps one JSON record per key."""

    def __init__(self, key: str, order: list[str]) -> None:
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("record", STATE)

    def fresh(self) -> dict:
        raise NotImplementedError

    def apply(self, state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.fresh()
        out = self.apply(state, batch)
        self.state.update((json.dumps(state),))
        yield out

    def close(self) -> None:
        pass


class MonitorProcessor(_Ordered):
    def __init__(self, key: str, order: list[str], compat: bool) -> None:
        super().__init__(key, order)
        self.compat = compat

    def fresh(self) -> dict:
        return new_monitor_state()

    def apply(self, state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        cols = ["ts", "kind", "event_type", "source_received", "sink_written"]
        out = []
        for ts, kind, event, source, sink in zip(*[rows[c].tolist() for c in cols]):
            rec = {
                "ts": ts, "kind": kind, "event_type": event,
                "source_received": 0 if pd.isna(source) else int(source),
                "sink_written": 0 if pd.isna(sink) else int(sink),
            }
            out.append(monitor_row(state, monitor_step(state, rec, self.compat)))
        shown = pd.DataFrame(out, columns=MONITOR_SCHEMA.names)
        return pd.concat([rows[[self.key, *self.order, "kind"]].reset_index(drop=True), shown], axis=1)


def sync_monitor_stream(records: DataFrame, key: str, order: list[str] = ("ts", "seq"), compat: bool = False) -> DataFrame:
    """State of each table after each record; ``published`` marks the state-change feed."""
    order = list(order)
    narrow = records.select(key, *order, "kind", "event_type", "source_received", "sink_written")
    schema = T.StructType([*[narrow.schema[c] for c in (key, *order, "kind")], *MONITOR_SCHEMA.fields])
    return narrow.groupBy(key).transformWithStateInPandas(
        statefulProcessor=MonitorProcessor(key, order, compat), outputStructType=schema, outputMode="Append", timeMode="None"
    )


class CounterProcessor(StatefulProcessor):
    """Holds the samples of a series until the watermark has passed them, then counts their steps in order of time.

    State: the samples that wait, in pieces of a slice of time (``width`` microseconds) as they came; the number of the next piece;
    the value of the last one counted; the time the next timer is set for. Calls of the store grow with slices and micro-batches,
    not with samples, and a task holds a slice of one series at a time.
    """

    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        one = lambda **kinds: T.StructType([T.StructField(n, k) for n, k in kinds.items()])
        self.waiting = handle.getMapState("waiting", one(slice=T.LongType(), piece=T.LongType()), one(samples=T.BinaryType()))
        self.pieces = handle.getValueState("pieces", one(n=T.LongType()))
        self.last = handle.getValueState("last", one(value=T.DoubleType()))
        self.timer = handle.getValueState("timer", one(ms=T.LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, n, first = [], 0, None
        for part in rows:
            if part.empty:  # a key whose timer is due comes without rows, and without columns
                continue
            part = part[part["micros"].notna()]
            samples = np.empty(len(part), _SAMPLE)
            samples["at"], samples["value"] = part["micros"], part["value"]
            if not len(samples):
                continue
            held.append(samples)
            n, low = n + len(samples), int(samples["at"].min())
            first = low if first is None else min(first, low)
            if n >= _PIECE:
                self._hold(np.concatenate(held))
                held, n = [], 0
        if held:
            self._hold(np.concatenate(held))
        if first is not None:
            self._wake(first)
        yield from ()

    def _hold(self, samples: np.ndarray) -> None:
        """A piece for every slice of time the samples are in, in the order they came."""
        samples = samples[np.argsort(samples["at"] // self.width, kind="stable")]
        n = self.pieces.get()[0] if self.pieces.exists() else 0
        of = samples["at"] // self.width
        for piece in np.split(samples, np.flatnonzero(np.diff(of)) + 1):
            self.waiting.updateValue((int(piece["at"][0] // self.width), n), (piece.tobytes(),))
            n += 1
        self.pieces.update((n,))

    def _wake(self, at: int) -> None:
        """A timer for the time of a sample, unless an earlier one is set."""
        ms = -(-at // 1000)
        if self.timer.exists():
            if self.timer.get()[0] <= ms:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for of, places in groupby(sorted((k[0], k[1]) for k in self.waiting.keys()), key=lambda k: k[0]):
            if of * self.width > passed:
                self._wake(of * self.width)
                break
            places = list(places)
            samples = np.concatenate([np.frombuffer(self.waiting.getValue(k)[0], _SAMPLE) for k in places])
            samples = samples[np.argsort(samples["at"], kind="stable")]
            samples = samples[np.append(samples["at"][1:] != samples["at"][:-1], True)]  # the last to come of one time
            due = int(np.searchsorted(samples["at"], passed, side="right"))
            waits, samples = samples[due:], samples[:due]
            if len(samples):
                value = samples["value"]
                before = np.concatenate([[self.last.get()[0] if self.last.exists() else np.inf], value[:-1]])
                step = np.where(value >= before, value - before, value)
                if not self.last.exists():
                    step[0] = 0.0
                self.last.update((float(value[-1]),))
                for k in places:
                    self.waiting.removeKey(k)
                if len(waits):
                    self._hold(waits)
                yield pd.DataFrame({"series": key[0], "micros": samples["at"], "value": value, "step": step})
            if len(waits):
                self._wake(int(waits["at"][0]))
                break

    def close(self) -> None:
        pass


def counter_steps_stream(samples: DataFrame, late: str = "10 minutes") -> DataFrame:
    """:func:`tideline.operators.series.counter_steps` of a stream of samples (ts, name, labels, value).

    A step is counted once no earlier sample of its series may come any more, so samples out of order and resets between them are
    right; samples later than ``late`` (and of 1970 or before) are dropped. One of two samples of a series and time counts. Steps leave in the order of
    time per series, a batch behind the watermark.
    """
    micros = samples.sparkSession.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL '{late}'"))).first()[0]
    rows = samples.withWatermark("ts", late).select(
        F.to_json(F.struct("name", label_key("labels").alias("labels"))).alias("series"), "ts", F.unix_micros("ts").alias("micros"),
        F.col("value").cast("double").alias("value"),
    )
    steps = rows.groupBy("series").transformWithStateInPandas(
        statefulProcessor=CounterProcessor(max(1, micros // _SLICES)), outputStructType="series string, micros long, value double, step double",
        outputMode="Append", timeMode="EventTime",
    )
    named = F.from_json("series", "name string, labels array<struct<key: string, value: string>>")
    return steps.select(named["name"].alias("name"), named["labels"].alias("_labels"), F.timestamp_micros("micros").alias("ts"), "value", "step")
