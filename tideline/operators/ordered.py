"""Ordered work inside groups of any size.

A window over a group that holds a third of all rows would run in one task. Here rows are dealt by range of (key, order), so a
group of any size is a run of neighbouring slices of about equal size and small groups share one. Each slice is worked on by
itself; what it needs from the slices before it is a small carried value. Only a group that crosses the border of two slices has
one, and a border is crossed by one group at most, so there are fewer carried rows than slices, whatever the data.

The slices are written once, with their numbers: a task that runs again, and every later step, sees the same ones.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tideline.operators.machine import Machine, TransitionTable, apply_table
from tideline.session import stored

#: rows of a slice
ROWS_KEY, ROWS_DEFAULT = "tideline.slice.rows", 1_000_000
#: carried rows that are sent to all executors: one per slice at most, of the keys and a value each
BROADCAST_SLICES = 100_000
SLICE = "_slice"


@dataclass
class Sliced:
    """Rows with ``_slice``, ascending along (keys, order), and how many slices there are."""

    df: DataFrame
    slices: int

    def small(self, per_slice: DataFrame) -> DataFrame:
        """A table of at most one row per slice, broadcast as long as that is a bounded size."""
        return F.broadcast(per_slice) if self.slices <= BROADCAST_SLICES else per_slice


def _same(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def sliced(df: DataFrame, keys: list[str], order: list, foldered: bool = False) -> Sliced:
    """The rows in slices of at most about ``tideline.slice.rows``; ``foldered``: in a folder each, so that some can be read alone.

    The session's shuffle partitions are tried first, which adaptive execution may join; only where they come out too large are
    the written rows dealt again, into as many slices as the target asks for. Rows equal in keys and order stay together.
    """
    rows = int(df.sparkSession.conf.get(ROWS_KEY, str(ROWS_DEFAULT)))
    by = [*keys, *order]

    def write(d: DataFrame, *n: int) -> tuple[DataFrame, int, int, int]:
        out = stored(d.repartitionByRange(*n, *by).withColumn(SLICE, F.spark_partition_id()), "slices", SLICE if foldered else None)
        sizes = out.groupBy(SLICE).agg(F.count(F.lit(1)).alias("n"))
        return out, *sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()

    out, most, total, slices = write(df)
    if most > 2 * rows:
        out, most, total, slices = write(out.drop(SLICE), math.ceil(total / rows))
    return Sliced(out, slices)


def _spans(s: Sliced, keys: list[str]) -> DataFrame:
    """Keys that lie in more than one slice, with the first and last of them: fewer rows than slices."""
    found = s.df.groupBy(*keys).agg(F.min(SLICE).alias("_lo"), F.max(SLICE).alias("_hi")).filter("_lo < _hi")
    return found.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_lo", "_hi")


def _of_keys(d: DataFrame, spans: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & d[k].eqNullSafe(spans[f"_k_{k}"])
    return cond


def _carried(s: Sliced, keys: list[str], values: dict[str, tuple], descending: bool = False) -> DataFrame:
    """(_k_ keys, _k_slice, _c_ values): per slice of a crossing key, the values over all slices before it. ``values``: name ->
    (aggregate, column)."""
    spans = s.small(_spans(s, keys))
    inside = s.df.join(spans, _of_keys(s.df, spans, keys))
    sums = inside.groupBy(*keys, SLICE).agg(*[how(c).alias(f"_v_{n}") for n, (how, c) in values.items()])
    w = W.partitionBy(*keys).orderBy(F.col(SLICE).desc() if descending else F.col(SLICE).asc()).rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(SLICE).alias("_k_slice"),
        *[how(f"_v_{n}").over(w).alias(f"_c_{n}") for n, (how, _) in values.items()],
        F.count(F.lit(1)).over(w).alias("_before"),
    )
    return s.small(carried.filter("_before > 0").drop("_before"))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    specs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    descending: bool = False,
    slices: Sliced | None = None,
) -> DataFrame:
    """Running sum / count / max / min per key along ``order``, slice by slice.

    ``inclusive=False`` leaves the row itself out. ``order`` must be unique inside a key, or ties must
    not matter to the caller. ``slices`` are those of ``df`` where the caller has them already.
    """
    s = slices or sliced(df, keys, order)
    how = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    d = s.df
    for name, (kind, expr) in specs.items():
        value = F.when(expr.isNotNull(), F.lit(1)).otherwise(F.lit(0)) if kind == "count" else expr
        d = d.withColumn(f"_v_{name}", value)
    direction = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    w = W.partitionBy(*keys, SLICE).orderBy(*direction).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = d.select("*", *[how[k](f"_v_{n}").over(w).alias(f"_l_{n}") for n, (k, _) in specs.items()])

    def final(n: str, k: str, carry: Column | None) -> Column:
        mine = F.col(f"_l_{n}")
        if carry is not None:
            if k in ("sum", "count"):
                mine = F.when(mine.isNull(), carry).when(carry.isNull(), mine).otherwise(mine + carry)
            else:
                mine = F.greatest(mine, carry) if k == "max" else F.least(mine, carry)
        return F.coalesce(mine, F.lit(0)) if k == "count" else mine

    if s.slices <= 1:  # no border
        return local.select(*df.columns, *[final(n, k, None).alias(n) for n, (k, _) in specs.items()])
    carry = _carried(Sliced(d, s.slices), keys, {n: (how[k], F.col(f"_v_{n}")) for n, (k, _) in specs.items()}, descending)
    out = local.join(carry, (local[SLICE] == carry["_k_slice"]) & _of_keys(local, carry, keys), "left")
    return out.select(
        *[local[c] for c in df.columns],
        *[final(n, k, F.col(f"_c_{n}")).alias(n) for n, (k, _) in specs.items()],
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn", descending: bool = False) -> DataFrame:
    """1-based position inside each key; with no keys, over the whole table without a single-task window."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, descending=descending)


def previous(df: DataFrame, keys: list[str], order: list[str], cols: list[str], prefix: str = "prev_") -> DataFrame:
    """Values of the row before: inside a slice the row above, for its first row the last row of the slice before."""
    s = sliced(df, keys, order)
    w = W.partitionBy(*keys, SLICE).orderBy(*order)
    if s.slices <= 1:
        return s.df.select(*df.columns, *[F.lag(c).over(w).alias(f"{prefix}{c}") for c in cols])
    local = s.df.select("*", *[F.lag(c).over(w).alias(f"_l_{c}") for c in cols], F.row_number().over(w).alias("_place"))
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"_p_{c}") for c in cols])
    carry = _carried(s, keys, {"last": (F.max, packed)})
    out = local.join(carry, (local[SLICE] == carry["_k_slice"]) & _of_keys(local, carry, keys), "left")
    found = [F.when(F.col("_place") > 1, F.col(f"_l_{c}")).otherwise(F.col(f"_c_last._p_{c}")).alias(f"{prefix}{c}") for c in cols]
    return out.select(*[local[c] for c in df.columns], *found)


def best_per_key(df: DataFrame, keys: list[str], by: str, order: list[Column]) -> DataFrame:
    """One row per key: of those with the largest ``by``, the first along ``order``.

    The largest value is a hash aggregate, combined map-side, whatever a key's share of the rows; only rows that reach it are
    joined back and ordered, about one per key. NULL is the smallest value and a key like any other.
    """
    best = df.groupBy(*keys).agg(F.max(by).alias("_best"))
    best = best.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_best")
    met = df.join(best, _of_keys(df, best, keys) & df[by].eqNullSafe(best["_best"])).select(*[df[c] for c in df.columns])
    w = W.partitionBy(*keys).orderBy(*order)
    return met.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def top_n_per_group(
    df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rn", keep: bool = True
) -> DataFrame:
    """First ``n`` rows of each group.

    Up to 1000 Spark itself limits the groups before the shuffle. Above that the rows are dealt in slices along (group, order): a
    row's place is its place in the slice plus the group's rows in the slices before, so a group is cut at its n-th row wherever
    that lies. Only group and order columns are compared, the others may be of any type.
    """
    if n <= 1000:
        out = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)
        return out if keep else out.drop(name)
    s = sliced(df, by, order)
    local = s.df.withColumn("_place", F.row_number().over(W.partitionBy(*by, SLICE).orderBy(*order))).filter(F.col("_place") <= n)
    if s.slices > 1:
        carry = _carried(s, by, {"n": (F.sum, F.lit(1))})
        met = local.join(carry, (local[SLICE] == carry["_k_slice"]) & _of_keys(local, carry, by), "left")
        local = met.withColumn("_place", F.col("_place") + F.coalesce("_c_n", F.lit(0))).select(*local.columns)
    out = local.filter(F.col("_place") <= n).withColumn(name, F.col("_place").cast("int")).drop(SLICE, "_place")
    return out if keep else out.drop(name)


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles per group, exact, without holding a group in one place.

    Rows are first counted per distinct value; the wanted positions are found on the running counts.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    s = sliced(counts, by, ["_x"])
    ranked = running(counts, by, ["_x"], {"_upto": ("sum", F.col("_n"))}, slices=s)
    totals = s.df.groupBy(*by).agg(F.sum("_n").alias("_total"))
    cond = [ranked[c].eqNullSafe(totals[c]) for c in by]
    if by:
        both = ranked.join(totals, cond).select(*[ranked[c] for c in by], "_x", "_n", "_upto", "_total")
    else:
        both = ranked.select("_x", "_n", "_upto").withColumn("_total", totals.select("_total").scalar())
    from_pos = F.col("_upto") - F.col("_n")  # the value fills positions [from_pos, _upto)
    aggs = []
    for name, q in qs.items():
        at = F.lit(q) * (F.col("_total") - 1)
        for tag, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((from_pos <= pos) & (pos < F.col("_upto")), F.col("_x"))).alias(f"_{tag}_{name}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_f_{name}"))
    picked = both.groupBy(*by).agg(*aggs)
    return picked.select(
        *by,
        *[
            (
                F.col(f"_lo_{n}").cast("double")
                + (F.col(f"_hi_{n}").cast("double") - F.col(f"_lo_{n}").cast("double")) * F.col(f"_f_{n}")
            ).alias(n)
            for n in qs
        ],
    )


def _runs(pdf: pd.DataFrame, cols: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows that agree on ``cols``."""
    changed = np.zeros(len(pdf), dtype=bool)
    for c in cols:
        codes, _ = pd.factorize(pdf[c])  # missing values share the code -1
        changed[1:] |= codes[1:] != codes[:-1]
    starts = [0, *np.flatnonzero(changed).tolist()] if len(pdf) else []
    for a, b in zip(starts, [*starts[1:], len(pdf)]):
        yield pdf.iloc[a:b]


def _scan(machine: Machine, keys: list[str], emit: str):
    """Streams rows sorted by key, slice and order; a group is never held as a whole.

    ``emit``: `rows`, the output of every row; `ends`, the state after each slice of a key; `tables`, the same for a key's first
    slice (``_first``) and the function from any state before it to the state after it for the others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = [*keys, SLICE]
        current, state, table = None, None, None

        def closing() -> pd.DataFrame:
            row = dict(zip(group, current))
            row["_state"] = json.dumps({"table": table.packed()} if table else {"state": state}) if emit == "tables" else json.dumps(state)
            return pd.DataFrame([row])

        for pdf in batches:
            for part in _runs(pdf, group):
                head = tuple(None if pd.isna(v) else v for v in part[group].iloc[0])
                if head != current:
                    if current is not None and emit != "rows":
                        yield closing()
                    current = head
                    text = part["_start"].iloc[0]
                    state = json.loads(text) if isinstance(text, str) else None
                    table = None
                    if emit == "tables" and not part["_first"].iloc[0]:
                        held = {r: part[f"_c_{r}"].iloc[0] for r in machine.seen}
                        table = TransitionTable(machine, state, {r: None if pd.isna(v) else int(v) for r, v in held.items()})
                if table:
                    table.follow(part)
                    continue
                state, rows = machine(state, part)
                if emit == "rows" and len(rows):
                    yield rows
        if current is not None and emit != "rows":
            yield closing()

    return run


def _arranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys, SLICE).sortWithinPartitions(*keys, SLICE, *order)


def _started(df: DataFrame, keys: list[str], order: list[str], machine: Machine, initial: DataFrame | None) -> DataFrame:
    """Rows with ``_slice`` and ``_start``, the state their (key, slice) starts from.

    Of a key that crosses slices, the first slice is folded from the key's initial state, every slice between the first and the
    last becomes a function from states to states, all at the same time; composing these few small functions along the key gives
    each slice its start. The rows themselves are folded once more, by the caller, whatever a key's share of them.
    """
    s = sliced(df, keys, order)
    if initial is None:
        rows = s.df.withColumn("_start", F.lit(None).cast("string"))
    else:
        known = initial.select(*keys, F.col("_state").alias("_start"))
        rows = s.df.join(known, _same(s.df, known, keys), "left").select(*[s.df[c] for c in s.df.columns], known["_start"])
    if s.slices <= 1:
        return rows
    spans = s.small(_spans(s, keys))
    inner = rows.join(spans, _of_keys(rows, spans, keys)).filter(F.col(SLICE) < F.col("_hi"))
    inner = inner.select(*[rows[c] for c in rows.columns], (F.col(SLICE) == F.col("_lo")).alias("_first"))
    if machine.seen:
        seen = _carried(s, keys, {r: (F.max, F.expr(x).cast("long")) for r, (x, _) in machine.seen.items()})
        met = inner.join(seen, (inner[SLICE] == seen["_k_slice"]) & _of_keys(inner, seen, keys), "left")
        inner = met.select(*[inner[c] for c in inner.columns], *[seen[f"_c_{r}"] for r in machine.seen])
    key_fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    schema = T.StructType([*key_fields, T.StructField(SLICE, T.IntegerType()), T.StructField("_state", T.StringType())])
    tables = _arranged(inner, keys, order).mapInPandas(_scan(machine, keys, "tables"), schema)
    last = _spans(s, keys)
    last = last.select(*[F.col(f"_k_{k}").alias(k) for k in keys], F.col("_hi").alias(SLICE), F.lit(None).cast("string").alias("_state"))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, begun = pdf.sort_values(SLICE), None, []
        for text in pdf["_state"]:
            begun.append(state)
            if text is not None:
                found = json.loads(text)
                state = json.dumps(apply_table(found["table"], json.loads(state)) if "table" in found else found["state"])
        return pdf.assign(_state=begun).iloc[1:]

    starts = tables.unionByName(last).groupBy(*keys).applyInPandas(compose, schema)
    starts = s.small(starts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(SLICE).alias("_k_slice"), F.col("_state").alias("_begin")))
    out = rows.join(starts, (rows[SLICE] == starts["_k_slice"]) & _of_keys(rows, starts, keys), "left")
    return out.select(*[rows[c] for c in rows.columns if c != "_start"], F.coalesce("_begin", "_start").alias("_start"))


def fold(
    df: DataFrame, keys: list[str], order: list[str], machine: Machine, out_schema: T.StructType, initial: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`ordered_fold` and the states of :func:`fold_states`, from one dealing of the rows."""
    started = _arranged(_started(df, keys, order, machine, initial), keys, order)
    schema = T.StructType(
        [*[df.schema[k] for k in keys], T.StructField(SLICE, T.IntegerType()), T.StructField("_state", T.StringType())]
    )
    ends = started.mapInPandas(_scan(machine, keys, "ends"), schema)
    return started.mapInPandas(_scan(machine, keys, "rows"), out_schema), ends.groupBy(*keys).agg(F.max_by("_state", SLICE).alias("_state"))


def ordered_fold(
    df: DataFrame, keys: list[str], order: list[str], machine: Machine, out_schema: T.StructType, initial: DataFrame | None = None
) -> DataFrame:
    """Fold the rows of each key in order with a small state, for recurrences no window can express.

    ``initial`` (keys, _state) holds the states to go on from. Slices are folded in parallel and the result is exact.
    """
    return fold(df, keys, order, machine, out_schema, initial)[0]


def fold_states(
    df: DataFrame, keys: list[str], order: list[str], machine: Machine, initial: DataFrame | None = None
) -> DataFrame:
    """(keys, _state) after all rows, for the keys that have rows."""
    return fold(df, keys, order, machine, T.StructType([T.StructField("_", T.StringType())]), initial)[1]
