"""The function of some records against following them from each state."""

from __future__ import annotations

import json
import random

import pandas as pd
import pytest

from tideline.operators import cdc
from tideline.operators.health import Breaker
from tideline.operators.machine import Machine, TransitionTable, Unknown, apply_table


def ends(machine, state, rows):
    s = dict(state)
    for record in machine.records(rows):
        machine.advance(s, record)
    return s


def feed(rng, n, start=0):
    rows, ts, src, snk = [], start, rng.randrange(5), rng.randrange(5)
    for _ in range(n):
        ts += rng.choice([0, 1, 1000, 20_000, 30_000, 31_000])
        kind = rng.choice(["tick", "tick", "tick", "write", "event"])
        src, snk = max(0, src + rng.choice([-2, 0, 0, 3])), max(0, snk + rng.choice([-1, 0, 1, 2]))
        event = rng.choice([*cdc.START_EVENTS, *cdc.CLOSE_EVENTS, *cdc.ACTIVITY_EVENTS, *cdc.FAIL_EVENTS, "other"]) if kind == "event" else None
        rows.append((ts, kind, event, src if kind == "tick" else 0, snk if kind == "tick" else 0))
    return pd.DataFrame(rows, columns=cdc.Monitor.columns)


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("seed", range(6))
def test_monitor(seed, compat):
    rng = random.Random(seed)
    machine, before, rows = cdc.Monitor([], compat), feed(rng, rng.choice([1, 30, 200])), None
    start = ends(machine, machine.start(), before)
    rows = feed(rng, rng.choice([1, 5, 60]), int(before.ts.max()))
    largest = {r: int(before.ts.max()) for r in ("last_event", "update", "sync_start", "published")}
    ticks = before[before.kind == "tick"]
    largest |= {"prev_source": int(ticks.source_received.max()) if len(ticks) else None, "sink_mark": int(ticks.sink_written.max()) if len(ticks) else None}
    table = TransitionTable(machine, None, largest)
    for part in (rows.iloc[:3], rows.iloc[3:]):
        table.follow(part)
    packed = json.loads(json.dumps(table.packed()))
    assert apply_table(packed, start) == ends(machine, start, rows)
    for _ in range(60):  # any state within the limits
        prev = -1 if largest["prev_source"] is None else max(-1, largest["prev_source"])
        top, mark = int(before.ts.max()), max(0, largest["sink_mark"] or 0)
        state = {"state": rng.choice(machine.categories["state"]), "prev_source": prev, "sink_mark": rng.randint(0, mark)}
        state |= {r: max(0, top - rng.choice([0, 1, 999, 29_999, 30_000, 10**6])) for r in ("last_event", "update", "sync_start", "published")}
        state = {r: state[r] for r in machine.start()}
        assert apply_table(packed, state) == ends(machine, state, rows)


@pytest.mark.parametrize("seed", range(6))
def test_breaker_from_any_state(seed):
    rng, ts, rows = random.Random(seed), 0, []
    for _ in range(60):
        ts += rng.choice([0, 5, 50, 70])
        rows.append((ts, rng.random() < 0.3))
    machine = Breaker("key", ["ts"], 3, 60)
    rows = pd.DataFrame(rows, columns=["ts", "_ok"])
    table = TransitionTable(machine)
    table.follow(rows)
    packed = json.loads(json.dumps(table.packed()))
    for _ in range(200):
        state = {"n": rng.randrange(7), "until": rng.randrange(-5, ts + 100)}
        assert apply_table(packed, state) == ends(machine, state, rows)


def test_comparisons_part_the_states():
    class Compare(Machine):
        columns = ["c"]

        def start(self):
            return {"x": 0, "y": 0}

        def advance(self, state, record):
            x, c = state["x"], record["c"]
            state["y"] = sum(2**i for i, yes in enumerate((x < c, x <= c, x > c, x >= c, x == c, x != c, c - x < 2, 3 - x >= c, x + 1 > 2.5, 2.5 > x, c <= x)) if yes)

    for c in (-2, 0, 3, 2.5):
        table = TransitionTable(Compare())
        table.follow(pd.DataFrame({"c": [c]}))
        for x in range(-6, 8):
            state = {"x": x, "y": 9}
            assert apply_table(table.packed(), state) == ends(Compare(), state, pd.DataFrame({"c": [c]}))
    with pytest.raises(TypeError):
        hash(Unknown(None, "x"))


def test_many_records_keep_few_ranges():
    rng = random.Random(1)
    before, machine = feed(rng, 50), cdc.Monitor([], True)
    rows = feed(rng, 3000, int(before.ts.max()))
    table = TransitionTable(machine, None, {**{r: int(before.ts.max()) for r in ("last_event", "update", "sync_start", "published")}, "prev_source": int(before.source_received.max()), "sink_mark": int(before.sink_written.max())})
    table.follow(rows)
    assert len(table.classes) < 50 and sum(map(len, table.classes.values())) < 500
