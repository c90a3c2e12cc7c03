"""Small state machines, and the function from the state before some records to the state after them.

Records of a machine are normally followed from a known state. Where that state is not known yet, the machine is followed from all
states at once: registers that hold numbers start as unknowns, and a comparison that an unknown does not decide parts the states
into two ranges. Ranges that lead to one state are joined again, so a few of them stay, however many records follow.
"""

from __future__ import annotations

import math
from itertools import product

import pandas as pd

_LEAST, _MOST = -math.inf, math.inf


class Machine:
    """One state per key. ``columns`` of a row make its record; ``categories`` names the registers that hold one of some values,
    all others hold whole numbers, which a step may keep, replace, shift by a number and compare with numbers.

    ``seen`` limits what a register may hold: a SQL expression of a row, of which the register never exceeds the largest so far (or
    its first value), and whether it is always equal to that. States that cannot occur then need not be followed.
    """

    columns: list[str] = []
    categories: dict[str, list] = {}
    seen: dict[str, tuple[str, bool]] = {}

    def start(self) -> dict:
        raise NotImplementedError

    def advance(self, state: dict, record: dict) -> tuple:
        """Applies a record to the state in place; returns what the output shows of the record."""
        raise NotImplementedError

    def output(self, rows: pd.DataFrame, shown: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def records(self, rows: pd.DataFrame):
        for values in zip(*[rows[c].tolist() for c in self.columns]):
            yield dict(zip(self.columns, values))

    def __call__(self, state: dict | None, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        s = dict(state) if state else self.start()
        return s, self.output(rows, [self.advance(s, r) for r in self.records(rows)])


class _Undecided(Exception):
    def __init__(self, name: str, at: int) -> None:
        self.name, self.at = name, at


class Unknown:
    """sign * (register at the start) + shift."""

    __slots__ = ("ask", "name", "shift", "sign")

    def __init__(self, ask, name: str, sign: int = 1, shift: float = 0) -> None:
        self.ask, self.name, self.sign, self.shift = ask, name, sign, shift

    def __add__(self, c):
        return Unknown(self.ask, self.name, self.sign, self.shift + c)

    __radd__ = __add__

    def __sub__(self, c):
        return self + -c

    def __rsub__(self, c):
        return Unknown(self.ask, self.name, -self.sign, c - self.shift)

    def __le__(self, c) -> bool:
        if self.sign > 0:
            return self.ask(self.name, math.floor(c - self.shift))
        return not self.ask(self.name, math.ceil(self.shift - c) - 1)

    def __lt__(self, c) -> bool:
        if self.sign > 0:
            return self.ask(self.name, math.ceil(c - self.shift) - 1)
        return not self.ask(self.name, math.floor(self.shift - c))

    def __ge__(self, c) -> bool:
        return not self < c

    def __gt__(self, c) -> bool:
        return not self <= c

    def __eq__(self, c) -> bool:
        return self <= c and self >= c

    def __ne__(self, c) -> bool:
        return not self == c

    __hash__ = None


#: values of the categories, and lowest and highest value of each other register at the start
Range = tuple[tuple, tuple[tuple[float, float], ...]]


class TransitionTable:
    """Which state after the records followed so far belongs to which states before them."""

    def __init__(self, machine: Machine, first: dict | None = None, largest: dict | None = None) -> None:
        """``first``: the state before all records of the key, ``largest``: of each ``seen`` expression over those before these."""
        self.machine = machine
        first = first or machine.start()
        self.registers = list(first)
        self.numbers = [r for r in self.registers if r not in machine.categories]
        bounds = {r: (_LEAST, _MOST) for r in self.numbers}
        for r, value in (largest or {}).items():
            most = first[r] if value is None else max(first[r], value)
            bounds[r] = (most if machine.seen[r][1] else _LEAST, most)
        every = tuple(bounds[r] for r in self.numbers)
        self.classes: dict[tuple, list[Range]] = {}
        for values in product(*machine.categories.values()):
            fixed = dict(zip(machine.categories, values))
            state = tuple(fixed[r] if r in fixed else ("unknown", r, 1, 0) for r in self.registers)
            self.classes[state] = [(values, every)]

    def follow(self, rows: pd.DataFrame) -> None:
        for record in self.machine.records(rows):
            after: dict[tuple, list[Range]] = {}
            todo = list(self.classes.items())
            while todo:
                state, ranges = todo.pop()
                try:
                    end = self._advance(state, ranges, record)
                except _Undecided as e:
                    todo += [(state, part) for part in self._parted(ranges, e.name, e.at)]
                    continue
                held = after.setdefault(end, [])
                for r in ranges:
                    self._join(held, r)
            self.classes = after

    def _advance(self, state: tuple, ranges: list[Range], record: dict) -> tuple:
        def ask(name: str, at: int) -> bool:
            k = self.numbers.index(name)
            if all(r[1][k][1] <= at for r in ranges):
                return True
            if all(r[1][k][0] > at for r in ranges):
                return False
            raise _Undecided(name, at)

        s = {r: Unknown(ask, *v[1:]) if isinstance(v, tuple) else v for r, v in zip(self.registers, state)}
        self.machine.advance(s, record)
        return tuple(("unknown", v.name, v.sign, v.shift) if isinstance(v, Unknown) else v for v in (s[r] for r in self.registers))

    def _parted(self, ranges: list[Range], name: str, at: int) -> list[list[Range]]:
        k = self.numbers.index(name)
        low, high = [], []
        for values, bounds in ranges:
            a, b = bounds[k]
            if a <= at:
                low.append((values, (*bounds[:k], (a, min(b, at)), *bounds[k + 1 :])))
            if b > at:
                high.append((values, (*bounds[:k], (max(a, at + 1), b), *bounds[k + 1 :])))
        return [low, high]

    @staticmethod
    def _join(held: list[Range], new: Range) -> None:
        """Adds a range; neighbours that differ in one register become one."""
        joined = True
        while joined:
            joined = False
            for i, old in enumerate(held):
                differ = [k for k, (a, b) in enumerate(zip(old[1], new[1])) if a != b]
                if old[0] != new[0] or len(differ) > 1:
                    continue
                if differ:
                    k = differ[0]
                    (a, b), (c, d) = sorted((old[1][k], new[1][k]))
                    if b + 1 < c:
                        continue
                    new = (new[0], (*new[1][:k], (a, max(b, d)), *new[1][k + 1 :]))
                del held[i]
                joined = True
                break
        held.append(new)

    def packed(self) -> dict:
        """The table as JSON holds it; no bound is null."""
        bound = lambda x: None if math.isinf(x) else x
        ranges = lambda rs: [[list(v), [[bound(a), bound(b)] for a, b in bounds]] for v, bounds in rs]
        return {"registers": self.registers, "categories": list(self.machine.categories), "numbers": self.numbers, "classes": [[[list(v) if isinstance(v, tuple) else v for v in s], ranges(rs)] for s, rs in self.classes.items()]}


def apply_table(table: dict, state: dict) -> dict:
    """The state after a table's records, from the state before them."""
    values = [state[c] for c in table["categories"]]
    numbers = [state[n] for n in table["numbers"]]
    for after, ranges in table["classes"]:
        for held, bounds in ranges:
            if held == values and all((a is None or a <= x) and (b is None or x <= b) for x, (a, b) in zip(numbers, bounds)):
                return {r: v[2] * state[v[1]] + v[3] if isinstance(v, list) else v for r, v in zip(table["registers"], after)}
    raise ValueError(f"no range holds {state}")
