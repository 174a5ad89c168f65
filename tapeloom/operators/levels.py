"""Support and resistance levels that form, flip and are tested: a state machine over the bars of a symbol, in batch and on arrival.

Two bars with volume at or above its moving average form a level halfway between the close of the first and the open of the
second: opposite bodies of like size (within a quarter of the larger), or bodies of one direction. A body through a level
flips its side; a wick alone tests it, after which it rests until a close beyond it. A bar that tests a flipped level with enough
volume is a signal to the side of the level; entry is the next open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Columns of the table of levels: price, side (1 support, -1 resistance), kind (1 opposite bodies, 2 one direction), valid, and times of creation, last flip and last test (NaN: never).
PRICE, SIDE, KIND, VALID, MADE, FLIPPED, TESTED = range(7)
SIGNAL = ["side", "level_price", "level_kind", "made_at", "flipped_at"]
STATE = "seen long, last double, ema double, prior array<double>, quiet_until long, levels array<double>, pending array<double>"


@dataclass(frozen=True)
class Rules:
    """Parameters: span of the volume average, levels kept, bars without signals at the start, and bars of rest after a signal."""

    span: int = 20
    most: int = 200
    lookback: int = 50
    cooldown: int = 0
    alike: float = 0.25


@dataclass
class Machine:
    """The state of one symbol: bounded by ``Rules.most`` levels."""

    rules: Rules
    seen: int = 0
    last: float = -np.inf
    ema: float = np.nan
    prior: list[float] = field(default_factory=list)  # open, close and whether volume sufficed, of the bar before
    quiet_until: int = 0
    levels: np.ndarray = field(default_factory=lambda: np.empty((0, 7)))
    pending: list[float] = field(default_factory=list)  # a signal that waits for the next open

    def packed(self) -> tuple:
        return self.seen, self.last, self.ema, self.prior, self.quiet_until, self.levels.ravel().tolist(), self.pending

    @classmethod
    def unpacked(cls, rules: Rules, state: tuple) -> Machine:
        seen, last, ema, prior, quiet, levels, pending = state
        return cls(rules, seen, last, ema, list(prior), quiet, np.asarray(levels, dtype=float).reshape(-1, 7), list(pending))

    def bar(self, t: float, o: float, h: float, low: float, c: float, v: float) -> tuple | None:
        """Take one bar that closes at t; the signal of the bar before with its entry price, if there was one. Bars not after the last are left out."""
        if not t > self.last:
            return None
        done = (*self.pending, o) if self.pending else None
        self.pending, self.last = [], float(t)
        self.seen += 1
        self.ema = v if self.seen == 1 else self.ema + (v - self.ema) * 2 / (self.rules.span + 1)
        busy = v >= self.ema
        if self.prior:
            self._form(t, o, c, busy)
            self._move(t, o, h, low, c)
            self.levels = self.levels[-self.rules.most :]
            if busy and self.seen > self.rules.lookback + 1 and self.seen > self.quiet_until:
                self._signal(t)
        self.prior = [o, c, float(busy)]
        return done

    def _form(self, t: float, o: float, c: float, busy: bool) -> None:
        o0, c0, busy0 = self.prior
        if not (busy and busy0):
            return
        up0, up = (1 if c0 > o0 else -1), (1 if c > o else -1)
        b0, b = abs(c0 - o0), abs(c - o)
        if up0 == up:
            kind, side = 2, up
        elif abs(b0 - b) <= max(b0, b) * self.rules.alike:
            kind, side = 1, -up0
        else:
            return
        self.levels = np.vstack([self.levels, [(c0 + o) / 2, side, kind, 1, t, np.nan, np.nan]])

    def _move(self, t: float, o: float, h: float, low: float, c: float) -> None:
        x = self.levels
        price, side, valid = x[:, PRICE], x[:, SIDE], x[:, VALID] == 1
        beyond = side * (c - price) < 0
        flips = valid & beyond & (side * (o - price) > 0)
        in_body = (min(o, c) <= price) & (price <= max(o, c))
        tests = valid & ~flips & (low <= price) & (price <= h) & ~in_body
        x[~valid & beyond, VALID] = 1
        x[flips, FLIPPED] = t
        x[flips, SIDE] *= -1
        x[tests, TESTED] = t
        x[tests, VALID] = 0

    def _signal(self, t: float) -> None:
        hits = np.flatnonzero((self.levels[:, TESTED] == t) & (self.levels[:, FLIPPED] < t))
        if len(hits):
            first = self.levels[hits[0]]
            self.pending = [float(t), *first[[SIDE, PRICE, KIND, MADE, FLIPPED]].tolist()]
            self.quiet_until = self.seen + self.rules.cooldown


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"t0": "int64", "side": "int32", "level_kind": "int32", "made_at": "int64", "flipped_at": "int64"})


def _schema(bars: DataFrame, key: str) -> str:
    return f"{key} {bars.schema[key].dataType.simpleString()}, t0 long, side int, level_price double, level_kind int, made_at long, flipped_at long, entry_price double"


def level_signals(bars: DataFrame, key: str, on: str, step: int, rules: Rules = Rules()) -> DataFrame:
    """(key, t0, side, level_price, level_kind, made_at, flipped_at, entry_price): the first signal of each bar; times are closes of bars.

    The state depends on every bar before, so each symbol is one sequence; its bars stream through a task in order and only the
    levels are held, never the series. Bars with a null are left out. A signal of the last bar has no entry and is left out.
    """
    cols = [key, on, "open", "high", "low", "close", "volume"]
    names = [key, "t0", *SIGNAL, "entry_price"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, machine = None, Machine(rules)
        for frame in batches:
            out = []
            for k, t, o, h, low, c, v in frame.itertuples(index=False):
                if k != now:
                    now, machine = k, Machine(rules)
                found = machine.bar(t + step, o, h, low, c, v)
                if found:
                    out.append((k, *found))
            yield _frame(out, names)

    ordered = bars.select(cols).dropna().repartition(key).sortWithinPartitions(key, on)
    return ordered.mapInPandas(run, _schema(bars, key))


def level_signals_on_arrival(bars: DataFrame, key: str, on: str, step: int, rules: Rules = Rules()) -> DataFrame:
    """The same over a stream of closed bars: a signal is emitted when the next bar of its symbol arrives. The state is the levels of each symbol."""
    names = [key, "t0", *SIGNAL, "entry_price"]

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine.unpacked(rules, state.get) if state.exists else Machine(rules)
        rows = pd.concat(list(frames)).sort_values(on)  # the bars of one micro-batch
        found = [machine.bar(t + step, o, h, low, c, v) for t, o, h, low, c, v in rows[[on, "open", "high", "low", "close", "volume"]].itertuples(index=False)]
        state.update(machine.packed())
        yield _frame([(group[0], *f) for f in found if f], names)

    cols = bars.select(key, on, *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]).dropna()
    return cols.groupBy(key).applyInPandasWithState(run, _schema(bars, key), STATE, "append", GroupStateTimeout.NoTimeout)
