"""A local order book on arrival: snapshots and differences of a stream keep the levels of each symbol, with rebuilding after gaps."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

LEVELS = "array<struct<price:double,qty:double>>"
OUTPUT = f"symbol string, seq long, epoch long, last_id long, in_sequence boolean, applied long, dropped long, waiting long, gaps long, silent boolean, bids {LEVELS}, asks {LEVELS}"
_PAIRS = "array<struct<price:string,qty:string>>"


class _Book(StatefulProcessor):
    """State of a symbol: its levels (by side and price as text), differences that wait for a snapshot, and where it is in the sequence."""

    def __init__(self, depth: int, silent_ms: int | None):
        self.depth, self.silent_ms = depth, silent_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "last_id long, in_sequence boolean, epoch long, seq long")
        self.levels = handle.getMapState("levels", "side string, price string", "qty double")
        self.waiting = handle.getListState("waiting", "seq long, first_id long, final_id long, prev_id long, bids string, asks string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.load()
        self.count = dict.fromkeys(("applied", "dropped", "gaps"), 0)
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for row in events[["kind", "seq", "first_id", "final_id", "prev_id", "last_id", "bids", "asks"]].astype(object).itertuples(index=False):
            whole = [None if x is None or x != x else x for x in row]
            self.seq = int(whole[1])
            if whole[0] == "snapshot":
                self.snapshot(int(whole[5]), whole[6], whole[7])
            else:
                self.difference((self.seq, int(whole[2]), int(whole[3]), None if whole[4] is None else int(whole[4]), whole[6], whole[7]))
        self.save()
        if self.silent_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due[0] if isinstance(due, (tuple, list)) else due)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        yield self.report(key[0], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.load()
        self.count = dict.fromkeys(("applied", "dropped", "gaps"), 0)
        yield self.report(key[0], True)

    # --- one event

    def snapshot(self, last_id: int, bids: str, asks: str) -> None:
        if self.in_sequence:
            return
        self.wipe()
        self.last_id, self.epoch = last_id, self.epoch + 1
        self.change("bid", bids)
        self.change("ask", asks)
        held, self.held = self.held, []
        for event in held:
            self.difference(event)

    def difference(self, event: tuple) -> None:
        _, first, final, before, bids, asks = event
        if self.last_id is None:
            self.held.append(event)
            return
        if not self.in_sequence:
            # up to the snapshot: old; the first that holds the next id starts the sequence
            if final <= self.last_id or not first <= self.last_id + 1 <= final:
                self.count["dropped"] += 1
                return
            self.in_sequence = True
        elif (first - 1 if before is None else before) != self.last_id:
            self.count["gaps"] += 1
            self.wipe()
            self.held.append(event)
            return
        self.change("bid", bids)
        self.change("ask", asks)
        self.last_id = final
        self.count["applied"] += 1

    def wipe(self) -> None:
        self.last_id, self.in_sequence = None, False
        self.gone |= set(self.book)
        self.book.clear()

    def change(self, side: str, levels: str | None) -> None:
        for level in json.loads(levels or "[]"):
            place, qty = (side, level["price"]), float(level["qty"])
            if qty:
                self.book[place] = qty
            else:
                self.book.pop(place, None)
            self.gone.add(place)

    # --- state

    def load(self) -> None:
        self.last_id, self.in_sequence, self.epoch, self.seq = self.at.get() if self.at.exists() else (None, False, 0, None)
        self.last_id = None if self.last_id is None or self.last_id != self.last_id else int(self.last_id)
        self.book = {tuple(k): v[0] for k, v in self.levels.iterator()} if self.levels.exists() else {}
        self.held = [(*map(int, e[:3]), None if e[3] is None or e[3] != e[3] else int(e[3]), *e[4:]) for e in self.waiting.get()] if self.waiting.exists() else []
        self.gone: set = set()  # places that differ from the state
        self.held_before = len(self.held), self.epoch

    def save(self) -> None:
        self.at.update((self.last_id, self.in_sequence, self.epoch, self.seq))
        for place in self.gone:
            if place in self.book:
                self.levels.updateValue(place, (self.book[place],))
            elif self.levels.containsKey(place):
                self.levels.removeKey(place)
        if self.held:
            self.waiting.put(self.held)
        elif self.held_before[0]:
            self.waiting.clear()

    def report(self, symbol: str, silent: bool) -> pd.DataFrame:
        sides = {side: sorted(((float(p), q) for (s, p), q in self.book.items() if s == side), reverse=side == "bid")[: self.depth] for side in ("bid", "ask")}
        shown = {side: [{"price": p, "qty": q} for p, q in levels] for side, levels in sides.items()}
        return pd.DataFrame([{
            "symbol": symbol, "seq": self.seq, "epoch": self.epoch, "last_id": self.last_id, "in_sequence": bool(self.in_sequence), **{k: self.count[k] for k in ("applied", "dropped")},
            "waiting": len(self.held), "gaps": self.count["gaps"], "silent": silent, "bids": shown["bid"], "asks": shown["ask"],
        }]).astype({"seq": "Int64", "last_id": "Int64"})


def books_on_arrival(events: DataFrame, depth: int = 20, silent_ms: int | None = None) -> DataFrame:
    """The best levels of each symbol's book after each micro-batch with news of it.

    events: (symbol, seq, kind, first_id, final_id, prev_id, last_id, bids, asks); kind is ``diff`` or ``snapshot`` (which has last_id), sides are arrays of (price, qty) as
    text, a quantity of zero removes its level. Differences wait until a snapshot comes; those up to its last_id are dropped, and the first that holds last_id + 1 starts the
    sequence. In sequence, a difference whose prev_id (or first_id - 1) is not the last id is a gap: the book is emptied and waits, from this difference on, for
    the next snapshot, which begins the next epoch. Snapshots that come while the book is in sequence are ignored. With ``silent_ms`` a symbol
    without news for so long is reported once more.

    State is kept in RocksDB (set spark.sql.streaming.stateStore.providerClass): levels by place, so a batch writes what it changes. The events of a symbol in one
    micro-batch are sorted by seq together. A symbol is one task, as its book is one sequence.
    """
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        raise ValueError("books_on_arrival needs the RocksDB state store")
    sides = [F.to_json(F.col(c).cast(_PAIRS)).alias(c) for c in ("bids", "asks")]
    rows = events.select("symbol", F.col("seq").cast("long"), "kind", *[F.col(c).cast("long") for c in ("first_id", "final_id", "prev_id", "last_id")], *sides)
    return rows.groupBy("symbol").transformWithStateInPandas(_Book(depth, silent_ms), OUTPUT, "update", "processingTime" if silent_ms is not None else "none")
