"""Streaming trade bars and last-write-wins tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.numeric import EPS

#: What a bar holds while it is open, by name and type.
FIELDS = {
    "bar": "long", "trade_count": "long", "trade_volume": "double", "trade_notional": "double", "buy_volume": "double", "sell_volume": "double", "buy_notional": "double", "sell_notional": "double",
    "first_price": "double", "last_price": "double", "high_price": "double", "low_price": "double", "has_nonpositive_qty": "boolean", "has_nonpositive_price": "boolean", "out_of_order": "boolean",
    "missing_ts": "boolean", "late_trade_count": "long", "last_recv_ms": "long",
}
STATE = ", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", last_ts long"
_TRADE = {"fallback_ms": "long", "recv_ms": "long", "is_buyer_maker": "boolean"}


class OpenBar(dict):
    """The open bar of a symbol; trades are taken in one by one."""

    @classmethod
    def at(cls, bar: int, price: float) -> "OpenBar":
        own = cls({k: {"long": 0, "double": 0.0, "boolean": False}[v] for k, v in FIELDS.items()})
        own.update(bar=bar, first_price=price, last_price=price, high_price=price, low_price=price, last_recv_ms=None, last_ts=None)
        return own

    def take(self, ts: int | None, price: float, qty: float, sells: bool, recv: int | None) -> None:
        """``ts`` is the trade's own time, None if a fallback was used."""
        self["trade_count"] += 1
        self["trade_volume"] += qty
        self["trade_notional"] += price * qty
        side = "sell" if sells else "buy"
        self[f"{side}_volume"] += qty
        self[f"{side}_notional"] += price * qty
        self.update(last_price=price, high_price=max(self["high_price"], price), low_price=min(self["low_price"], price))
        self["has_nonpositive_qty"] |= qty <= 0
        self["has_nonpositive_price"] |= price <= 0
        if ts is None:
            self["missing_ts"] = True
        else:
            self["out_of_order"] |= self["last_ts"] is not None and ts < self["last_ts"]
            self["last_ts"] = ts
        if recv is not None:
            self["last_recv_ms"] = recv if self["last_recv_ms"] is None else max(self["last_recv_ms"], recv)


def bars_on_arrival(tape: DataFrame, width_ms: int = 60_000, on: str = "ts_ms", flush_after_ms: int | None = None) -> DataFrame:
    """Bars of a stream (symbol, seq, ts_ms, price, qty; fallback_ms, recv_ms and is_buyer_maker if there) with the columns of ``trade_bars``: a bar is emitted when a
    trade of a later bar arrives. A trade of an older bar is dropped and counted with the bar then open; one without any time only marks it. With ``flush_after_ms`` a bar
    is also emitted when its symbol has been silent so long; a later trade may then open an older bar again.

    The state is one bar for each symbol. The trades of a symbol in one micro-batch are sorted by seq together, so the batch's size bounds the memory.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = None
        if state.exists:
            held = OpenBar(zip([*FIELDS, "last_ts"], state.get))
        done = []
        if state.hasTimedOut:
            state.remove()
            done, held = [held] if held else [], None
        else:
            whole = pd.concat(list(frames)).sort_values("seq", kind="stable")
            for ts, fallback, recv, price, qty, sells in whole[[on, "fallback_ms", "recv_ms", "price", "qty", "is_buyer_maker"]].astype(object).itertuples(index=False):
                own = int(ts) if not pd.isna(ts) and ts > 0 else None
                time = own if own is not None else 0 if pd.isna(fallback) else int(fallback)
                if time <= 0:
                    if held:
                        held["missing_ts"] = True
                    continue
                bar = time // width_ms * width_ms
                if held and bar < held["bar"]:
                    held["late_trade_count"] += 1
                    held["out_of_order"] = True
                    held["missing_ts"] |= own is None
                    continue
                if held and bar > held["bar"]:
                    done.append(held)
                    held = None
                if held is None:
                    held = OpenBar.at(bar, float(price))
                held.take(own, float(price), float(qty), bool(sells) and not pd.isna(sells), None if pd.isna(recv) else int(recv))
            if held:
                state.update(tuple(held[k] for k in [*FIELDS, "last_ts"]))
                if flush_after_ms is not None:
                    state.setTimeoutDuration(flush_after_ms)
        frame = pd.DataFrame([[key[0], *(b[k] for k in FIELDS)] for b in done], columns=["symbol", *FIELDS])
        yield frame.astype({k: {"long": "Int64", "double": "float64", "boolean": "boolean"}[v] for k, v in FIELDS.items()})

    rows = tape.select("symbol", "seq", on, F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"), *[(F.col(c) if c in tape.columns else F.lit(None)).cast(t).alias(c) for c, t in _TRADE.items()])
    timeout = GroupStateTimeout.NoTimeout if flush_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    out = rows.groupBy("symbol").applyInPandasWithState(run, "symbol string, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items()), STATE, "append", timeout)
    buy, sell, first = F.col("buy_volume"), F.col("sell_volume"), F.col("first_price")
    return out.withColumns({
        "signed_volume": buy - sell, "volume_imbalance": (buy - sell) / (buy + sell + EPS), "vwap": F.when(F.col("trade_volume") > 0, F.col("trade_notional") / F.when(F.col("trade_volume") > 0, F.col("trade_volume"))),
        "trade_return": F.when(first > 0, F.col("last_price") / F.when(first > 0, first) - 1),
    })


def bars_by_watermark(tape: DataFrame, width: str = "1 minute", delay: str = "1 minute", on: str = "ts") -> DataFrame:
    """The same by Spark's own watermark: late trades within the delay still count; later ones are dropped without being counted."""
    return tape.withWatermark(on, delay).groupBy("symbol", F.window(on, width)).agg(F.count(F.lit(1)).alias("trade_count"), F.sum("qty").alias("trade_volume"), F.sum(F.col("price") * F.col("qty")).alias("trade_notional"))


def closed_once(klines: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Closed bars of a stream (symbol, close_ts, is_closed), each once."""
    return klines.where("is_closed").withWatermark("close_ts", delay).dropDuplicatesWithinWatermark(["symbol", "close_ts"])


def merge_latest(path: str, keys: list[str], seq: str):
    """A function for ``foreachBatch`` that keeps the last row of each key in the table at ``path``: each batch writes a new
    version beside the old one and a repeated batch writes the same version again, so retries change nothing."""
    from ..operators.book import last_write_wins

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0:
            rows = batch.sparkSession.read.parquet(f"{path}/v{batch_id - 1}").unionByName(batch)
        last_write_wins(rows, keys, seq).write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return run


def append_latest(path: str, keys: list[str], seq: str, every: int = 32):
    """A function for ``foreachBatch`` that keeps a table of the last row of each key at the cost of the batch: a batch adds its own part, and every ``every``
    batches the parts become a new base. A repeated batch writes its part again, so retries change nothing. ``read_latest`` reads it."""
    from ..operators.book import last_write_wins

    def run(batch: DataFrame, batch_id: int) -> None:
        last_write_wins(batch, keys, seq).write.mode("overwrite").parquet(f"{path}/kind=part/version={batch_id}")
        if (batch_id + 1) % every == 0:
            read_latest(batch.sparkSession, path, keys, seq, before=batch_id).write.mode("overwrite").parquet(f"{path}/kind=base/version={batch_id}")

    return run


def read_latest(spark: SparkSession, path: str, keys: list[str], seq: str, before: int | None = None) -> DataFrame:
    """The last row of each key in a table of ``append_latest``: the newest base (older than batch ``before``) and the parts after it; other files are not read."""
    from ..operators.book import last_write_wins

    rows = spark.read.parquet(path)
    if before is not None:
        rows = rows.where(F.when(F.col("kind") == "base", F.col("version") < before).otherwise(F.col("version") <= before))
    base = rows.where("kind = 'base'").agg(F.max("version")).first()[0]
    if base is not None:
        rows = rows.where((F.col("version") > base) | ((F.col("version") == base) & (F.col("kind") == "base")))
    return last_write_wins(rows.drop("kind", "version"), keys, seq)


def write_days_on_arrival(rows: DataFrame, path: str, checkpoint: str, recv_ms: str = "recv_ms", zone: str = "Asia/Taipei", every: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Start a query that writes a stream as JSON lines by local day of receipt, each row in its own day. A batch ends after ``every``; how many rows
    it may hold is the source's option (``maxFilesPerTrigger`` or the like). ``once``: what is there now, then stop."""
    day = F.date_format(F.from_utc_timestamp(F.timestamp_millis(recv_ms), zone), "yyyy-MM-dd")
    sink = rows.withColumn("dt", day).writeStream.partitionBy("dt").format("json").option("checkpointLocation", checkpoint).outputMode("append")
    return (sink.trigger(availableNow=True) if once else sink.trigger(processingTime=every)).start(path)


def newest_book(path: str, k: int | None = None):
    """A function for ``foreachBatch`` over full books (symbol, side, price, qty, seq): the levels of each symbol's newest seq of the batch, at most the ``k`` best,
    overwrite its folder; symbols without news keep theirs."""
    from ..operators.book import top_levels

    def run(batch: DataFrame, batch_id: int) -> None:
        newest = batch.join(batch.groupBy("symbol").agg(F.max("seq").alias("seq")), ["symbol", "seq"])
        if k is not None:
            level = F.explode("levels").alias("level")
            newest = top_levels(newest, k).select("symbol", "side", level).select("symbol", "side", "level.*")
        newest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)

    return run
