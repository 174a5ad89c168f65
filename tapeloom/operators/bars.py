"""Trade bars: aggregation of a trade tape, with late events accounted for, and per-minute statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.bartime import FIXED, MINUTE, bar_open_ms, local_bar_times
from ..functions.numeric import EPS, ratio, sample_kurtosis, sample_skew
from .windows import carried


def classify(tape: DataFrame, interval: str = "1m", zone: str = "Asia/Taipei", cell: int = 1 << 18) -> DataFrame:
    """Add bar, owner, kind and out_of_order to a tape (symbol, seq, ts_ms, fallback_ms, ...), as one pass in order of
    arrival would.

    The open bar after some events is the greatest bar so far. An event of an older bar is ``late``: it is counted with the
    bar then open; an event without a time is ``bad``. The greatest bar so far is carried over cells of ``cell`` arrivals, so a busy symbol
    is many tasks; a further window spans the events of one bar.
    """
    missing = ~F.coalesce(F.col("ts_ms") > 0, F.lit(False))
    time = F.when(missing, F.coalesce("fallback_ms", F.lit(0))).otherwise(F.col("ts_ms"))
    rows = tape.withColumns({"missing_ts": missing, "time": time})
    rows = rows.withColumn("bar", F.when(F.col("time") > 0, bar_open_ms(F.col("time"), interval, zone)))
    rows = carried(rows, ["symbol"], "seq", cell, {"open_bar": ("max", F.col("bar"))})
    kind = F.when(F.col("bar").isNull(), "bad").when(F.col("bar") < F.col("open_bar"), "late").otherwise("ok")
    rows = rows.withColumn("kind", kind).withColumn("owner", F.when(F.col("bar").isNull(), F.col("open_bar")).otherwise(F.greatest("bar", "open_bar")))
    known = F.when((F.col("kind") == "ok") & (F.col("ts_ms") > 0), F.col("ts_ms"))
    last = F.last(known, ignorenulls=True).over(W.partitionBy("symbol", "owner").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("out_of_order", (F.col("kind") == "late") | ((F.col("kind") == "ok") & F.coalesce(F.col("ts_ms") < last, F.lit(False)) & ~F.col("missing_ts")))


#: Pluggable aggregates of a bar, by name: columns over the valid trades of one bar.
def base_stats(ok: Column) -> dict[str, Column]:
    return {
        "trade_count": F.count_if(ok), "trade_volume": F.sum(F.when(ok, F.col("qty"))),
        "trade_notional": F.sum(F.when(ok, F.col("price") * F.col("qty"))),
    }


def directional_flow(ok: Column) -> dict[str, Column]:
    side = lambda sell, x: F.coalesce(F.sum(F.when(ok & (F.col("is_buyer_maker") == sell), x)), F.lit(0.0))
    buy, sell = side(False, F.col("qty")), side(True, F.col("qty"))
    value = F.col("price") * F.col("qty")
    return {
        "buy_volume": buy, "sell_volume": sell, "buy_notional": side(False, value), "sell_notional": side(True, value),
        "signed_volume": buy - sell, "volume_imbalance": (buy - sell) / (buy + sell + EPS),
    }


def price_path(ok: Column) -> dict[str, Column]:
    price, seq = F.when(ok, F.col("price")), F.when(ok, F.col("seq"))
    first, last = F.min_by("price", seq), F.max_by("price", seq)
    volume = F.sum(F.when(ok, F.col("qty")))
    return {
        "vwap": F.when(volume > 0, F.sum(price * F.col("qty")) / F.when(volume > 0, volume)), "first_price": first, "last_price": last,
        "high_price": F.max(price), "low_price": F.min(price), "trade_return": F.when(first > 0, last / F.when(first > 0, first) - 1),
    }


def quality(ok: Column) -> dict[str, Column]:
    return {
        "has_nonpositive_qty": F.bool_or(ok & (F.col("qty") <= 0)), "has_nonpositive_price": F.bool_or(ok & (F.col("price") <= 0)),
        "out_of_order": F.bool_or("out_of_order"), "missing_ts": F.bool_or("missing_ts"), "late_trade_count": F.count_if(F.col("kind") == "late"),
        "last_recv_ms": F.max(F.when(ok, F.col("recv_ms"))),
    }


CALCULATORS = (base_stats, directional_flow, price_path, quality)


def trade_bars(tape: DataFrame, interval: str = "1m", zone: str = "Asia/Taipei", calculators=CALCULATORS, flush: bool = True) -> DataFrame:
    """A row for each symbol and bar that any valid trade fell in. ``calculators`` map the validity of a row to aggregates.

    With ``flush`` the bar still open at the end of the tape is closed too; without, each symbol's last bar is left out, as no later bar has closed it.
    """
    ok = F.col("kind") == "ok"
    columns = {k: v for c in calculators for k, v in c(ok).items()}
    out = classify(tape, interval, zone).where("owner is not null").groupBy("symbol", F.col("owner").alias("bar")).agg(*[v.alias(k) for k, v in columns.items()])
    if not flush:
        newest = out.groupBy("symbol").agg(F.max("bar").alias("bar"))
        out = out.join(newest, ["symbol", "bar"], "left_anti")
    return out.select("symbol", *local_bar_times(F.col("bar"), interval, zone), *columns)


def ohlcv(tape: DataFrame, interval: str = "1h", zone: str = "Asia/Taipei") -> DataFrame:
    """(symbol, bar, open, high, low, close, volume, trades); order within a bar is that of seq."""
    bar = bar_open_ms(F.col("ts_ms"), interval, zone)
    return tape.groupBy("symbol", bar.alias("bar")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum("qty").cast("double").alias("volume"), F.count(F.lit(1)).alias("trades"))


def minute_stats(tape: DataFrame, minutes: int = 1) -> DataFrame:
    """Price, size and side statistics of each bucket of minutes; moments are the sample-corrected ones of size, deviations are of the population."""
    q, p = F.col("qty").cast("double"), F.col("price")
    value = p * q
    buy = ~F.coalesce(F.col("is_buyer_maker"), F.lit(False))
    n = F.count(F.lit(1))
    out = tape.groupBy("symbol", (F.floor(F.col("ts_ms") / (minutes * MINUTE)) * minutes * MINUTE).alias("bar")).agg(
        F.avg(p).alias("price_mean"), F.max(p).alias("price_max"), F.min(p).alias("price_min"), F.stddev_pop(p).alias("price_std"),
        (F.max(p) - F.min(p)).alias("price_range"), ratio(F.sum(value), F.sum(q)).alias("vwap"), n.alias("trade_count"),
        F.sum(q).alias("qty_sum"), F.avg(q).alias("qty_mean"), F.max(q).alias("qty_max"), F.stddev_pop(q).alias("qty_std"),
        sample_skew(n, F.skewness(q)).alias("qty_skew"), sample_kurtosis(n, F.kurtosis(q)).alias("qty_kurt"), F.sum(value).alias("quote_sum"),
        F.coalesce(F.sum(F.when(buy, q)), F.lit(0.0)).alias("buy_qty"), F.coalesce(F.sum(F.when(~buy, q)), F.lit(0.0)).alias("sell_qty"),
        F.count_if(buy).alias("buy_count"), F.count_if(~buy).alias("sell_count"))
    total, trades = F.col("buy_qty") + F.col("sell_qty"), F.col("buy_count") + F.col("sell_count")
    return out.withColumns({
        "buy_ratio": ratio(F.col("buy_qty"), total), "buy_count_ratio": ratio(F.col("buy_count").cast("double"), trades),
        "imbalance": ratio(F.col("buy_qty") - F.col("sell_qty"), total), "volatility_proxy": ratio(F.col("price_std"), F.col("vwap")),
    })


def path_stats(tape: DataFrame, minutes: int = 15) -> DataFrame:
    """Realised variance of successive log prices, range and times between trades in each bucket of minutes."""
    width = minutes * MINUTE
    rows = tape.where("price > 0 and qty > 0").withColumn("bar", F.floor(F.col("ts_ms") / width) * width)
    w = W.partitionBy("symbol", "bar").orderBy("ts_ms", "seq")
    rows = rows.withColumns({"r": F.log(F.col("price") / F.lag("price").over(w)), "gap": (F.col("ts_ms") - F.lag("ts_ms").over(w)) / 1000.0})
    buy = ~F.coalesce(F.col("is_buyer_maker"), F.lit(False))
    q = F.col("qty").cast("double")
    return rows.groupBy("symbol", "bar").agg(
        ratio(F.sum(F.col("price") * q), F.sum(q)).alias("vwap"), F.count(F.lit(1)).alias("trade_count"),
        F.coalesce(F.sum(F.when(buy, q)), F.lit(0.0)).alias("buy_volume"), F.coalesce(F.sum(F.when(~buy, q)), F.lit(0.0)).alias("sell_volume"),
        F.count_if(buy).alias("buy_trades"), F.count_if(~buy).alias("sell_trades"), F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0)).alias("rv_var"),
        (F.max("price") - F.min("price")).alias("hl_range"), F.avg("gap").alias("mean_intertrade_time"), F.max("gap").alias("max_intertrade_time"))


def full_grid(bars: DataFrame, interval: str, zero: tuple[str, ...] = ()) -> DataFrame:
    """Every bar between each symbol's first and last; missing ones hold null, and 0 in the columns of ``zero``."""
    width = FIXED[interval] * MINUTE
    span = bars.groupBy("symbol").agg(F.min("bar").alias("a"), F.max("bar").alias("b"))
    grid = span.select("symbol", F.explode(F.sequence("a", "b", F.lit(width).cast("long"))).alias("bar"))
    return grid.join(bars, ["symbol", "bar"], "left").fillna(0, subset=list(zero)) if zero else grid.join(bars, ["symbol", "bar"], "left")
