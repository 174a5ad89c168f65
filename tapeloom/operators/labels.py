"""Labels of bars and events, and the statistics of labelled trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import clean, gated, ratio
from .ranks import expanding_quantile, in_chunks
from .windows import DAYS_30, carried, fractional_difference, fractional_weights, last_n, positions

BLOCK = 256  # bars in a block, and blocks in a block of blocks


def forward_return(close: Column, w: WindowSpec, k: int) -> Column:
    return F.log(F.lead(close, k).over(w) / close)


def _past_deviation(bars: DataFrame, w: WindowSpec, width: int, name: str) -> DataFrame:
    """Add the deviation of the last ``width`` one-bar log returns, the present one included; null below half of them."""
    rows = bars.withColumn("one bar", F.log(F.col("close") / F.lag("close").over(w)))
    frame = last_n(w, width)
    return rows.withColumn(name, gated(F.stddev_samp("one bar").over(frame), F.col("one bar"), frame, max(2, width // 2))).drop("one bar")


def fixed_horizon(bars: DataFrame, by: list[str], on: str, k: int, kind: str = "bps", bps: float = 5.0, cost_bps: float = 10.0, width: int = 96, scale: float = 0.5, q: float = 0.3, least: int = 500, fractional: tuple[float, float] | None = None) -> DataFrame:
    """Add y_reg (log return of the next k bars) and y_cls: 2 up, 0 down, 1 flat; unknown returns or sizes are flat.

    A move counts beyond a size known at the bar before, so the first bar of a series is flat: ``bps`` or ``cost`` (fixed basis points),
    ``vol`` (deviation of the last ``width`` returns, times ``scale`` and the root of k), ``quantile`` (the greater magnitude of the q and 1 - q
    quantiles of all past k-bar returns, of which there are ``least``). ``triple``: as ``touch_label`` with ``scale`` deviations both ways.
    ``fractional`` (order, least weight): y_reg is the move over k bars of the fractionally differenced log price; y_cls stays as it is.
    """
    if kind not in ("bps", "cost", "vol", "quantile", "triple"):
        raise ValueError(f"unknown kind of label: {kind}")
    close, own = F.col("close"), bars.columns
    if fractional is not None:
        bars = carried(bars, by, on, DAYS_30, {"log close": ("last", clean(F.log(close)))}, own=True)
    back = max(k, width + 1, len(fractional_weights(*fractional)) if fractional is not None else 0)

    def work(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = W.partitionBy(*keys).orderBy("i")
        rows = rows.withColumn("ahead", forward_return(close, w, k))
        if kind in ("bps", "cost"):
            rows = rows.withColumn("size", F.lag(F.lit((bps if kind == "bps" else cost_bps) / 1e4)).over(w))
        elif kind == "vol":
            rows = _past_deviation(rows, w, width, "size").withColumn("size", F.lag(F.col("size") * (scale * k**0.5)).over(w))
        elif kind == "quantile":
            rows = rows.withColumn("past", F.log(close / F.lag(close, k).over(w)))
        else:
            rows = _past_deviation(rows, w, width, "size").withColumn("log of close", F.log(close))
            ahead = w.rowsBetween(1, k)
            known = (F.count("log of close").over(ahead) == k) & F.col("size").isNotNull()
            up = F.max("log of close").over(ahead) - F.col("log of close") >= scale * F.col("size")
            down = F.min("log of close").over(ahead) - F.col("log of close") <= -scale * F.col("size")
            rows = rows.withColumn("y_cls", F.when(~known, -1).when(up & ~down, 2).when(down & ~up, 0).otherwise(1))
        if fractional is not None:
            rows = rows.withColumn("level", fractional_difference(F.col("log close"), w, *fractional))
            rows = rows.withColumn("moved", F.lead("level", k).over(w) - F.col("level"))
        return rows

    rows = in_chunks(bars, by, on, back, k, work)
    if kind == "quantile":
        rows = expanding_quantile(rows, by, on, "past", {"low size": q, "high size": 1 - q}, least)
        rows = rows.withColumn("size", F.greatest(F.abs("low size"), F.abs("high size")))
    if kind != "triple":
        rows = rows.withColumn("y_cls", F.when(F.col("ahead") > F.col("size"), 2).when(F.col("ahead") < -F.col("size"), 0).otherwise(1))
    return rows.select(*own, F.col("moved" if fractional is not None else "ahead").alias("y_reg"), "y_cls")


def touch_label(bars: DataFrame, by: list[str], on: str, k: int, up: float, down: float) -> DataFrame:
    """Add y_touch: 2 if only the upper level is reached by a close of the next k bars, 0 if only the lower, 1 if both or none, -1 if fewer bars follow."""

    def work(rows: DataFrame, keys: list[str]) -> DataFrame:
        ahead = W.partitionBy(*keys).orderBy("i").rowsBetween(1, k)
        full = F.count("close").over(ahead) == k
        high = F.max("close").over(ahead) >= F.col("close") * (1 + up)
        low = F.min("close").over(ahead) <= F.col("close") * (1 - down)
        return rows.withColumn("y_touch", F.when(~full, -1).when(high & ~low, 2).when(low & ~high, 0).otherwise(1))

    return in_chunks(bars, by, on, 0, k, work).drop("i")


def volatility(bars: DataFrame, by: list[str], on: str, n: int) -> DataFrame:
    """Add vol: the mean true range of n bars over close, of the bar before."""
    w = W.partitionBy(*by).orderBy(on)
    before = F.lag("close").over(w)
    rows = bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    rows = rows.withColumn("atr", gated(F.avg("tr").over(last_n(w, n)), F.col("tr"), last_n(w, n), n) / F.col("close"))
    return rows.withColumn("vol", F.lag("atr").over(w)).drop("tr", "atr")


def _paths(bars: DataFrame, events: DataFrame, by: list[str], on: str, horizon: int, step: int) -> DataFrame:
    """Distinct (by, t0, side, entry_price, vol) with path: the bar at t0 and the ``horizon`` bars after it, by position, as an ordered array.

    Bars are numbered by counts of cells first, so no window spans a whole series; each event meets its bars in one equi-join on
    (key, number). An event whose t0 is no bar has an empty path.
    """
    numbered = positions(bars.select(*by, on, "open", "high", "low"), by, on, 1024 * step)
    ev = events.select(*by, "t0", "side", "entry_price", "vol").distinct()
    start = ev.join(numbered.select(*by, F.col(on).alias("t0"), F.col("i").alias("at")), [*by, "t0"])
    steps = start.select(*ev.columns, F.explode(F.sequence("at", F.col("at") + horizon)).alias("i"))
    bar = F.struct("i", F.col(on).alias("t"), "open", "high", "low")
    found = steps.join(numbered, [*by, "i"]).groupBy(*by, "t0", "side").agg(F.array_sort(F.collect_set(bar)).alias("path"))
    return ev.join(found, [*by, "t0", "side"], "left")


def _crosses(b: Column) -> Column:
    return (b["high"] >= F.col("upper")) | (b["low"] <= F.col("lower"))


def _first(blocks: str, at: str, after: Column) -> Column:
    """The first element of ``blocks`` beyond ``after`` (none where that is null) that reaches a barrier."""
    return F.try_element_at(F.filter(blocks, lambda b: (b[at] > after) & _crosses(b)), F.lit(1))


def _to_the_end(bars: DataFrame, events: DataFrame, by: list[str], on: str, step: int) -> DataFrame:
    """Events (with upper, lower) with hit, the first bar from t0 on that reaches a barrier, and end, the last bar's time (null where t0 is no bar).

    Extremes of blocks of bars, and of blocks of blocks, are looked up before bars are: an event meets at most four arrays of BLOCK elements and
    one with an element for each BLOCK * BLOCK bars of its key, each by an equi-join, however far its barrier lies.
    """
    wide = BLOCK * BLOCK
    n = positions(bars.select(*by, on, "open", "high", "low"), by, on, 1024 * step).withColumn("block", F.floor(F.col("i") / BLOCK))
    extremes = [F.max("high").alias("high"), F.min("low").alias("low")]
    small = n.groupBy(*by, "block").agg(F.array_sort(F.collect_list(F.struct("i", F.col(on).alias("t"), "open", "high", "low"))).alias("of bars"), *extremes)
    large = small.groupBy(*by, F.floor(F.col("block") / BLOCK).alias("area")).agg(F.array_sort(F.collect_list(F.struct("block", "high", "low"))).alias("of blocks"), *extremes)
    tops = large.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("area", "high", "low"))).alias("of areas"))
    in_bars, in_blocks = small.select(*by, "block", "of bars"), large.select(*by, "area", "of blocks")

    ends = bars.groupBy(*by).agg(F.max(on).alias("end"))
    ev = events.join(n.select(*by, F.col(on).alias("t0"), F.col("i").alias("at")), [*by, "t0"], "left").join(ends, by, "left").withColumn("end", F.when(F.col("at").isNotNull(), F.col("end")))
    ev = ev.withColumns({"block": F.floor(F.col("at") / BLOCK), "area": F.floor(F.col("at") / wide)})
    ev = ev.join(in_bars, [*by, "block"], "left").withColumn("hit", _first("of bars", "i", F.col("at") - 1)).drop("of bars")
    ev = ev.join(in_blocks, [*by, "area"], "left").withColumn("next", F.when(F.col("hit").isNull(), _first("of blocks", "block", F.col("block"))["block"])).drop("of blocks")
    ev = ev.join(tops, by, "left").withColumn("area", F.when(F.col("hit").isNull() & F.col("next").isNull(), _first("of areas", "area", F.col("area"))["area"])).drop("of areas")
    ev = ev.join(in_blocks, [*by, "area"], "left").withColumn("block", F.coalesce("next", _first("of blocks", "block", F.lit(-1))["block"])).drop("of blocks", "area", "next")
    ev = ev.join(in_bars, [*by, "block"], "left").withColumn("hit", F.coalesce("hit", _first("of bars", "i", F.col("at") - 1)))
    return ev.drop("of bars", "block", "at")


def _met(bars: DataFrame, events: DataFrame, by: list[str], on: str, horizon: int | None, step: int, barriers) -> DataFrame:
    """Distinct events with their barriers (``barriers`` adds upper and lower, perhaps as several rows), hit and end, over ``horizon`` bars or, if None, to the end."""
    if horizon is None:
        return _to_the_end(bars, barriers(events.select(*by, "t0", "side", "entry_price", "vol").distinct()), by, on, step)
    ev = barriers(_paths(bars, events, by, on, horizon, step))
    return ev.withColumns({"hit": F.try_element_at(F.filter("path", _crosses), F.lit(1)), "end": F.try_element_at("path", F.lit(-1))["t"]}).drop("path")


def _clipped(vol_range: tuple[float, float]) -> Column:
    vol = F.col("vol").cast("double")
    return F.when(vol.isNotNull() & ~F.isnan(vol), F.least(F.greatest(vol, F.lit(vol_range[0])), F.lit(vol_range[1])))


def _touch(bar: Column, first: Column) -> Column:
    """What a bar decides: ``upper``, ``lower``, ``both`` or null. Beyond its first bar an event is decided by an open beyond a barrier."""
    up, down = bar["high"] >= F.col("upper"), bar["low"] <= F.col("lower")
    gap_up, gap_down = ~first & (bar["open"] >= F.col("upper")), ~first & (bar["open"] <= F.col("lower"))
    return F.when(gap_up, "upper").when(gap_down, "lower").when(up & down, "both").when(up, "upper").when(down, "lower")


def _outcome(touch: Column, open_price: Column, both: str) -> Column:
    """1 for a win, 0 for a loss, null if open; a bar that reaches both barriers by the rule ``both``."""
    long_side = F.col("side") > 0
    far_up, far_down = F.abs(open_price - F.col("upper")), F.abs(open_price - F.col("lower"))
    nearer = F.when(far_up < far_down, long_side.cast("int")).when(far_down < far_up, (~long_side).cast("int"))
    tie = {"fail": F.lit(0), "win": F.lit(1), "nan": F.lit(None).cast("int"), "nearer": nearer}[both]
    return F.when(touch == "upper", long_side.cast("int")).when(touch == "lower", (~long_side).cast("int")).when(touch == "both", tie)


def triple_barrier(bars: DataFrame, events: DataFrame, by: list[str], on: str, horizon: int | None, step: int, up: float, down: float, vol_range=(1e-4, 1.0), both: str = "fail", low: DataFrame | None = None) -> DataFrame:
    """Events (by, t0, side, entry_price, vol) with pt, sl, label, t1: which barrier the bar at t0 or one of the ``horizon`` bars after it
    (None: any bar up to the end) reaches first.

    The barriers are entry * exp(up * vol) above and entry * exp(-down * vol) below; for a long the upper one wins, for a short the
    lower. A bar that opens beyond a barrier decides by its open. For one that reaches both, the bars of ``low`` inside it (same
    columns, ``step`` is the width of the large bar) are asked first; what stays open is ``fail`` (0), ``win`` (1), ``nan`` (null)
    or ``nearer`` (the barrier nearer to the open; null if equal). No touch: label null, t1 the last bar looked at. t0 off the
    bars, or no vol: label and t1 null. Repeated events count once.
    """
    v, long_side = _clipped(vol_range), F.col("side") > 0
    barriers = lambda ev: ev.withColumns({"upper": F.col("entry_price") * F.exp(up * v), "lower": F.col("entry_price") * F.exp(-down * v)})
    met = _met(bars, events, by, on, horizon, step, barriers)
    met = met.withColumns({"pt": F.when(long_side, F.col("upper")).otherwise(F.col("lower")), "sl": F.when(long_side, F.col("lower")).otherwise(F.col("upper")), "touch": _touch(F.col("hit"), F.col("hit.t") == F.col("t0"))})
    keys = [*by, "t0", "side", "entry_price", "pt", "sl", "vol"]
    label, t1 = _outcome(F.col("touch"), F.col("hit.open"), both), F.when(F.col("upper").isNotNull(), F.coalesce("hit.t", "end"))
    if low is not None:
        inner = low.select(*by, (F.floor(F.col(on) / step) * step).alias("bar_of"), F.struct(F.col(on).alias("t"), "open", "high", "low").alias("b"))
        both_hit = met.where("touch = 'both'").select(*by, "t0", "side", "entry_price", "vol", "upper", "lower", F.col("hit.t").alias("bar_of"))
        seen = both_hit.join(inner, [*by, "bar_of"]).withColumn("inner_touch", _touch(F.col("b"), F.lit(False))).where("inner_touch is not null")
        small = seen.groupBy(*by, "t0", "side", "entry_price", "vol").agg(F.min_by(F.struct("inner_touch", "b"), "b.t").alias("small"))
        met = met.join(small, [*by, "t0", "side", "entry_price", "vol"], "left")
        label = F.when(F.col("small").isNotNull(), _outcome(F.col("small.inner_touch"), F.col("small.b.open"), both)).otherwise(label)
        t1 = F.coalesce("small.b.t", t1)
    return met.select(*keys, label.alias("label"), t1.alias("t1"))


def barrier_grid(bars: DataFrame, events: DataFrame, by: list[str], on: str, horizon: int | None, step: int, ups: list[float], downs: list[float], both: str = "fail") -> DataFrame:
    """Wins and losses for every pair of multiples, in one job: an event becomes a row for each pair, out of a literal array."""
    pairs, v = F.array(*[F.struct(F.lit(float(u)).alias("up"), F.lit(float(d)).alias("down")) for u in ups for d in downs]), _clipped((1e-4, 1.0))

    def barriers(ev: DataFrame) -> DataFrame:
        rows = ev.withColumn("pair", F.explode(pairs)).withColumns({"up": F.col("pair.up"), "down": F.col("pair.down")}).drop("pair")
        return rows.withColumns({"upper": F.col("entry_price") * F.exp(F.col("up") * v), "lower": F.col("entry_price") * F.exp(-F.col("down") * v)})

    met = _met(bars, events, by, on, horizon, step, barriers)
    label = _outcome(_touch(F.col("hit"), F.col("hit.t") == F.col("t0")), F.col("hit.open"), both)
    return met.groupBy("up", "down").agg(F.count(F.lit(1)).alias("events"), F.count_if(label == 1).alias("wins"), F.count_if(label == 0).alias("losses"))


def trade_summary(trades: DataFrame) -> DataFrame:
    """Totals, results and win rates, overall and for each side, by grouping sets (side null: overall).

    Without trades the overall row is there too: counts 0, results and win rate null. A roll-up of no rows has none, so a row that is no trade is rolled up along.
    """
    pnl = F.coalesce(F.when(F.col("label") == 1, F.abs(F.col("pt") / F.col("entry_price") - 1)).when(F.col("label") == 0, -F.abs(F.col("sl") / F.col("entry_price") - 1)), F.lit(0.0))
    rows = trades.select("side", "label", pnl.alias("pnl"), F.lit(True).alias("is_trade"))
    none = trades.sparkSession.range(1, numPartitions=1).select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != "is_trade"], F.lit(False).alias("is_trade"))
    out = rows.union(none).rollup("side").agg(
        F.count_if("is_trade").alias("trades"), F.count_if(F.col("label") == 1).alias("wins"), F.sum("pnl").alias("pnl_sum"), F.avg("pnl").alias("pnl_mean"), F.grouping("side").alias("overall"))
    return out.where("trades > 0 or overall = 1").drop("overall").withColumn("win_rate", ratio(F.col("wins"), F.col("trades")))


def flip_signals(bars: DataFrame, by: list[str], on: str, lookback: int) -> DataFrame:
    """Breakout signals as rows (symbol, t0, side, entry_price): a close beyond the range of the bars before; entry at the next open.

    A sequence of signals of one side counts once, at its first bar.
    """
    w = W.partitionBy(*by).orderBy(on)
    past = w.rowsBetween(-lookback, -1)
    side = F.when(F.col("close") > F.max("high").over(past), 1).when(F.col("close") < F.min("low").over(past), -1)
    rows = bars.withColumns({"side": F.when(F.count("close").over(past) == lookback, side), "entry_price": F.lead("open").over(w), "t0": F.lead(on).over(w)}).where("side is not null")
    rows = rows.withColumn("before", F.lag("side").over(w)).where("(before is null or before <> side) and t0 is not null")
    return rows.select(*by, "t0", "side", "entry_price")
