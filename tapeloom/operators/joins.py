"""Joins in time: as-of, interval, gather and parity joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranks import numbered
from .windows import DAYS_30, carried, keep_first

MINUTE = 60_000


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], tolerance: int | None = None, exact: bool = True, cell: int = DAYS_30) -> DataFrame:
    """For each left row the last right row of the same key at or before its time (before it, if not ``exact``).

    One union, whose right rows' values ride along as a struct; the last one is carried forward by cells of ``cell`` units of time, so a hot key is
    many tasks. Rows further back than ``tolerance`` count as none. Of right rows with one time the last by values wins.
    """
    l, names = "l", left.columns
    a = left.select(*by, F.col(on).alias("at"), F.lit(1 if exact else 0).alias("side"), F.struct(*names).alias(l), F.lit(None).cast(_struct(right, [on, *values])).alias("r"))
    b = right.select(*by, F.col(on).alias("at"), F.lit(0 if exact else 1).alias("side"), F.lit(None).cast(_struct(left, names)).alias(l), F.struct(F.col(on), *values).alias("r"))
    rows = carried(a.union(b), by, "at", cell, {"found": ("last", F.col("r"))}, ("side", "r"), own=True).where("l is not null")
    near = F.lit(True) if tolerance is None else F.col("at") - F.col("found")[on] <= tolerance
    return rows.select("l.*", *[F.when(near, F.col("found")[v]).alias(v) for v in values])


def _struct(df: DataFrame, names: list[str]) -> str:
    return "struct<" + ",".join(f"`{n}`:{df.schema[n].dataType.simpleString()}" for n in names) + ">"


def asof_fill(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """Like ``asof_backward`` for one value, but a null on the right looks further back."""
    return asof_backward(left, right.where(F.col(value).isNotNull()), by, on, [value])


def align(events: DataFrame, grid: DataFrame, by: list[str], on: str, mode: str = "exact") -> DataFrame:
    """Events with the grid time they belong to: their own (``exact``) or the last one before or at it (``pad``)."""
    times = grid.select(*by, F.col(on)).distinct()
    if mode == "exact":
        return events.join(times.withColumn("grid_time", F.col(on)), [*by, on])
    return asof_backward(events, times.withColumn("grid_time", F.col(on)), by, on, ["grid_time"]).where("grid_time is not null")


BAR_KEY = ["symbol", "bar_interval", "bar_open_ms"]


def on_bar_key(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Bars of two kinds by their common key: symbol, interval and opening time."""
    return left.join(right, BAR_KEY, how)


def overlap_only(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Rows of ``a`` between the later start and the earlier end of both."""
    span = a.agg(F.min(on).alias("a0"), F.max(on).alias("a1")).crossJoin(b.agg(F.min(on).alias("b0"), F.max(on).alias("b1")))
    span = span.select(F.greatest("a0", "b0").alias("lo"), F.least("a1", "b1").alias("hi"))  # one row
    return a.join(F.broadcast(span), F.col(on).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def flatten_minutes(bars: DataFrame, minutes: DataFrame, by: list[str], on: str, values: list[str], n: int = 15, fill: bool = False, cell: int = DAYS_30) -> DataFrame:
    """The n minutes before each bar as columns m0_x (oldest) to m{n-1}_x. Bars are unique; of several rows of a minute the greatest value counts.

    Bars and minutes meet in cells of time, where one frame over the last n minutes gathers a bar's rows and each is put in its place: both tables are shuffled once, and only minutes near
    the end of a cell go to the next one too. With ``fill`` a minute that is there takes over missing values from the minutes before it, or 0; a minute that is not there
    has none either way."""
    if fill:
        filled = carried(minutes.select(*by, on, *values), by, on, cell, {f"last {v}": ("last", F.col(v)) for v in values}, own=True)
        minutes = filled.select(*by, on, *[F.coalesce(F.col(f"`last {v}`"), F.lit(0)).alias(v) for v in values])
    span = n * MINUTE
    home = lambda at: F.floor(at / cell)
    one = F.struct(F.col(on).alias("at"), *[F.col(v).alias(f"v{k}") for k, v in enumerate(values)])
    inner = minutes.select(*by, F.col(on).cast("long").alias(on), one.alias("minute row"), F.explode(F.sequence(home(F.col(on)), home(F.col(on) + span))).alias("cell of time"))
    outer = bars.select(*by, F.col(on).cast("long").alias(on), F.lit(None).cast(inner.schema["minute row"].dataType).alias("minute row"), home(F.col(on)).alias("cell of time"))
    both = inner.withColumn("is bar", F.lit(False)).unionByName(outer.withColumn("is bar", F.lit(True)))
    frame = W.partitionBy(*by, "cell of time").orderBy(on).rangeBetween(-span, -1)
    rows = both.withColumn("minute rows", F.collect_list("minute row").over(frame)).where("`is bar`")

    def pick(k: int, field: str) -> Column:
        there = F.filter("minute rows", lambda m: m["at"] == F.col(on) - (n - k) * MINUTE)
        return F.array_max(F.transform(there, lambda m: m[field]))

    return rows.select(*by, on, *[pick(k, f"v{j}").alias(f"m{k}_{v}") for k in range(n) for j, v in enumerate(values)])


def within(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, cell: int) -> DataFrame:
    """Points with the spans [start, end) that hold them: an equi-join on cells of time, then the exact condition."""
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(end) - 1) / cell))))
    keyed = points.withColumn("cell", F.floor(F.col(at) / cell))
    return keyed.join(cells, [*by, "cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("cell")


def attach_labels(bars: DataFrame, events: DataFrame, policy: str = "prefer_fail", sides: str = "both", align_by: str = "exact", drop_null: bool = True) -> DataFrame:
    """Bars (symbol, ts) with side, label and t1 of the event (symbol, t0, side, label, t1) at that time, one at most.

    Events of other sides than ``sides`` (``both``, ``long``, ``short``) and, with ``drop_null``, those without label go. Of those that repeat
    (t0, side, label) the one with the latest t1 stays, then of a side the one that the policy prefers. With ``both``, a long and a short event at
    one t0 raise an error when the rows are read. ``align_by`` pad moves an event to the last bar at or before it; of several that then share a bar the latest wins.
    """
    wanted = events if sides == "both" else events.where(F.col("side") == (1 if sides == "long" else -1))
    if drop_null:
        wanted = wanted.where(F.col("label").isNotNull())
    order = {"prefer_fail": [F.asc("label"), F.asc("t1")], "prefer_win": [F.desc("label"), F.desc("t1")], "earliest_t1": [F.asc("t1"), F.asc("label")], "latest_t1": [F.desc("t1"), F.desc("label")]}[policy]
    one = wanted.groupBy("symbol", "t0", "side", "label").agg(F.max("t1").alias("t1"))
    one = keep_first(one, ["symbol", "t0", "side"], order)
    both = one.groupBy("symbol", "t0").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("side", "label", "t1")])
    both = both.withColumn("t0", F.when(F.col("n") == 1, F.col("t0")).otherwise(F.raise_error(F.lit("a long and a short event at one t0: choose a side")).cast("long"))).drop("n")
    at = both.withColumn("ts", F.col("t0"))
    if align_by == "pad":
        at = align(at, bars.select("symbol", "ts"), ["symbol"], "ts", "pad").drop("ts").withColumnRenamed("grid_time", "ts")
        at = at.groupBy("symbol", "ts").agg(*[F.max_by(c, "t0").alias(c) for c in ("side", "label", "t1")])
    return bars.join(at.select("symbol", "ts", "side", "label", "t1"), ["symbol", "ts"], "left")


def parity(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts of matching, differing and one-sided keys."""
    both = a.select(*keys, F.col(value).alias("va"), F.lit(True).alias("in_a")).join(b.select(*keys, F.col(value).alias("vb"), F.lit(True).alias("in_b")), keys, "full_outer")
    state = F.when(F.col("in_b").isNull(), "only_left").when(F.col("in_a").isNull(), "only_right").when(F.col("va").eqNullSafe(F.col("vb")), "match").otherwise("mismatch")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def number_in_order(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return numbered(df, key, order).withColumn("k", F.col("i") + 1).drop("i")


def match_in_order(a: DataFrame, b: DataFrame, key: list[str], order_a: list[str], order_b: list[str]) -> DataFrame:
    """The k-th row of a key on one side with the k-th on the other."""
    return number_in_order(a, key, order_a).join(number_in_order(b, key, order_b), [*key, "k"])


def missing_keys(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def chain(df: DataFrame, maps: list[tuple[DataFrame, str, str]], default: Column) -> DataFrame:
    """Successive lookups: each map (table, key, value) is left-joined; what is absent gets the default."""
    for table, key, value in maps:
        df = df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, default))
    return df


def gaps(times: DataFrame, on: str, step: int) -> DataFrame:
    """Missing stretches (from, to) of a regular series: gaps and islands by the lead of each time."""
    w = W.partitionBy(*[c for c in times.columns if c != on]).orderBy(on)
    nxt = F.lead(on).over(w)
    return times.withColumn("next", nxt).where(F.col("next") - F.col(on) > step).select(*[c for c in times.columns if c != on], (F.col(on) + step).alias("gap_from"), (F.col("next") - step).alias("gap_to"))
