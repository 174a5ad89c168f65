"""Rolling, expanding and filling operators on ordered series.

``halo`` splits long series: rows are dealt into chunks of time, each with the rows before it that its frames
reach, so one hot symbol is worked on by many tasks. Frames bounded by the halo give the same values as on the whole series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import EPS, clean, gated

#: Milliseconds of a cell that series of bars are cut into.
DAYS_30 = 30 * 86_400_000


def halo(df: DataFrame, on: str, chunk: int, before: int, after: int = 0) -> DataFrame:
    """Rows with the chunk they are worked on in; ``own`` marks the one copy to keep (see ``own_rows``)."""
    home = F.floor(F.col(on) / chunk)
    reach = F.sequence(F.floor((F.col(on) - after) / chunk), F.floor((F.col(on) + before) / chunk))
    return df.withColumn("chunk", F.explode(reach)).withColumn("own", F.col("chunk") == home)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("own").drop("chunk", "own")


def positions(df: DataFrame, by: list[str], on: str, cell: int, order: tuple[str, ...] = ()) -> DataFrame:
    """Add i: the number of a row in its series, from 0. Rows are counted by cells of ``cell`` units of ``on`` first, so that no
    window spans a whole series, only its cells. Times are unique in a series, or ``order`` tells rows of one time apart."""
    cut = df.withColumn("cell_of", F.floor(F.col(on) / cell))
    counts = cut.groupBy(*by, "cell_of").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(*by).orderBy("cell_of").rowsBetween(W.unboundedPreceding, -1)  # a row for each cell
    base = counts.select(*by, "cell_of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy(*by, "cell_of").orderBy(on, *order)) - 1
    return cut.join(base, [*by, "cell_of"]).withColumn("i", F.col("base") + place).drop("cell_of", "base")


def carried(df: DataFrame, by: list[str], on: str, cell: int, values: dict[str, tuple[str, Column]], order: tuple[str, ...] = (), own: bool = False) -> DataFrame:
    """Add for each name what the rows before a row of its series bring along (with the row itself, if ``own``): their greatest value (``max``), their
    last one that is no null (``last``) or their ``sum``.

    Rows are ordered by ``on``, then ``order``. Values are brought together by cells of ``cell`` units of ``on`` first, so a hot series is many tasks: windows span
    a cell, and one row for each cell. A negative ``cell`` looks from the end of the series backwards.
    """
    down = cell < 0
    key = F.floor(F.col(on) / abs(cell))
    sorts = [F.desc(c) if down else F.asc(c) for c in (on, *order)]
    rows = df.withColumns({"cell_of": -key if down else key, **{f"value of {n}": v for n, (_, v) in values.items()}})
    value = lambda n: F.col(f"`value of {n}`")
    place = F.struct(on, *order)
    whole = {
        "max": F.max, "sum": F.sum,
        "last": lambda v: (F.min_by if down else F.max_by)(v, F.when(v.isNotNull(), place)),
    }
    cells = rows.groupBy(*by, "cell_of").agg(*[whole[kind](value(n)).alias(n) for n, (kind, _) in values.items()])
    past, inside = W.partitionBy(*by).orderBy("cell_of").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by, "cell_of").orderBy(*sorts).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    over = {"max": F.max, "sum": F.sum, "last": lambda v: F.last(v, ignorenulls=True)}
    base = cells.select(*[F.col(b).alias(f"key {b}") for b in by], F.col("cell_of").alias("key cell"), *[over[kind](F.col(f"`{n}`")).over(past).alias(f"base of {n}") for n, (kind, _) in values.items()])
    same = F.col("cell_of").eqNullSafe(F.col("`key cell`"))
    for b in by:
        same = same & F.col(f"`{b}`").eqNullSafe(F.col(f"`key {b}`"))
    both = {
        "max": F.greatest, "last": lambda base, here: F.coalesce(here, base),
        "sum": lambda base, here: F.when(base.isNotNull() | here.isNotNull(), F.coalesce(base, F.lit(0)) + F.coalesce(here, F.lit(0))),
    }
    found = [both[kind](F.col(f"`base of {n}`"), over[kind](value(n)).over(inside)).alias(n) for n, (kind, _) in values.items()]
    return rows.join(base, same, "left").select(*[F.col(f"`{c}`") for c in df.columns if c not in values], *found)


def series(by: list[str], on: str) -> WindowSpec:
    return W.partitionBy(*by).orderBy(on)


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def rolling_z(x: Column, w: WindowSpec, n: int, least: int, live: bool = False) -> Column:
    """Offline: deviation of the population with a floor of 1e-8. Live: of the sample; none or zero counts as 1e-8, and missing results are 0."""
    r = last_n(w, n)
    if live:
        sd = F.stddev_samp(x).over(r)
        sd = F.when(sd.isNull() | (sd == 0), 1e-8).otherwise(sd)
        return F.coalesce(clean((x - F.avg(x).over(r)) / sd), F.lit(0.0))
    sd = F.greatest(F.stddev_pop(x).over(r), F.lit(1e-8))
    return gated((x - F.avg(x).over(r)) / sd, x, r, least)


def spike(x: Column, w: WindowSpec, n: int = 20) -> Column:
    mean = F.avg(x).over(last_n(w, n))
    return F.when(mean != 0, x / F.when(mean != 0, mean) - 1)


def jump_flag(x: Column, w: WindowSpec, threshold: float = 0.001) -> Column:
    logged = F.when(x > 0, F.log(F.when(x > 0, x)))
    return F.coalesce((F.abs(logged - F.lag(logged).over(w)) > threshold).cast("int"), F.lit(0))


def slope(x: Column, w: WindowSpec, n: int) -> Column:
    """Least-squares slope over exactly n rows at unit distance, by a weighted sum of lags."""
    mean = (n - 1) / 2
    norm = sum((k - mean) ** 2 for k in range(n))
    total = sum(((n - 1 - k) - mean) / norm * (F.lag(x, k).over(w) if k else x) for k in range(n))
    return total


def exponential_mean(df: DataFrame, by: list[str], on: str, x: str, alpha: float, cell: int = DAYS_30, name: str = "ewm", chunk: int | None = None) -> DataFrame:
    """Add y of y_0 = x_0, y_t = (1 - alpha) * y_(t-1) + alpha * x_t over the rows of each series with a value; the others are left out.

    The recurrence is linear, so a series is cut into chunks of rows: within a chunk y is a weighted sum (one window), and what a chunk takes over from those before
    it fades with known weights, so the last few chunks' sums give it to a double's precision. No task holds a series, and values equal those of one pass.
    """
    if alpha >= 1:
        return positions(df.where(F.col(x).isNotNull()), by, on, cell).withColumn(name, F.col(x).cast("double")).select(*df.columns, "i", name)
    fade = -math.log(1 - alpha)
    size = chunk or max(1, int(min(600 / fade, max(4096, 0.1 / fade))))
    back = max(1, math.ceil(40 / (fade * size)))  # what is older weighs less than 4e-18
    rows = positions(df.where(F.col(x).isNotNull()), by, on, cell).withColumns({"ewm chunk": F.floor(F.col("i") / size), "ewm at": F.col("i") % size})
    at = F.col("`ewm at`")
    term = F.col(x) * F.when(F.col("i") == 0, 1.0).otherwise(alpha) * F.exp(fade * at)
    rows = rows.withColumn("ewm term", term)
    sums = rows.groupBy(*by, "ewm chunk").agg((F.sum("`ewm term`") * math.exp(-fade * (size - 1))).alias("own"))
    before = W.partitionBy(*by).orderBy("ewm chunk").rowsBetween(-back, -1)  # a row for each chunk
    taken = F.aggregate(F.collect_list("own").over(before), F.lit(0.0), lambda y, b: y * math.exp(-fade * size) + b)
    rows = rows.join(sums.select(*by, "ewm chunk", taken.alias("ewm taken")), [*by, "ewm chunk"])
    here = F.sum("`ewm term`").over(W.partitionBy(*by, "ewm chunk").orderBy("i").rowsBetween(W.unboundedPreceding, 0)) * F.exp(-fade * at)
    return rows.withColumn(name, here + F.exp(-fade * (at + 1)) * F.col("`ewm taken`")).select(*df.columns, "i", name)


def reduced(df: DataFrame, by: list[str], on: str, x: str, kind: str, n: int, q: float = 0.8, half_life: float | None = None) -> DataFrame:
    """(by, on, value): a window's summary at each row: ``last``, ``sma``, ``zscore``, ``slope``, ``percentile`` (of the last n rows), ``ema``, ``ewm_zscore`` (half-life n // 2,
    2 at least). Null before max(3, n // 4) values, for slopes before max(5, n // 3). Rows without a value have none in the exponential forms."""
    least = max(5, n // 3) if kind == "slope" else max(3, n // 4)
    c, w = F.col(x), series(by, on)
    r = last_n(w, n)
    if kind in ("ema", "ewm_zscore"):
        alpha = 1 - math.exp(-math.log(2) / (half_life or max(2, n // 2)))
        out = exponential_mean(df.select(*by, on, x), by, on, x, alpha, name="mean")
        if kind == "ema":
            return out.select(*by, on, F.when(F.col("i") >= least - 1, F.col("mean")).alias("value"))
        # deviations about each series' first value lose fewer digits
        first = df.groupBy(*by).agg(F.min_by(x, F.when(c.isNotNull(), F.col(on))).alias("first"))
        moved = df.select(*by, on, x).join(first, by).withColumn("d", F.col(x) - F.col("first")).withColumn("d2", F.col("d") * F.col("d"))
        m1, m2 = (exponential_mean(moved.select(*by, on, k), by, on, k, alpha, name=f"m_{k}").drop("i", k) for k in ("d", "d2"))
        keep = (1 - alpha) ** 2
        weights = F.pow(F.lit(keep), F.col("i")) + alpha**2 * (1 - F.pow(F.lit(keep), F.col("i"))) / (1 - keep)  # sum of squared weights
        sd = F.sqrt(F.greatest(F.col("m_d2") - F.col("m_d") * F.col("m_d"), F.lit(0.0)) / F.when(weights < 1, 1 - weights))
        both = out.join(m1, [*by, on]).join(m2, [*by, on])
        return both.select(*by, on, F.when(F.col("i") >= least - 1, (F.col(x) - F.col("mean")) / (sd + EPS)).alias("value"))
    row = F.row_number().over(w).cast("double")
    if kind == "slope":
        df = df.withColumn("row at", row)
        value = F.regr_slope(c, F.col("`row at`")).over(r)
    else:
        value = {"last": lambda: c, "sma": lambda: F.avg(c).over(r), "zscore": lambda: (c - F.avg(c).over(r)) / (F.stddev_pop(c).over(r) + EPS), "percentile": lambda: F.percentile(c, F.lit(q)).over(r)}[kind]()
    return df.select(*by, on, (c if kind == "last" else gated(value, c, r, least)).alias("value"))


def decay_linear(x: Column, w: WindowSpec, n: int) -> Column:
    """Weighted mean of the last n values, the newest heaviest."""
    total = n * (n + 1) / 2
    return sum((n - k) / total * (F.lag(x, k).over(w) if k else x) for k in range(n))


def pct_rank_all(x: Column, *by: str) -> Column:
    """Average rank over the whole group as a share; looks ahead by definition."""
    from ..functions.numeric import average_rank

    return average_rank(x, *by) / F.count(x).over(W.partitionBy(*by))


def ffill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))


def bfill(x: Column, w: WindowSpec) -> Column:
    return F.first(x, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))


def fill(df: DataFrame, by: list[str], on: str, columns: list[str], method: str, cell: int = DAYS_30) -> DataFrame:
    """``raise``: fail on the first null or NaN; ``zero``; ``last``: forward, then backward; ``linear``: between neighbours by position, ends as in ``last``. Times are unique in a series;
    it is worked on by cells of ``cell`` units of ``on``."""
    if method == "raise":
        refused = {c: F.when(clean(F.col(c)).isNull(), F.raise_error(F.lit(f"no number in {c}"))).otherwise(F.col(c)) for c in columns}
        return df.withColumns(refused)
    if method == "zero":
        return df.fillna(0, subset=columns)
    if method == "last":
        first = df.groupBy(*by).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(on))).alias(f"first {c}") for c in columns])
        rows = carried(df, by, on, cell, {f"last {c}": ("last", F.col(c)) for c in columns}, own=True).join(first, by)
        return rows.select(*[F.coalesce(F.col(f"`last {c}`"), F.col(f"`first {c}`")).alias(c) if c in columns else F.col(c) for c in df.columns])
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("i").alias("x"), F.col(c).cast("double").alias("v")))
    rows = positions(df, by, on, cell)
    rows = carried(rows, by, on, cell, {f"a {c}": ("last", at(c)) for c in columns}, own=True)
    rows = carried(rows, by, on, -cell, {f"b {c}": ("last", at(c)) for c in columns}, own=True)

    def between(c: str) -> Column:
        a, b = F.col(f"`a {c}`"), F.col(f"`b {c}`")
        line = a.v + (b.v - a.v) * (F.col("i") - a.x) / F.when(b.x > a.x, b.x - a.x)
        return F.coalesce(F.col(c), line, a.v, b.v).alias(c)

    return rows.select(*[between(c) if c in columns else F.col(c) for c in df.columns])


def fractional_weights(d: float, threshold: float) -> list[float]:
    """Weights of fractional differencing until they fall below the threshold."""
    out, k = [1.0], 1
    while abs(nxt := -out[-1] * (d - k + 1) / k) >= threshold:
        out.append(nxt)
        k += 1
    return out


def fractional_difference(x: Column, w: WindowSpec, d: float, threshold: float = 1e-3) -> Column:
    """Dot product of the weights with the last values; null until enough rows came. One array for each row, no lags by hand."""
    weights = fractional_weights(d, threshold)
    values = F.reverse(F.collect_list(x).over(last_n(w, len(weights))))
    dot = F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(values) == len(weights), dot)


def equal_spacing(df: DataFrame, by: list[str], on: str) -> DataFrame:
    """(by, steps, even): the distinct distances of each series, even if there is one."""
    rows = df.withColumn("step", F.col(on) - F.lag(on).over(series(by, on))).where("step is not null")
    return rows.groupBy(*by).agg(F.count_distinct("step").alias("steps"), F.median("step").alias("median_step")).withColumn("even", F.col("steps") == 1)


def require_spacing(df: DataFrame, by: list[str], on: str, step: int) -> DataFrame:
    """``df``, failing when it runs if two neighbours of a series do not lie ``step`` apart."""
    apart = F.col(on) - F.lag(on).over(series(by, on))
    checked = F.when(apart != step, F.raise_error(F.concat(F.lit("uneven step at "), F.col(on).cast("string")))).otherwise(F.col(on))
    return df.withColumn(on, checked)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("k = 1").drop("k")


def tail(df: DataFrame, by: list[str], on: str, n: int) -> DataFrame:
    return df.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(on)))).where(F.col("k") <= n).drop("k")
