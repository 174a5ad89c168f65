"""Technical indicators by name: ``rsi_14``, ``macd_12_26_9``, ``bbp_16_2.0`` ... over bars (open, high, low, close, volume).

A list of names is a plan. Names are parsed into a family and its numbers, repeats and shared intermediates are computed
once. Families that rolling windows can express are columns over one window; recursive ones (exponential and Wilder
means and what is built on them) are computed together in one grouped call. Cumulative ones are running sums.

Series are cut into chunks of rows, each with as many complete rows before it as its windows reach and its means remember: what lies further back weighs
less than FORGOTTEN, so values equal those of the whole series to a double's precision, and a hot symbol is many tasks. The first chunk starts with the series.
(A mean of a ratio that is undefined for longer than that, as over weeks of equal prices, starts anew after it.) Running sums are added up by chunks.
Means are seeded by the simple mean of the first n values; Wilder means have weight 1/n.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.bartime import day_cycle
from ..functions.numeric import clean, correlation, gated, sample_kurtosis, sample_skew
from .ranks import below, join_on, streamed
from .windows import last_n, slope

NAME = re.compile(r"^([a-z]+(?:_[a-z]+|_z7d|_diff1|1)*?)((?:_\d+(?:\.\d+)?)*)$")


def parse(name: str) -> tuple[str, tuple[float, ...]]:
    """(family, numbers) of an indicator's name."""
    m = NAME.match(name.strip().lower())
    if not m:
        raise ValueError(f"not an indicator name: {name!r}")
    return m[1], tuple(float(x) if "." in x else int(x) for x in m[2].split("_") if x)


def read_plan(lines: Iterable[str]) -> list[str]:
    """Names of a list, in order, without blanks, comments and repeats."""
    return list(dict.fromkeys(x for x in (line.split("#")[0].strip() for line in lines) if x))


# ------------------------------------------------------------- recursive kernels on one series


def ema(x: pd.Series, n: int, wilder: bool = False) -> pd.Series:
    """Exponential mean of the values from the first one on, seeded by the mean of n of them."""
    first = x.first_valid_index()
    if first is None:
        return x * np.nan
    at = x.index.get_loc(first) + n - 1
    if at >= len(x):
        return x * np.nan
    out = x.copy()
    out.iloc[at] = x.iloc[at - n + 1 : at + 1].mean()
    alpha = 1 / n if wilder else 2 / (n + 1)
    out.iloc[at:] = out.iloc[at:].ewm(alpha=alpha, adjust=False).mean()
    out.iloc[:at] = np.nan
    return out


def rma(x: pd.Series, n: int) -> pd.Series:
    return ema(x, n, wilder=True)


def true_range(d: pd.DataFrame) -> pd.Series:
    c = d.close.shift()
    tr = pd.concat([d.high - d.low, (d.high - c).abs(), (d.low - c).abs()], axis=1).max(axis=1)
    tr.iloc[:1] = np.nan
    return tr


def _directional(d: pd.DataFrame, n: int) -> tuple[pd.Series, pd.Series, pd.Series]:
    up, down = d.high.diff(), -d.low.diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    plus.iloc[:1] = minus.iloc[:1] = np.nan
    atr = rma(true_range(d), n).replace(0, np.nan)
    dmp, dmn = 100 * rma(plus, n) / atr, 100 * rma(minus, n) / atr
    total = (dmp + dmn).replace(0, np.nan)
    return rma(100 * (dmp - dmn).abs() / total, n), dmp, dmn


def _long_run(fast: pd.Series, slow: pd.Series, n: int, rising: bool) -> pd.Series:
    df, ds = fast.diff(n), slow.diff(n)
    hit = ((df > 0) & (ds < 0) | (df > 0) & (ds > 0)) if rising else ((df < 0) & (ds > 0) | (df < 0) & (ds < 0))
    return hit.astype(float).where(df.notna() & ds.notna())


def _volume_flow(d: pd.DataFrame) -> pd.Series:
    return d.volume * np.sign((d.high + d.low + d.close).diff())


def _obv(d: pd.DataFrame) -> pd.Series:
    return (np.sign(d.close.diff()).fillna(1.0) * d.volume).cumsum()


def _oscillator(x: pd.Series, f: int, s: int, g: int, percent: bool) -> tuple[pd.Series, pd.Series, pd.Series]:
    slow = ema(x, s)
    line = ema(x, f) - slow
    line = 100 * line / slow.replace(0, np.nan) if percent else line
    signal = ema(line, g)
    return line, signal, line - signal


def _rvi(d: pd.DataFrame, n: int) -> pd.Series:
    sd = d.close.rolling(n).std(ddof=0)
    change = d.close.diff()
    up, down = ema(sd.where(change > 0, 0.0).where(sd.notna()), n), ema(sd.where(change < 0, 0.0).where(sd.notna()), n)
    return 100 * up / (up + down).replace(0, np.nan)


def _rwi(d: pd.DataFrame, n: int, high: bool) -> pd.Series:
    base = (rma(true_range(d), n) * n**0.5).replace(0, np.nan)
    return ((d.high - d.low.shift(n)) if high else (d.high.shift(n) - d.low)) / base


def _massi(d: pd.DataFrame, f: int, s: int) -> pd.Series:
    one = ema(d.high - d.low, f)
    return (one / ema(one, f).replace(0, np.nan)).rolling(s).sum()


def _rsi(c: pd.Series, n: int) -> pd.Series:
    change = c.diff()
    up, down = rma(change.clip(lower=0), n), rma((-change).clip(lower=0), n)
    return 100 * up / (up + down).replace(0, np.nan)


def _cmo(c: pd.Series, n: int) -> pd.Series:
    change = c.diff()
    up, down = rma(change.clip(lower=0), n), rma((-change).clip(lower=0), n)
    return 100 * (up - down) / (up + down).replace(0, np.nan)


def _tema(c: pd.Series, n: int) -> pd.Series:
    a = ema(c, n)
    b = ema(a, n)
    return 3 * a - 3 * b + ema(b, n)


def _ewm(d: pd.DataFrame, half_life: float, std: bool) -> pd.Series:
    r = np.log(d.close).diff()
    e = r.ewm(halflife=half_life, adjust=False)
    return e.std() if std else e.mean()


RECURSIVE = {
    "ema": lambda d, n: ema(d.close, n), "tema": lambda d, n: _tema(d.close, n), "rsi": lambda d, n: _rsi(d.close, n), "cmo": lambda d, n: _cmo(d.close, n),
    "atr": lambda d, n: rma(true_range(d), n), "atrp": lambda d, n: rma(true_range(d), n) / d.close.abs().replace(0, np.nan),
    "massi": _massi, "rwih": lambda d, n: _rwi(d, n, True), "rwil": lambda d, n: _rwi(d, n, False), "rwi": lambda d, n: _rwi(d, n, False),
    "efi": lambda d, n=13: ema(d.close.diff() * d.volume, n),
    "macd": lambda d, f=12, s=26, g=9: _oscillator(d.close, f, s, g, False)[0], "macds": lambda d, f=12, s=26, g=9: _oscillator(d.close, f, s, g, False)[1], "macdh": lambda d, f=12, s=26, g=9: _oscillator(d.close, f, s, g, False)[2],
    "pvo": lambda d, f=12, s=26, g=9: _oscillator(d.volume, f, s, g, True)[0], "pvos": lambda d, f=12, s=26, g=9: _oscillator(d.volume, f, s, g, True)[1], "pvoh": lambda d, f=12, s=26, g=9: _oscillator(d.volume, f, s, g, True)[2],
    "kvo": lambda d, f=34, s=55, g=13: _oscillator(_volume_flow(d), f, s, g, False)[0], "kvos": lambda d, f=34, s=55, g=13: _oscillator(_volume_flow(d), f, s, g, False)[1], "kvoh": lambda d, f=34, s=55, g=13: _oscillator(_volume_flow(d), f, s, g, False)[2],
    "adx": lambda d, n=14: _directional(d, n)[0], "dmp": lambda d, n=14: _directional(d, n)[1], "dmn": lambda d, n=14: _directional(d, n)[2],
    "aobv": lambda d, *a: _obv(d), "aobv_lr": lambda d, f=1, s=14, m=2: _long_run(ema(_obv(d), f), ema(_obv(d), s), m, True), "aobv_sr": lambda d, f=1, s=14, m=2: _long_run(ema(_obv(d), f), ema(_obv(d), s), m, False),
    "rvi": _rvi, "ewm_m": lambda d, h: _ewm(d, h, False), "ewm_s": lambda d, h: _ewm(d, h, True),
    "amat_lr": lambda d, f, s, m: _long_run(ema(d.close, f), ema(d.close, s), m, True),
}
#: Sums from the first bar on, by what each bar adds. The differences that aobv_lr and aobv_sr look at do not depend on where the sum began.
CUMULATIVE = {"pvt": "pvt", "obv": "obv", "aobv": "obv"}
#: Rows of a chunk at least, and the weight at which a mean has forgotten.
CHUNK, FORGOTTEN = 4096, 1e-17


def memory(family: str, numbers: tuple) -> int:
    """Bars that an indicator needs before its own: a bound of its windows' lengths, and of each mean in turn the bars after which its start is forgotten."""
    plain = 3 * int(sum(numbers)) + (672 if family == "fng_z7d" else 64)
    if family not in RECURSIVE or family in CUMULATIVE:
        return plain
    a = list(numbers) or {"efi": [13], "kvo": [34, 55, 13], "adx": [14], "dmp": [14], "dmn": [14]}.get(family.rstrip("sh") if family.startswith("kvo") else family, [1, 14, 2] if family.startswith("aobv") else [12, 26, 9])
    fade = lambda alpha: math.ceil(math.log(FORGOTTEN) / math.log(1 - alpha)) if alpha < 1 else 1
    mean, wilder = (lambda n: fade(2 / (n + 1))), (lambda n: fade(1 / n))
    if family in ("rsi", "cmo", "atr", "atrp", "rwi", "rwih", "rwil", "dmp", "dmn"):
        return plain + wilder(a[0])
    if family == "adx":
        return plain + 2 * wilder(a[0])
    if family in ("ewm_m", "ewm_s"):
        return plain + fade(1 - 0.5 ** (1 / a[0]))
    times = {"tema": 3, "massi": 2}.get(family, 1)
    signal = mean(a[2]) if len(a) > 2 and family[:3] in ("mac", "pvo", "kvo") else 0
    return plain + times * mean(max(a[:2])) + signal


# ------------------------------------------------------------- families over rolling windows


class Rolling:
    """Columns of one plan. Intermediates that other windows need are made once, each level of them in one projection, so that the
    plan is analysed a few times and not once for each column."""

    def __init__(self, df: DataFrame, by: list[str], on: str):
        self.df, self.w, self.on = df, W.partitionBy(*by).orderBy(on), on
        self.names: dict[str, str] = {}
        self.levels: list[dict[str, Column]] = []

    def step(self, key: str, value: Column, level: int = 0) -> Column:
        """An intermediate by name; ``level`` is one more than that of the intermediates it is made of."""
        if key not in self.names:
            self.names[key] = f"step_{len(self.names)}"
            while len(self.levels) <= level:
                self.levels.append({})
            self.levels[level][self.names[key]] = value
        return F.col(self.names[key])

    def frame(self) -> DataFrame:
        """The rows with all intermediates."""
        for columns in self.levels:
            self.df = self.df.withColumns(columns)
        return self.df

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.w)

    def over(self, f, x: Column, n: int, least: int | None = None) -> Column:
        frame = last_n(self.w, n)
        return gated(f(x).over(frame), x, frame, least or n)

    def added(self, family: str) -> Column:
        """What a bar adds to a running sum."""
        c, v = F.col("close"), F.col("volume")
        if family == "pvt":
            return self.step("pvt1", 100 * (c / F.when(self.lag(c) != 0, self.lag(c)) - 1) * v)
        return self.step("obv1", F.coalesce(F.signum(c - self.lag(c)), F.lit(1.0)) * v)

    def build(self, family: str, a: tuple) -> Column:
        o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
        n = a[0] if a else 0
        lag, over, step = self.lag, self.over, self.step
        guard = lambda x: F.when(x != 0, x)
        tr = lambda: step("tr", F.when(lag(c).isNotNull(), F.greatest(h - l, F.abs(h - lag(c)), F.abs(l - lag(c)))))
        change = lambda: step("change", c - lag(c))
        if family in ("open", "high", "low", "close", "volume", "fng"):
            return F.col(family)
        if family == "fng_diff1":
            return F.col("fng") - lag(F.col("fng"))
        if family == "fng_z7d":
            x = F.col("fng")
            return (x - over(F.avg, x, 672, 3)) / guard(over(F.stddev_samp, x, 672, 3))
        if family == "ttm_trend":
            mid = step("hl2", (h + l) / 2)
            return F.when(c > over(F.avg, mid, n), 1).when(over(F.avg, mid, n).isNotNull(), -1)
        if family == "slope":
            return (c - lag(c, n)) / n
        if family == "sma":
            return over(F.avg, c, n)
        if family == "dpo":
            return c - lag(step(f"sma{n}", over(F.avg, c, n)), n // 2 + 1)
        if family == "mom":
            return c - lag(c, n)
        if family == "roc":
            return 100 * (c / guard(lag(c, n)) - 1)
        if family == "cti":  # correlation with the row's number: the slope in units of both deviations
            return slope(c, self.w, n) * ((n * n - 1) / 12) ** 0.5 / guard(over(F.stddev_pop, c, n))
        if family == "cfo":
            b = slope(c, self.w, n)
            return 100 * (c - (over(F.avg, c, n) + b * (n - 1) / 2)) / guard(c)
        if family in ("skew", "kurtosis"):
            # moments from the frame's values: Spark's own moment aggregates update too much at each row of a sliding frame
            values, mean = step(f"values{n}", F.collect_list(c).over(last_n(self.w, n))), step(f"mean{n}", over(F.avg, c, n))
            moment = lambda k: step(f"moment{n}_{k}", F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) ** k) / n, 1)
            m2, count = moment(2), F.when(F.size(values) == n, F.lit(n))
            if family == "skew":
                return sample_skew(count, moment(3) / F.when(m2 > 0, F.pow(m2, 1.5)))
            return sample_kurtosis(count, moment(4) / F.when(m2 > 0, m2 * m2) - 3)
        if family == "entropy":
            p = step(f"p{n}", c / guard(over(F.sum, c, n)))
            return over(F.sum, step(f"plogp{n}", -p * F.log2(F.when(p > 0, p)), 1), n)
        if family == "decay":
            return F.greatest(c, lag(c) - 1.0 / n, F.lit(0.0))
        if family == "decreasing":
            return F.when(c - lag(c, n) < 0, 1).otherwise(0)
        if family == "bias":
            return c / guard(over(F.avg, c, n)) - 1
        if family == "zscore":
            return (c - over(F.avg, c, n)) / guard(over(F.stddev_samp, c, n))
        if family == "willr":
            top, low = over(F.max, h, n), over(F.min, l, n)
            return -100 * (top - c) / guard(top - low)
        if family == "cci":
            tp = step("tp", (h + l + c) / 3)
            mean = over(F.avg, tp, n)
            mad = F.aggregate(F.transform(F.collect_list(tp).over(last_n(self.w, n)), lambda x: F.abs(x - mean)), F.lit(0.0), lambda s, x: s + x) / n
            return (tp - mean) / guard(0.015 * mad)
        if family == "uo":
            f, m, s = a
            low, top = step("uolow", F.least(l, lag(c))), step("uotop", F.greatest(h, lag(c)))
            bp, rng = step("bp", F.when(lag(c).isNotNull(), c - low), 1), step("rng", F.when(lag(c).isNotNull(), top - low), 1)
            part = lambda k: over(F.sum, bp, k) / guard(over(F.sum, rng, k))
            return 100 * (4 * part(f) + 2 * part(m) + part(s)) / 7
        if family == "truerange":
            return tr()
        if family == "bbp":
            mean, sd = over(F.avg, c, n), over(F.stddev_samp, c, n)
            return (c - (mean - a[1] * sd)) / guard(2 * a[1] * sd)
        if family == "vhf":
            return F.abs(over(F.max, c, n) - over(F.min, c, n)) / guard(over(F.sum, step("abschange", F.abs(c - lag(c))), n))
        if family == "pvr":
            up, more = change() >= 0, v - lag(v) >= 0
            return F.when(up & more, 1).when(up & ~more, 2).when(~up & more, 3).when(~up & ~more, 4)
        if family == "eom":
            n = n or 14
            mid = step("hl2", (h + l) / 2)
            return over(F.avg, step("eom1", (mid - lag(mid)) * (h - l) * 1e8 / guard(v), 1), n)
        if family in CUMULATIVE:
            here = F.sum(F.when(F.col("own"), self.added(CUMULATIVE[family]))).over(self.w.rowsBetween(W.unboundedPreceding, 0))
            return F.col(f"`before {CUMULATIVE[family]}`") + here
        if family == "bop":
            return (c - o) / guard(h - l)
        if family == "logret":
            return F.log(c / guard(lag(c, n)))
        if family == "pctret":
            return c / guard(lag(c, n)) - 1
        if family in ("stochk", "stochd", "kdj"):
            k, d, s = a
            fast = step(f"fast{k}", 100 * (c - over(F.min, l, k)) / guard(over(F.max, h, k) - over(F.min, l, k)))
            slow = step(f"slow{k}_{s}", over(F.avg, fast, s), 1)
            signal = over(F.avg, slow, d)
            return {"stochk": slow, "stochd": signal, "kdj": 3 * slow - 2 * signal}[family]
        if family == "mfi":
            tp = step("tp", (h + l + c) / 3)
            up, down = step("mfup", F.when(tp > lag(tp), tp * v).otherwise(F.when(lag(tp).isNotNull(), 0.0)), 1), step("mfdn", F.when(tp < lag(tp), tp * v).otherwise(F.when(lag(tp).isNotNull(), 0.0)), 1)
            return 100 * over(F.sum, up, n) / guard(over(F.sum, up, n) + over(F.sum, down, n))
        if family == "hl_range":
            return over(F.avg, step("hlr", (h - l) / guard(F.abs(c))), n, max(1, n // 2))
        if family == "dir_strength":
            return (c - o) / F.greatest(h - l, F.lit(1e-9))
        if family == "pxv_lr_vchg":
            return F.log(c / guard(lag(c))) * F.greatest(F.least(v / guard(lag(v)) - 1, F.lit(1.0)), F.lit(-1.0))
        if family == "dirxvol":
            return (c - o) / F.greatest(h - l, F.lit(1e-9)) * v
        if family in ("tod_sin", "tod_cos", "dow_sin", "dow_cos"):
            return dict(zip(("tod_sin", "tod_cos", "dow_sin", "dow_cos"), day_cycle(F.col(self.on))))[family]
        raise ValueError(f"unknown indicator family {family!r}")


def chunks(rows: DataFrame, by: list[str], on: str, size: int, reach: int) -> DataFrame:
    """rows with the chunk they are worked on in, and ``own`` for the one copy to keep. A chunk has ``size`` complete rows (without nulls), and ``reach`` of those before it."""
    whole = F.lit(1)
    for c in rows.columns:
        if c not in (*by, on):
            whole = whole * F.col(f"`{c}`").isNotNull().cast("int")
    placed = below(rows.withColumn("whole", whole), by, on, ["whole"])
    at, home = F.col("`below whole`"), F.floor(F.col("`below whole`") / size)
    again = F.explode(F.when(at % size >= size - reach, F.array(home, home + 1)).otherwise(F.array(home)))
    return placed.withColumn("chunk", again).withColumn("own", F.col("chunk") == home).drop("whole", "below whole")


def known_names(names: Iterable[str], columns: Iterable[str] = ("open", "high", "low", "close", "volume", "fng")) -> tuple[list[str], list[str]]:
    """(names that are indicators of these columns, the others), in order, without repeats."""
    there, good, skipped = set(columns), [], []
    for name in read_plan(names):
        family = NAME.match(name.strip().lower())
        ok = family is not None and family[1] in FAMILIES and (family[1].split("_")[0] != "fng" or "fng" in there) and (family[1] not in there or not family[2])
        (good if ok else skipped).append(name)
    return good, skipped


def compute(bars: DataFrame, names: Iterable[str], by: list[str], on: str, shift: int = 0, chunk: int = CHUNK, strict: bool = True) -> DataFrame:
    """Unknown names raise an error, or are left out if not ``strict`` (``known_names`` tells which). ``bars``' keys and the named indicators, in order; missing numbers are null. ``shift`` delays all of them by so many bars. ``on`` is unique in a series;
    chunks have ``chunk`` rows at least, more if an indicator's memory is long."""
    plan, unknown = known_names(names, bars.columns)
    if strict and unknown:
        raise ValueError(f"unknown indicators: {unknown}")
    parsed = {name: parse(name) for name in plan}
    base = [c for c in ("open", "high", "low", "close", "volume", "fng") if c in bars.columns]
    reach = max([memory(*p) for p in parsed.values()], default=0) + shift
    rows = chunks(bars.select(*by, on, *[clean(F.col(c)).alias(c) for c in base]), by, on, max(chunk, 2 * reach), reach)
    keys = [*by, "chunk"]
    sums = sorted({CUMULATIVE[f] for f, _ in parsed.values() if f in CUMULATIVE})
    if sums:
        steps = Rolling(rows, keys, on)
        added = {s: steps.added(s) for s in sums}
        totals = steps.frame().where("own").groupBy(*keys).agg(*[F.sum(c).alias(s) for s, c in added.items()])
        before = W.partitionBy(*by).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)  # a row for each chunk
        rows = join_on(rows, totals.select(*keys, *[F.coalesce(F.sum(s).over(before), F.lit(0.0)).alias(f"before {s}") for s in sums]), keys, "left").fillna(0.0, [f"before {s}" for s in sums])
    recursive = {name: p for name, p in parsed.items() if p[0] in RECURSIVE and p[0] not in CUMULATIVE}
    if recursive:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", `{n}` double" for n in recursive)

        def run(table: pa.Table) -> list:
            pdf = table.select(base).to_pandas().astype(float)
            made = [RECURSIVE[family](pdf, *numbers) for family, numbers in recursive.values()]
            return [*table.columns, *[pa.array(m.to_numpy(float), from_pandas=True) for m in made]]

        rows = streamed(rows, keys, [on], schema, run)
    rolling = Rolling(rows, keys, on)
    built = {name: F.col(f"`{name}`") if name in recursive else rolling.build(*parsed[name]) for name in plan}
    out = rolling.frame().select(*keys, on, "own", *[clean(c).alias(name) for name, c in built.items()])
    if shift:
        w = W.partitionBy(*keys).orderBy(on)
        out = out.select(*keys, on, "own", *[F.lag(F.col(f"`{n}`"), shift).over(w).alias(n) for n in plan])
    return out.where("own").drop("own", "chunk")


#: Families over rolling windows (``Rolling.build``).
ROLLING = set("""open high low close volume fng fng_diff1 fng_z7d ttm_trend slope sma dpo mom roc cti cfo skew kurtosis entropy decay decreasing bias zscore willr cci uo truerange bbp vhf pvr eom pvt obv bop
logret pctret stochk stochd kdj mfi hl_range dir_strength pxv_lr_vchg dirxvol tod_sin tod_cos dow_sin dow_cos""".split())
FAMILIES = ROLLING | set(RECURSIVE)

DEFAULT_PLAN = (
    "ttm_trend_6", "slope_5", "sma_10", "ema_12", "tema_10", "dpo_20", "rsi_14", "mom_10", "roc_10", "cti_12", "cfo_9", "skew_30", "kurtosis_30", "entropy_10", "decay_5", "decreasing_3",
    "cmo_14", "bias_26", "zscore_30", "willr_14", "cci_14", "uo_7_14_28", "atr_14", "atrp_14", "truerange", "massi_9_25", "bbp_16_2.0", "vhf_28", "rwih_14", "rwil_14", "pvr", "efi_13", "eom_14", "pvt",
    "bop", "logret_1", "pctret_1", "macd_12_26_9", "macds_12_26_9", "macdh_12_26_9", "stochk_14_3_3", "stochd_14_3_3", "adx_14", "dmp_14", "dmn_14", "pvo_12_26_9", "kvo_34_55_13", "aobv_lr_1_14_2",
    "rvi_14", "kdj_9_3_3", "hl_range_14", "ewm_m_20", "ewm_s_20", "dir_strength", "pxv_lr_vchg", "dirxvol", "tod_sin", "tod_cos", "dow_sin", "dow_cos", "amat_lr_8_21_2",
)
