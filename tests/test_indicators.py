"""Indicators in chunks against the whole series, and recursive families against straight loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import indicators

BARS = 9000


def bars(n, seed=0, symbol="a"):
    rng = np.random.default_rng(seed)
    close = np.exp(np.cumsum(rng.normal(0, 0.01, n))) * 100
    spread = np.abs(rng.normal(0, 0.5, n))
    return pd.DataFrame({
        "symbol": symbol, "bar": np.arange(n) * 900_000, "open": close * np.exp(rng.normal(0, 0.002, n)), "high": close + spread, "low": close - spread * rng.random(n),
        "close": close.round(2), "volume": rng.integers(0, 1000, n).astype(float), "fng": np.repeat(rng.integers(0, 100, n // 96 + 1), 96)[:n].astype(float),
    })


def test_chunks_equal_whole_series(spark):
    d = spark.createDataFrame(pd.concat([bars(BARS), bars(700, 1, "b")]))
    holes = F.when(F.col("bar") % 37 != 5, F.col("close"))
    d = d.withColumn("close", holes)  # some closes are missing
    names = [*indicators.DEFAULT_PLAN, "obv", "aobv", "fng", "fng_diff1", "fng_z7d", "kvos_34_55_13", "kvoh_34_55_13", "pvos", "pvoh", "mfi_14", "stochd_14_3_3", "aobv_sr_1_14_2"]
    whole = indicators.compute(d, names, ["symbol"], "bar", chunk=10**9).orderBy("symbol", "bar").toPandas()
    reach = max(indicators.memory(*indicators.parse(n)) for n in names)
    assert 2 * reach < BARS / 2  # at least three chunks
    cut = indicators.compute(d, names, ["symbol"], "bar", chunk=1).orderBy("symbol", "bar").toPandas()
    for n in names:
        a, b = whole[n].astype(float).to_numpy(), cut[n].astype(float).to_numpy()
        assert np.array_equal(np.isnan(a), np.isnan(b)), n
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9 * np.nanmax(np.abs(a)), equal_nan=True), n


def test_no_window_spans_a_symbol(spark):
    d = spark.createDataFrame(bars(300))
    plan = indicators.compute(d, indicators.DEFAULT_PLAN, ["symbol"], "bar", shift=1)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "+- Window [" in line or ":- Window [" in line]
    assert windows and all("chunk#" in line or "part#" in line for line in windows)


def mean(x, n, alpha):
    """Seeded by the mean of the first n values; missing ones later let the old mean fade."""
    out, y, old = [math.nan] * len(x), None, 1.0
    first = next((i for i, a in enumerate(x) if a == a), len(x))
    for i in range(first + n - 1, len(x)):
        if y is None:
            own = [a for a in x[i - n + 1 : i + 1] if a == a]
            y = sum(own) / len(own)
        else:
            old *= 1 - alpha
            if x[i] == x[i]:
                y, old = (old * y + alpha * x[i]) / (old + alpha), 1.0
        out[i] = y
    return out


def test_recursive_families_equal_loops(spark):
    d = bars(400, 5)
    o, h, lo, c, v = (d[k].tolist() for k in ("open", "high", "low", "close", "volume"))
    n = len(c)
    nan = math.nan
    ema, rma = lambda x, k: mean(x, k, 2 / (k + 1)), lambda x, k: mean(x, k, 1 / k)
    over = lambda f, *xs: [f(*z) if all(a == a for a in z) else nan for z in zip(*xs)]
    ratio = lambda a, b: a / b if b else nan
    diff = lambda x, k=1: [nan] * k + [b - a for a, b in zip(x, x[k:])]
    lag = lambda x, k: [nan] * k + x[:-k]
    tr = [nan] + [max(a - b, abs(a - p), abs(b - p)) for a, b, p in zip(h[1:], lo[1:], c)]
    want = {}
    a = ema(c, 10)
    b = ema(a, 10)
    want["tema_10"] = over(lambda x, y, z: 3 * x - 3 * y + z, a, b, ema(b, 10))
    e1 = ema(over(lambda x, y: x - y, h, lo), 9)
    parts = over(ratio, e1, ema(e1, 9))
    want["massi_9_25"] = [sum(parts[i - 24 : i + 1]) if i >= 24 else nan for i in range(n)]
    for name, x, percent, (f, s, g) in (("macd", c, False, (12, 26, 9)), ("pvo", v, True, (12, 26, 9)), ("kvo", [nan] + [y * np.sign(k) for y, k in zip(v[1:], diff([p + q + r for p, q, r in zip(h, lo, c)])[1:])], False, (34, 55, 13))):
        slow = ema(x, s)
        line = over(lambda p, q: 100 * ratio(p - q, q) if percent else p - q, ema(x, f), slow)  # noqa: B023
        signal = ema(line, g)
        tail = f"_{f}_{s}_{g}"
        want |= {name + tail: line, name + "s" + tail: signal, name + "h" + tail: over(lambda p, q: p - q, line, signal)}
    up, down = diff(h), [-x for x in diff(lo)]
    plus = [nan] + [x if x > y and x > 0 else 0.0 for x, y in zip(up[1:], down[1:])]
    minus = [nan] + [y if y > x and y > 0 else 0.0 for x, y in zip(up[1:], down[1:])]
    atr = rma(tr, 14)
    dmp, dmn = (over(lambda x, t: 100 * ratio(x, t), rma(x, 14), atr) for x in (plus, minus))
    want |= {"dmp_14": dmp, "dmn_14": dmn, "adx_14": rma(over(lambda x, y: ratio(100 * abs(x - y), x + y), dmp, dmn), 14)}
    want["efi_13"] = ema(over(lambda x, y: x * y, diff(c), v), 13)
    want["rwih_14"] = over(lambda x, y, t: (x - y) / (t * 14**0.5), h, lag(lo, 14), atr)
    want["rwil_14"] = over(lambda x, y, t: (x - y) / (t * 14**0.5), lag(h, 14), lo, atr)
    sd = [float(np.std(c[i - 13 : i + 1])) if i >= 13 else nan for i in range(n)]
    change = diff(c)
    rise, fall = ([s if s != s else (s if (k > 0) == up_ and k != 0 else 0.0) for s, k in zip(sd, change)] for up_ in (True, False))
    want["rvi_14"] = over(lambda x, y: 100 * ratio(x, x + y), ema(rise, 14), ema(fall, 14))
    obv = np.cumsum([v[0]] + [y * np.sign(k) for y, k in zip(v[1:], change[1:])]).tolist()
    long_run = lambda f, s, m: over(lambda x, y: float(x > 0 and y != 0), diff(f, m), diff(s, m))
    want["aobv"], want["aobv_lr_1_14_2"] = obv, long_run(ema(obv, 1), ema(obv, 14), 2)
    want["amat_lr_8_21_2"] = long_run(ema(c, 8), ema(c, 21), 2)
    r, alpha = [nan] + [math.log(y / x) for x, y in zip(c, c[1:])], 1 - 0.5 ** (1 / 20)
    m, weights = nan, []
    want["ewm_m_20"], want["ewm_s_20"] = [], []
    for i in range(n):
        if r[i] == r[i]:
            weights = [w * (1 - alpha) for w in weights] + [alpha if weights else 1.0]
            own = r[i - len(weights) + 1 : i + 1]
            m = sum(w * x for w, x in zip(weights, own))
            var = sum(w * (x - m) ** 2 for w, x in zip(weights, own))
            spread = 1 - sum(w * w for w in weights)
        want["ewm_m_20"].append(m)
        want["ewm_s_20"].append(math.sqrt(var / spread) if r[i] == r[i] and spread > 0 else nan)
    want["fng_diff1"] = diff(d.fng.tolist())
    z = d.fng.rolling(672, min_periods=3)
    want["fng_z7d"] = ((d.fng - z.mean()) / z.std().replace(0, nan)).tolist()
    got = indicators.compute(spark.createDataFrame(d), list(want), ["symbol"], "bar").orderBy("bar").toPandas()
    for name, x in want.items():
        np.testing.assert_allclose(got[name].astype(float), x, rtol=1e-8, atol=1e-9, equal_nan=True, err_msg=name)


@pytest.mark.parametrize("name", ["rsi_14", "ewm_s_20", "kvo", "kvoh_34_55_13", "adx", "efi", "macds", "aobv_lr", "fng_z7d", "pvo"])
def test_memory_is_known_for_names_with_and_without_numbers(name):
    assert indicators.memory(*indicators.parse(name)) > 60
