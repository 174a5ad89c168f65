"""Queries over indicators, labels, folds, statistics and alpha expressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import alpha as A
from ..operators import folds as V
from ..operators import indicators as I
from ..operators import labels as L
from ..operators import stats as S
from ..operators.windows import fractional_weights
from .adapters import BARS_SQL, HOUR, TAPE_SQL, bars, rounded, sql, table, tape

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


# ---------------------------------------------------------------- indicators

ROLLING_PLAN = ("ttm_trend_6", "slope_5", "sma_10", "mom_10", "roc_10", "decay_5", "decreasing_3", "bias_26", "zscore_30", "willr_14", "bbp_16_2.0", "vhf_28", "bop", "logret_1", "pctret_1", "truerange", "hl_range_14", "dir_strength", "pvr", "stochk_14_3_3", "obv", "dpo_20", "uo_7_14_28")
_N = {n: f"(PARTITION BY symbol ORDER BY bar ROWS {n - 1} PRECEDING)" for n in (3, 6, 7, 10, 14, 16, 20, 26, 28, 30)}
INDICATOR_CTES = BARS_SQL + """,
i1 AS (SELECT *, lag(close) OVER w AS pc, lag(volume) OVER w AS pv, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
i2 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS truerange, abs(close - pc) AS ac,
  CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END AS bp, CASE WHEN pc IS NOT NULL THEN greatest(high, pc) - least(low, pc) END AS rg,
  CASE WHEN count(*) OVER w14 >= 14 THEN 100 * (close - min(low) OVER w14) / nullif(max(high) OVER w14 - min(low) OVER w14, 0) END AS fast,
  CASE WHEN count(*) OVER w20 >= 20 THEN avg(close) OVER w20 END AS sma20 FROM i1
  WINDOW w14 AS """ + _N[14] + ", w20 AS " + _N[20] + ")"
INDICATOR_BODY = """SELECT symbol, bar, CASE WHEN i >= 6 THEN CASE WHEN close > avg((high + low) / 2) OVER w6 THEN 1 ELSE -1 END END::DOUBLE AS ttm_trend_6, (close - lag(close, 5) OVER w) / 5 AS slope_5,
 CASE WHEN i >= 10 THEN avg(close) OVER w10 END AS sma_10, close - lag(close, 10) OVER w AS mom_10, 100 * (close / nullif(lag(close, 10) OVER w, 0) - 1) AS roc_10,
 greatest(close, pc - 0.2, 0) AS decay_5, CASE WHEN close - lag(close, 3) OVER w < 0 THEN 1.0 ELSE 0.0 END AS decreasing_3, CASE WHEN i >= 26 THEN close / nullif(avg(close) OVER w26, 0) - 1 END AS bias_26,
 CASE WHEN i >= 30 THEN (close - avg(close) OVER w30) / nullif(stddev_samp(close) OVER w30, 0) END AS zscore_30, CASE WHEN i >= 14 THEN -100 * (max(high) OVER w14 - close) / nullif(max(high) OVER w14 - min(low) OVER w14, 0) END AS willr_14,
 CASE WHEN i >= 16 THEN (close - (avg(close) OVER w16 - 2 * stddev_samp(close) OVER w16)) / nullif(4 * stddev_samp(close) OVER w16, 0) END AS "bbp_16_2.0",
 CASE WHEN i >= 29 THEN abs(max(close) OVER w28 - min(close) OVER w28) / nullif(sum(ac) OVER w28, 0) END AS vhf_28, (close - open) / nullif(high - low, 0) AS bop, ln(close / nullif(pc, 0)) AS logret_1, close / nullif(pc, 0) - 1 AS pctret_1, truerange,
 CASE WHEN i >= 7 THEN avg((high - low) / nullif(abs(close), 0)) OVER w14 END AS hl_range_14, (close - open) / greatest(high - low, 1e-9) AS dir_strength,
 CASE WHEN close - pc >= 0 AND volume - pv >= 0 THEN 1 WHEN close - pc >= 0 AND volume - pv < 0 THEN 2 WHEN close - pc < 0 AND volume - pv >= 0 THEN 3 WHEN close - pc < 0 AND volume - pv < 0 THEN 4 END::DOUBLE AS pvr,
 CASE WHEN count(fast) OVER w3 >= 3 THEN avg(fast) OVER w3 END AS stochk_14_3_3,
 sum(coalesce(sign(close - pc), 1) * volume) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS obv, close - lag(sma20, 11) OVER w AS dpo_20,
 CASE WHEN i >= 29 THEN 100 * (4 * sum(bp) OVER w7 / nullif(sum(rg) OVER w7, 0) + 2 * sum(bp) OVER w14 / nullif(sum(rg) OVER w14, 0) + sum(bp) OVER w28 / nullif(sum(rg) OVER w28, 0)) / 7 END AS uo_7_14_28
FROM i2 WINDOW w AS (PARTITION BY symbol ORDER BY bar), """ + ", ".join(f"w{n} AS {d}" for n, d in _N.items())


@query("indicators_rolling", sql(INDICATOR_CTES, INDICATOR_BODY, "symbol bar", "ttm_trend_6 slope_5 sma_10 mom_10 roc_10 decay_5 decreasing_3 bias_26 zscore_30 willr_14 vhf_28 bop logret_1 pctret_1 truerange hl_range_14 dir_strength pvr stochk_14_3_3 obv dpo_20 uo_7_14_28").replace(" FROM (\nSELECT symbol, bar, CASE WHEN i >= 6", ', round("bbp_16_2.0", 6) + 0.0 AS "bbp_16_2.0" FROM (\nSELECT symbol, bar, CASE WHEN i >= 6'))
def indicators_rolling(spark, sf_dir):
    return rounded(I.compute(bars(spark, sf_dir), ROLLING_PLAN, ["symbol"], "bar"))


EMA_SQL = f"""WITH RECURSIVE {BARS_SQL},
n AS (SELECT symbol, bar, close, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS i, avg(close) OVER (PARTITION BY symbol ORDER BY bar ROWS 11 PRECEDING) AS seed FROM bars),
e AS (SELECT symbol, bar, i, seed AS v FROM n WHERE i = 12 UNION ALL SELECT n.symbol, n.bar, n.i, n.close * 2 / 13 + e.v * 11 / 13 FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
SELECT n.symbol, n.bar, round(e.v, 6) + 0.0 AS ema_12 FROM n LEFT JOIN e ON n.symbol = e.symbol AND n.i = e.i"""


@query("indicator_ema", EMA_SQL)
def indicator_ema(spark, sf_dir):
    return rounded(I.compute(bars(spark, sf_dir), ["ema_12"], ["symbol"], "bar"))


@query("indicators_all")
def indicators_all(spark, sf_dir):
    """The whole default plan, recursive families included (checked against straight loops in the tests)."""
    return rounded(I.compute(bars(spark, sf_dir), I.DEFAULT_PLAN, ["symbol"], "bar", shift=1))


_FRAMES = "WINDOW w AS (PARTITION BY symbol ORDER BY bar), " + ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY bar ROWS {n - 1} PRECEDING)" for n in (3, 9, 10, 12, 14, 30))
SHAPE_PLAN = ("cti_12", "cfo_9", "skew_30", "kurtosis_30", "entropy_10", "cci_14", "eom_14", "mfi_14", "stochd_14_3_3", "kdj_9_3_3", "pvt", "pxv_lr_vchg", "dirxvol")
SHAPE_CTES = BARS_SQL + f""",
j1 AS (SELECT *, row_number() OVER w AS i, lag(close) OVER w AS pc, lag(volume) OVER w AS pv, (high + low + close) / 3 AS tp, (high + low) / 2 AS mid, CASE WHEN count(*) OVER w10 = 10 THEN close / nullif(sum(close) OVER w10, 0) END AS p10,
  CASE WHEN count(*) OVER w14 = 14 THEN 100 * (close - min(low) OVER w14) / nullif(max(high) OVER w14 - min(low) OVER w14, 0) END AS f14, CASE WHEN count(*) OVER w9 = 9 THEN 100 * (close - min(low) OVER w9) / nullif(max(high) OVER w9 - min(low) OVER w9, 0) END AS f9 FROM bars {_FRAMES}),
j2 AS (SELECT *, CASE WHEN p10 > 0 THEN -p10 * log2(p10) END AS pl, lag(tp) OVER w AS ptp, lag(mid) OVER w AS pmid, CASE WHEN count(f14) OVER w3 = 3 THEN avg(f14) OVER w3 END AS s14, CASE WHEN count(f9) OVER w3 = 3 THEN avg(f9) OVER w3 END AS s9, list(tp) OVER w14 AS tps, avg(tp) OVER w14 AS tpm FROM j1 {_FRAMES}),
j3 AS (SELECT *, CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp > ptp THEN tp * volume ELSE 0 END END AS up, CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp < ptp THEN tp * volume ELSE 0 END END AS dn, (mid - pmid) * (high - low) * 1e8 / nullif(volume, 0) AS e1, CASE WHEN count(s14) OVER w3 = 3 THEN avg(s14) OVER w3 END AS d14, CASE WHEN count(s9) OVER w3 = 3 THEN avg(s9) OVER w3 END AS d9 FROM j2 {_FRAMES})"""


@query("indicators_shape", sql(SHAPE_CTES, f"""SELECT symbol, bar, CASE WHEN i >= 12 AND stddev_pop(close) OVER w12 > 0 THEN corr(close, i) OVER w12 END AS cti_12, CASE WHEN i >= 9 THEN 100 * (close - (avg(close) OVER w9 + 4 * regr_slope(close, i) OVER w9)) / nullif(close, 0) END AS cfo_9,
 CASE WHEN i >= 30 THEN skewness(close) OVER w30 END AS skew_30, CASE WHEN i >= 30 THEN kurtosis(close) OVER w30 END AS kurtosis_30, CASE WHEN count(pl) OVER w10 = 10 THEN sum(pl) OVER w10 END AS entropy_10,
 CASE WHEN i >= 14 THEN (tp - tpm) / nullif(0.015 * list_avg([abs(x - tpm) FOR x IN tps]), 0) END AS cci_14, CASE WHEN count(e1) OVER w14 = 14 THEN avg(e1) OVER w14 END / 1e8 AS eom_14, CASE WHEN count(up) OVER w14 = 14 THEN 100 * sum(up) OVER w14 / nullif(sum(up) OVER w14 + sum(dn) OVER w14, 0) END AS mfi_14,
 d14 AS stochd_14_3_3, 3 * s9 - 2 * d9 AS kdj_9_3_3, sum(100 * (close / nullif(pc, 0) - 1) * volume) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) / 1e6 AS pvt,
 CASE WHEN close / nullif(pc, 0) > 0 THEN ln(CASE WHEN close / nullif(pc, 0) > 0 THEN close / pc END) * greatest(least(volume / nullif(pv, 0) - 1, 1), -1) END AS pxv_lr_vchg, (close - open) / greatest(high - low, 1e-9) * volume AS dirxvol FROM j3 {_FRAMES}""", "symbol bar", " ".join(SHAPE_PLAN)))
def indicators_shape(spark, sf_dir):
    out = I.compute(bars(spark, sf_dir), SHAPE_PLAN, ["symbol"], "bar")
    return rounded(out.withColumns({"eom_14": F.col("eom_14") / 1e8, "pvt": F.col("pvt") / 1e6}))  # large values in other units, as digits after the point are compared


# Wilder means, seeded by the mean of the first 14 values (rows 2-15): the weights of all later values by a self-join
WILDER_CTES = BARS_SQL + """,
g1 AS (SELECT *, row_number() OVER w AS i, close - lag(close) OVER w AS ch, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
g2 AS (SELECT symbol, avg(greatest(ch, 0)) AS u0, avg(greatest(-ch, 0)) AS d0, avg(tr) AS t0 FROM g1 WHERE i BETWEEN 2 AND 15 GROUP BY symbol),
g3 AS (SELECT a.symbol, a.i, sum(CASE WHEN b.i > 15 THEN pow(13 / 14.0, a.i - b.i) / 14 * greatest(b.ch, 0) ELSE 0 END) AS u, sum(CASE WHEN b.i > 15 THEN pow(13 / 14.0, a.i - b.i) / 14 * greatest(-b.ch, 0) ELSE 0 END) AS d, sum(CASE WHEN b.i > 15 THEN pow(13 / 14.0, a.i - b.i) / 14 * b.tr ELSE 0 END) AS t
 FROM g1 a JOIN g1 b ON a.symbol = b.symbol AND b.i <= a.i AND b.i >= 15 WHERE a.i >= 15 GROUP BY ALL),
g4 AS (SELECT symbol, i, u + pow(13 / 14.0, i - 15) * u0 AS u, d + pow(13 / 14.0, i - 15) * d0 AS d, t + pow(13 / 14.0, i - 15) * t0 AS t FROM g3 JOIN g2 USING (symbol))"""


@query("indicators_wilder", sql(WILDER_CTES, "SELECT symbol, bar, 100 * u / nullif(u + d, 0) AS rsi_14, 100 * (u - d) / nullif(u + d, 0) AS cmo_14, t AS atr_14, t / nullif(abs(close), 0) AS atrp_14 FROM g1 LEFT JOIN g4 USING (symbol, i)", "symbol bar", "rsi_14 cmo_14 atr_14 atrp_14"))
def indicators_wilder(spark, sf_dir):
    return rounded(I.compute(bars(spark, sf_dir), ["rsi_14", "cmo_14", "atr_14", "atrp_14"], ["symbol"], "bar"))


# ---------------------------------------------------------------- labels


@query("label_fixed_horizon", sql(BARS_SQL, "SELECT symbol, bar, ln(lead(close, 4) OVER w / close) AS y_reg, CASE WHEN row_number() OVER w = 1 THEN 1 WHEN ln(lead(close, 4) OVER w / close) > 0.001 THEN 2 WHEN ln(lead(close, 4) OVER w / close) < -0.001 THEN 0 ELSE 1 END AS y_cls FROM bars WHERE close > 0 WINDOW w AS (PARTITION BY symbol ORDER BY bar)", "symbol bar y_cls", "y_reg"))
def label_fixed_horizon(spark, sf_dir):
    return rounded(L.fixed_horizon(bars(spark, sf_dir).where("close > 0"), ["symbol"], "bar", 4, bps=10.0).select("symbol", "bar", "y_reg", "y_cls"))


_WEIGHTS = fractional_weights(0.4, 0.02)


@query("label_cost_fractional", sql(BARS_SQL + f", l AS (SELECT symbol, bar, ln(close) AS x FROM bars WHERE close > 0), d AS (SELECT *, {' + '.join(f'({v!r}) * lag(x, {k}) OVER w' for k, v in enumerate(_WEIGHTS))} AS f FROM l WINDOW w AS (PARTITION BY symbol ORDER BY bar))", """SELECT symbol, bar, lead(f, 4) OVER w - f AS y_reg,
 CASE WHEN row_number() OVER w = 1 THEN 1 WHEN lead(x, 4) OVER w - x > 0.3 THEN 2 WHEN lead(x, 4) OVER w - x < -0.3 THEN 0 ELSE 1 END AS y_cls FROM d WINDOW w AS (PARTITION BY symbol ORDER BY bar)""", "symbol bar y_cls", "y_reg"))
def label_cost_fractional(spark, sf_dir):
    """Classes beyond a cost of 3,000 basis points; the target is the move of the fractionally differenced log price."""
    return rounded(L.fixed_horizon(bars(spark, sf_dir).where("close > 0"), ["symbol"], "bar", 4, "cost", cost_bps=3000.0, fractional=(0.4, 0.02)).select("symbol", "bar", "y_reg", "y_cls"))


@query("label_quantile", sql(BARS_SQL, """SELECT symbol, bar, CASE WHEN y > s THEN 2 WHEN y < -s THEN 0 ELSE 1 END AS y_cls FROM (SELECT symbol, bar, y, CASE WHEN count(p) OVER v >= 50 THEN greatest(abs(quantile_cont(p, 0.3) OVER v), abs(quantile_cont(p, 0.7) OVER v)) END AS s FROM
 (SELECT symbol, bar, ln(lead(close, 4) OVER w / close) AS y, ln(close / lag(close, 4) OVER w) AS p FROM bars WHERE close > 0 WINDOW w AS (PARTITION BY symbol ORDER BY bar)) WINDOW v AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", "symbol bar y_cls", ""))
def label_quantile(spark, sf_dir):
    return L.fixed_horizon(bars(spark, sf_dir).where("close > 0"), ["symbol"], "bar", 4, "quantile", least=50).select("symbol", "bar", "y_cls")


@query("label_triple", sql(BARS_SQL, """SELECT symbol, bar, CASE WHEN n < 4 OR s IS NULL THEN -1 WHEN u >= s AND d > -s THEN 2 WHEN d <= -s AND u < s THEN 0 ELSE 1 END AS y_cls FROM (SELECT symbol, bar, count(x) OVER f AS n, max(x) OVER f - x AS u, min(x) OVER f - x AS d, 0.5 * CASE WHEN count(r) OVER v >= 24 THEN stddev_samp(r) OVER v END AS s FROM
 (SELECT symbol, bar, ln(close) AS x, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar)) AS r FROM bars WHERE close > 0) WINDOW f AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), v AS (PARTITION BY symbol ORDER BY bar ROWS 47 PRECEDING))""", "symbol bar y_cls", ""))
def label_triple(spark, sf_dir):
    return L.fixed_horizon(bars(spark, sf_dir).where("close > 0"), ["symbol"], "bar", 4, "triple", width=48).select("symbol", "bar", "y_cls")


@query("label_volatility", sql(BARS_SQL, """SELECT symbol, bar, CASE WHEN y > s THEN 2 WHEN y < -s THEN 0 ELSE 1 END AS y_cls FROM (SELECT symbol, bar, y, lag(CASE WHEN k >= 24 THEN d END) OVER (PARTITION BY symbol ORDER BY bar) * 2 AS s FROM
 (SELECT symbol, bar, y, stddev_samp(r) OVER v AS d, count(r) OVER v AS k FROM (SELECT symbol, bar, ln(lead(close, 4) OVER w / close) AS y, ln(close / lag(close) OVER w) AS r FROM bars WHERE close > 0 WINDOW w AS (PARTITION BY symbol ORDER BY bar)) WINDOW v AS (PARTITION BY symbol ORDER BY bar ROWS 47 PRECEDING)))""", "symbol bar y_cls", ""))
def label_volatility(spark, sf_dir):
    return L.fixed_horizon(bars(spark, sf_dir).where("close > 0"), ["symbol"], "bar", 4, "vol", width=48, scale=1.0).select("symbol", "bar", "y_cls")


@query("label_touch", sql(BARS_SQL, """SELECT symbol, bar, CASE WHEN n < 6 THEN -1 WHEN h AND NOT l THEN 2 WHEN l AND NOT h THEN 0 ELSE 1 END AS y_touch FROM (SELECT symbol, bar, count(close) OVER f AS n, max(close) OVER f >= close * 1.5 AS h, min(close) OVER f <= close * 0.5 AS l FROM bars
 WINDOW f AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING))""", "symbol bar y_touch", ""))
def label_touch(spark, sf_dir):
    return L.touch_label(bars(spark, sf_dir), ["symbol"], "bar", 6, 0.5, 0.5).select("symbol", "bar", "y_touch")


SIGNALS = BARS_SQL + """,
sg AS (SELECT symbol, lead(bar) OVER w AS t0, lead(open) OVER w AS entry_price, CASE WHEN count(close) OVER p = 5 THEN CASE WHEN close > max(high) OVER p THEN 1 WHEN close < min(low) OVER p THEN -1 END END AS side, bar FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY bar), p AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, lag(side) OVER (PARTITION BY symbol ORDER BY bar) AS before FROM sg WHERE side IS NOT NULL),
signals AS (SELECT symbol, t0, side, entry_price, 0.3 AS vol FROM s2 WHERE (before IS NULL OR before <> side) AND t0 IS NOT NULL AND entry_price > 0)"""


def _signals(spark, sf_dir):
    return L.flip_signals(bars(spark, sf_dir), ["symbol"], "bar", 5).where("entry_price > 0").withColumn("vol", F.lit(0.3))


@query("flip_signals", sql(SIGNALS, "SELECT * FROM signals", "symbol t0 side", "entry_price"))
def flip_signals(spark, sf_dir):
    return rounded(_signals(spark, sf_dir).drop("vol"))


BARRIER = SIGNALS + """,
nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS i FROM bars),
ev AS (SELECT s.*, n.i AS pos, s.entry_price * exp(2.0 * vol) AS upper, s.entry_price * exp(-1.0 * vol) AS lower FROM signals s JOIN nb n ON n.symbol = s.symbol AND n.bar = s.t0),
m AS (SELECT e.*, b.bar, b.i - pos AS j, b.high >= upper AS uh, b.low <= lower AS dh, b.i > pos AND b.open >= upper AS gu, b.i > pos AND b.open <= lower AS gd FROM ev e JOIN nb b ON b.symbol = e.symbol AND b.i BETWEEN pos AND pos + 24),
h AS (SELECT *, CASE WHEN gu THEN (side > 0)::INT WHEN gd THEN (side < 0)::INT WHEN uh AND dh THEN 0 WHEN uh THEN (side > 0)::INT WHEN dh THEN (side < 0)::INT END AS lab, uh OR dh OR gu OR gd AS touched FROM m),
tb AS (SELECT symbol, t0, side, entry_price, CASE WHEN side > 0 THEN upper ELSE lower END AS pt, CASE WHEN side > 0 THEN lower ELSE upper END AS sl, arg_min(lab, CASE WHEN touched THEN j END) AS label, coalesce(min(CASE WHEN touched THEN bar END), max(bar)) AS t1 FROM h GROUP BY symbol, t0, side, entry_price, upper, lower)"""


def _barrier(spark, sf_dir):
    return L.triple_barrier(bars(spark, sf_dir), _signals(spark, sf_dir), ["symbol"], "bar", 24, HOUR, 2.0, 1.0).drop("vol")


@query("triple_barrier", sql(BARRIER, "SELECT * FROM tb", "symbol t0 side label t1", "entry_price pt sl"))
def triple_barrier(spark, sf_dir):
    return rounded(_barrier(spark, sf_dir))


DRILL = BARRIER + """,
lows AS (SELECT symbol, ts_ms // 600000 * 600000 AS lt, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low FROM tape GROUP BY ALL),
amb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, t0, side ORDER BY j) AS k FROM h WHERE touched) WHERE k = 1 AND uh AND dh AND NOT gu AND NOT gd),
dr AS (SELECT a.symbol, a.t0, a.side, arg_min(CASE WHEN l.open >= upper THEN (a.side > 0)::INT WHEN l.open <= lower THEN (a.side < 0)::INT WHEN l.high >= upper AND l.low <= lower THEN 0 WHEN l.high >= upper THEN (a.side > 0)::INT ELSE (a.side < 0)::INT END, lt) AS label, min(lt) AS t1
 FROM amb a JOIN lows l ON l.symbol = a.symbol AND l.lt // 3600000 * 3600000 = a.bar WHERE l.high >= upper OR l.low <= lower GROUP BY ALL)"""


@query("triple_barrier_drill", sql(DRILL, "SELECT tb.* REPLACE (coalesce(dr.label, tb.label) AS label, coalesce(dr.t1, tb.t1) AS t1) FROM tb LEFT JOIN dr ON dr.symbol = tb.symbol AND dr.t0 = tb.t0 AND dr.side = tb.side", "symbol t0 side label t1", "entry_price pt sl"))
def triple_barrier_drill(spark, sf_dir):
    """Bars that reach both barriers are decided by the ten-minute bars inside them."""
    small = tape(spark, sf_dir).groupBy("symbol", (F.floor(F.col("ts_ms") / 600_000) * 600_000).alias("bar")).agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"))
    return rounded(L.triple_barrier(bars(spark, sf_dir), _signals(spark, sf_dir), ["symbol"], "bar", 24, HOUR, 2.0, 1.0, low=small).drop("vol"))


@query("barrier_grid", sql(SIGNALS + ", nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS i FROM bars)", """SELECT up, down, count(*) AS events, count(*) FILTER (lab = 1) AS wins, count(*) FILTER (lab = 0) AS losses FROM (
 SELECT up, down, e.symbol, e.t0, e.side, arg_min(CASE WHEN gu THEN (side > 0)::INT WHEN gd THEN (side < 0)::INT WHEN uh AND dh THEN 0 WHEN uh THEN (side > 0)::INT WHEN dh THEN (side < 0)::INT END, CASE WHEN uh OR dh THEN bar END) AS lab FROM (
  SELECT g.*, s.*, b.bar, b.high >= s.entry_price * exp(up * 0.3) AS uh, b.low <= s.entry_price * exp(-down * 0.3) AS dh, b.i > n.i AND b.open >= s.entry_price * exp(up * 0.3) AS gu, b.i > n.i AND b.open <= s.entry_price * exp(-down * 0.3) AS gd
   FROM signals s JOIN nb n ON n.symbol = s.symbol AND n.bar = s.t0 JOIN nb b ON b.symbol = s.symbol AND b.i BETWEEN n.i AND n.i + 24,
   (SELECT u.u AS up, d.u AS down FROM (VALUES (1.0), (2.0), (4.0)) u(u), (VALUES (1.0), (2.0), (4.0)) d(u)) g) e GROUP BY ALL) GROUP BY up, down""", "events wins losses", "up down"))
def barrier_grid(spark, sf_dir):
    return rounded(L.barrier_grid(bars(spark, sf_dir), _signals(spark, sf_dir), ["symbol"], "bar", 24, HOUR, [1, 2, 4], [1, 2, 4]))


@query("triple_barrier_open", sql(BARRIER.replace("BETWEEN pos AND pos + 24", ">= pos"), "SELECT * FROM tb", "symbol t0 side label t1", "entry_price pt sl"))
def triple_barrier_open(spark, sf_dir):
    """Barriers without expiry: an event is open until the data end."""
    return rounded(L.triple_barrier(bars(spark, sf_dir), _signals(spark, sf_dir), ["symbol"], "bar", None, HOUR, 2.0, 1.0).drop("vol"))


_MULTIPLES = "(VALUES (2.0), (4.0), (6.0), (8.0), (10.0))"


@query("barrier_grid_open", sql(SIGNALS, f"""SELECT up, down, count(*) AS events, count(*) FILTER (lab = 1) AS wins, count(*) FILTER (lab = 0) AS losses FROM (
 SELECT up, down, e.symbol, e.t0, e.side, arg_min(CASE WHEN gu THEN (side > 0)::INT WHEN gd THEN (side < 0)::INT WHEN uh AND dh THEN -1 WHEN uh THEN (side > 0)::INT WHEN dh THEN (side < 0)::INT END, CASE WHEN uh OR dh THEN bar END) AS lab FROM (
  SELECT g.*, s.*, b.bar, b.high >= s.entry_price * exp(up * 0.3) AS uh, b.low <= s.entry_price * exp(-down * 0.3) AS dh, b.bar > s.t0 AND b.open >= s.entry_price * exp(up * 0.3) AS gu, b.bar > s.t0 AND b.open <= s.entry_price * exp(-down * 0.3) AS gd
   FROM signals s JOIN bars b ON b.symbol = s.symbol AND b.bar >= s.t0, (SELECT u.u AS up, d.u AS down FROM {_MULTIPLES} u(u), {_MULTIPLES} d(u)) g) e GROUP BY ALL) GROUP BY up, down""", "events wins losses", "up down"))
def barrier_grid_open(spark, sf_dir):
    """All pairs of the usual multiples without expiry; a bar that reaches both barriers is undecided."""
    multiples = [2, 4, 6, 8, 10]
    return rounded(L.barrier_grid(bars(spark, sf_dir), _signals(spark, sf_dir), ["symbol"], "bar", None, HOUR, multiples, multiples, both="nan"))


@query("trade_summary", sql(BARRIER, "SELECT side, count(*) AS trades, count(*) FILTER (label = 1) AS wins, sum(pnl) AS pnl_sum, avg(pnl) AS pnl_mean, count(*) FILTER (label = 1) / count(*) AS win_rate FROM (SELECT *, coalesce(CASE WHEN label = 1 THEN abs(pt / entry_price - 1) WHEN label = 0 THEN -abs(sl / entry_price - 1) END, 0) AS pnl FROM tb) GROUP BY ROLLUP (side)", "side trades wins", "pnl_sum pnl_mean win_rate"))
def trade_summary(spark, sf_dir):
    """Without trades the win rate is NaN, as 0 / 0 is in the SQL."""
    return rounded(L.trade_summary(_barrier(spark, sf_dir)).fillna(float("nan"), subset=["win_rate"]))


@query("volatility_atr", sql(BARS_SQL, """SELECT symbol, bar, lag(CASE WHEN k >= 14 THEN a / close END) OVER (PARTITION BY symbol ORDER BY bar) AS vol FROM (SELECT symbol, bar, close, avg(tr) OVER v AS a, count(tr) OVER v AS k FROM
 (SELECT symbol, bar, close, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM bars WHERE close > 0 WINDOW w AS (PARTITION BY symbol ORDER BY bar)) WINDOW v AS (PARTITION BY symbol ORDER BY bar ROWS 13 PRECEDING))""", "symbol bar", "vol"))
def volatility_atr(spark, sf_dir):
    return rounded(L.volatility(bars(spark, sf_dir).where("close > 0"), ["symbol"], "bar", 14).select("symbol", "bar", "vol"))


# ---------------------------------------------------------------- folds


@query("fold_blocks", sql(BARS_SQL, "SELECT fold::INT AS fold, min(bar) AS lo, max(bar) AS hi FROM (SELECT bar, ntile(5) OVER (ORDER BY bar) - 1 AS fold FROM (SELECT DISTINCT bar FROM bars)) GROUP BY fold", "fold lo hi", ""))
def fold_blocks(spark, sf_dir):
    return V.blocks(bars(spark, sf_dir), "bar", 5)


@query("purged_folds", sql(BARS_SQL + ", f AS (SELECT fold::INT AS fold, min(bar) AS lo, max(bar) AS hi FROM (SELECT bar, ntile(5) OVER (ORDER BY bar) - 1 AS fold FROM (SELECT DISTINCT bar FROM bars)) GROUP BY fold)", "SELECT fold, role, count(*) AS n, min(bar) AS first, max(bar) AS last FROM (SELECT fold, bar, CASE WHEN bar BETWEEN lo AND hi THEN 'test' WHEN bar < lo - 86400000 OR bar > hi + 86400000 THEN 'train' END AS role FROM bars, f) WHERE role IS NOT NULL GROUP BY ALL", "fold role n first last", ""))
def purged_folds(spark, sf_dir):
    b = bars(spark, sf_dir)
    rows = V.assign(b.select("bar"), V.blocks(b, "bar", 5), "bar", 24 * HOUR)
    return rows.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("bar").alias("first"), F.max("bar").alias("last"))


MONTHS = "o AS (SELECT epoch_ms(o_orderdate) AS t FROM orders), m AS (SELECT *, row_number() OVER (ORDER BY month) - 1 AS i FROM (SELECT DISTINCT date_trunc('month', make_timestamp(t * 1000))::TIMESTAMP AS month FROM o))"


@query("rolling_folds", f"WITH {MONTHS} SELECT a.i::INT AS fold, epoch_ms(a.month) AS test_start, epoch_ms(a.month + INTERVAL 1 MONTH) AS test_end, epoch_ms(b.month) AS train_start, epoch_ms(a.month) - 86400000 AS train_end FROM m a JOIN m b ON b.i = a.i - 6 WHERE a.i >= 6 AND a.i + 1 < (SELECT count(*) FROM m)")
def rolling_folds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("t"))
    f = V.rolling_folds(o, "t", 6, 24 * HOUR)
    return f.withColumn("fold", F.col("fold").cast("int"))


@query("test_months", f"WITH {MONTHS} SELECT i::INT AS i, epoch_ms(month) AS start FROM m WHERE (month(month) - 1) % 3 = 0")
def test_months(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("t"))
    return V.test_months(o, "t").select(F.col("i").cast("int").alias("i"), "start")


@query("split_by_position", sql(BARS_SQL, "SELECT part, count(*) AS n FROM (SELECT CASE WHEN dense_rank() OVER (ORDER BY bar) <= floor((SELECT count(DISTINCT bar) FROM bars) * 0.8) THEN 'train' ELSE 'val' END AS part FROM bars) GROUP BY part", "part n", ""))
def split_by_position(spark, sf_dir):
    return V.split_by_position(bars(spark, sf_dir), "bar", 0.8).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- statistics

LONG = TAPE_SQL + ", lg AS (SELECT symbol, 'price' AS feature, price AS x, is_buyer_maker::INT AS y FROM tape UNION ALL SELECT symbol, 'qty', qty, is_buyer_maker::INT FROM tape)"
AUC_CTE = LONG + """,
rk AS (SELECT *, rank() OVER (PARTITION BY symbol, feature ORDER BY x) + (count(*) OVER (PARTITION BY symbol, feature, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY symbol, feature, x) AS t FROM lg),
au AS (SELECT symbol, feature, sum(y) AS n1, sum(1 - y) AS n0, sum(r * y) AS r1, sum(t * t - 1.0) AS ties FROM rk GROUP BY ALL),
a2 AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS auc FROM au),
a3 AS (SELECT *, 2 * auc - 1 AS rrb, pow(2.0 / (n1 * n0), 2) * (n1 * n0 / 12.0 * ((n1 + n0) + 1 - ties / ((n1 + n0) * (n1 + n0 - 1.0)))) AS var_rrb FROM a2)"""


def _auc(spark, sf_dir):
    t = tape(spark, sf_dir).select("symbol", F.col("is_buyer_maker").cast("int").alias("y"), "price", "qty")
    return S.auc(S.unpivot(t, ["symbol", "y"], ["price", "qty"]), ["symbol", "feature"])


@query("auc_rank_biserial", sql(AUC_CTE, "SELECT symbol, feature, n1, n0, u, auc, rrb, var_rrb, rrb / sqrt(var_rrb) AS z, rrb - 1.959963984540054 * sqrt(var_rrb) AS ci_low, rrb + 1.959963984540054 * sqrt(var_rrb) AS ci_high FROM a3", "symbol feature", "n1 n0 u auc rrb var_rrb z ci_low ci_high"))
def auc_rank_biserial(spark, sf_dir):
    return rounded(_auc(spark, sf_dir).withColumns({"n1": F.col("n1").cast("double"), "n0": F.col("n0").cast("double")}))


def _p(z: str) -> str:
    """The two-sided p of the normal law in SQL: the density's integral over [0, |z|] by Simpson's rule."""
    w = "CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"greatest(1 - 2 * abs({z}) / 1200 / sqrt(2 * pi()) * list_sum([({w}) * exp(-pow(abs({z}) * i / 400.0, 2) / 2) FOR i IN range(401)]), 1e-300)"


@query("fixed_effect", sql(AUC_CTE, f"SELECT feature, k, mean, se, mean / se AS z, {_p('mean / se')} AS p, mean - 1.959963984540054 * se AS ci_low, mean + 1.959963984540054 * se AS ci_high FROM (SELECT feature, count(*) AS k, sum(rrb / var_rrb) / sum(1 / var_rrb) AS mean, sqrt(1 / sum(1 / var_rrb)) AS se FROM a3 GROUP BY feature)", "feature k", "mean se z p ci_low ci_high"))
def fixed_effect(spark, sf_dir):
    return rounded(S.fixed_effect(_auc(spark, sf_dir), ["feature"]))


@query("random_effects", sql(AUC_CTE + """,
s AS (SELECT feature, count(*) AS k, sum(1 / var_rrb) AS w, sum(1 / var_rrb / var_rrb) AS w2, sum(rrb / var_rrb) AS we, sum(rrb * rrb / var_rrb) AS we2 FROM a3 GROUP BY feature),
s2 AS (SELECT feature, k, we2 - we * we / w AS q, greatest(0, (we2 - we * we / w - (k - 1)) / (w - w2 / w)) AS tau2 FROM s)""", "SELECT s2.feature, k, q, tau2, CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) ELSE 0 END AS i2, sum(rrb / (var_rrb + tau2)) / sum(1 / (var_rrb + tau2)) AS mean, sqrt(1 / sum(1 / (var_rrb + tau2))) AS se FROM a3 JOIN s2 USING (feature) GROUP BY ALL", "feature k", "q tau2 i2 mean se"))
def random_effects(spark, sf_dir):
    return rounded(S.random_effects(_auc(spark, sf_dir), ["feature"]))


@query("stouffer", sql(AUC_CTE, f"SELECT feature, z, {_p('z')} AS p FROM (SELECT feature, sum(sqrt(n1 + n0) * sign(auc - 0.5) * abs(rrb / sqrt(var_rrb))) / sqrt(sum(n1 + n0)) AS z FROM a3 GROUP BY feature)", "feature", "z p"))
def stouffer(spark, sf_dir):
    return rounded(S.stouffer(_auc(spark, sf_dir), ["feature"]))


@query("false_discovery", TAPE_SQL.join(["WITH ", """, p AS (SELECT user_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE 1.0 / (1 + count(*) * count(*)) END AS p FROM tape GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY coalesce(p, 1)) AS i, count(*) OVER () AS m FROM p)
SELECT user_id, coalesce(coalesce(p, 1) <= (SELECT max(coalesce(p, 1)) FROM r WHERE coalesce(p, 1) <= 0.05 * i / m), false) AS reject FROM r"""]))
def false_discovery(spark, sf_dir):
    n = F.count(F.lit(1)).cast("double")
    p = tape(spark, sf_dir).groupBy("user_id").agg(n.alias("n")).select("user_id", F.when(F.col("user_id") % 10 != 0, 1.0 / (1 + F.col("n") * F.col("n"))).alias("p"))
    return S.false_discovery(p).select("user_id", "reject")


IC_CTE = TAPE_SQL + """,
ic0 AS (SELECT symbol, ts_ms // 86400000 AS day, qty AS x, price AS y FROM tape),
ic1 AS (SELECT *, rank() OVER (PARTITION BY symbol, day ORDER BY x) + (count(*) OVER (PARTITION BY symbol, day, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY symbol, day ORDER BY y) + (count(*) OVER (PARTITION BY symbol, day, y) - 1) / 2.0 AS ry FROM ic0),
ic2 AS (SELECT symbol, day, count(*) AS n, CASE WHEN count(*) >= 10 AND stddev_pop(x) > 1e-12 AND stddev_pop(y) > 0 THEN corr(rx, ry) END AS ic FROM ic1 GROUP BY ALL)"""


def _ic(spark, sf_dir):
    long = tape(spark, sf_dir).select("symbol", F.floor(F.col("ts_ms") / 86_400_000).alias("day"), F.col("qty").alias("x"), F.col("price").alias("y"))
    return S.rank_ic(long, ["symbol", "day"])


@query("daily_rank_ic", sql(IC_CTE, "SELECT * FROM ic2", "symbol day n", "ic"))
def daily_rank_ic(spark, sf_dir):
    return rounded(_ic(spark, sf_dir))


@query("ic_summary", sql(IC_CTE, "SELECT symbol, count(*) AS days, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / (stddev_samp(ic) + 1e-9) AS icir, icir * sqrt(count(*)) AS t, (abs(t) > 2)::INT AS strong FROM ic2 WHERE ic IS NOT NULL GROUP BY symbol", "symbol days strong", "ic_mean ic_std icir t"))
def ic_summary(spark, sf_dir):
    return rounded(S.ic_summary(_ic(spark, sf_dir), ["symbol"]))


@query("ic_shares", sql(IC_CTE, "SELECT count(*) AS series, count(*) FILTER (abs(t) > 2) AS strong, count(*) FILTER (abs(t) > 2) / count(*) AS strong_share FROM (SELECT symbol, avg(ic) / (stddev_samp(ic) + 1e-9) * sqrt(count(*)) AS t FROM ic2 WHERE ic IS NOT NULL GROUP BY symbol)", "series strong", "strong_share"))
def ic_shares(spark, sf_dir):
    return rounded(S.strong_share(S.ic_summary(_ic(spark, sf_dir), ["symbol"])))


_DIMS = 64
_EMB = """e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
pr AS (SELECT 'd' || x.i AS a, 'd' || y.i AS b, corr(x.v, y.v) AS r FROM e x JOIN e y ON x.vec_id = y.vec_id AND x.i < y.i GROUP BY ALL)"""


def _pairs(spark, sf_dir):
    """The distances of all pairs of the 64 dimensions."""
    names = [f"d{k}" for k in range(_DIMS)]
    e = table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)])
    return S.distances(S.pair_products(e, names))


@query("pair_distances", sql(_EMB, "SELECT a, b, r, sqrt(greatest(2 * (1 - r), 0)) AS d FROM pr", "a b", "r d"))
def pair_distances(spark, sf_dir):
    return rounded(_pairs(spark, sf_dir))


CLUSTERS = _EMB + ", cl AS (SELECT 'd' || k AS item, k % 3 AS cluster FROM range(64) t(k)), pd AS (SELECT a, b, sqrt(greatest(2 * (1 - r), 0)) AS d FROM pr), bo AS (SELECT a, b, d FROM pd UNION ALL SELECT b, a, d FROM pd)"


def _clusters(spark):
    return spark.range(_DIMS).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("item"), (F.col("id") % 3).alias("cluster"))


@query("cluster_medoids", sql(CLUSTERS, "SELECT cluster, arg_min(a, struct_pack(m := m, a := a)) AS item FROM (SELECT x.cluster, a, avg(d) AS m FROM (SELECT * FROM bo UNION ALL SELECT item, item, 0.0 FROM cl) q JOIN cl x ON x.item = q.a JOIN cl y ON y.item = q.b WHERE x.cluster = y.cluster GROUP BY ALL) GROUP BY cluster", "cluster item", ""))
def cluster_medoids(spark, sf_dir):
    return S.representatives(_pairs(spark, sf_dir), _clusters(spark))


@query("cluster_scores", sql(CLUSTERS + ", bl AS (SELECT x.cluster AS ca, y.cluster AS cb, avg(d) AS d FROM bo JOIN cl x ON x.item = bo.a JOIN cl y ON y.item = bo.b GROUP BY ALL)", "SELECT ca AS cluster, max(d) FILTER (ca = cb) AS intra, min(d) FILTER (ca <> cb) AS inter, (min(d) FILTER (ca <> cb) - max(d) FILTER (ca = cb)) / greatest(min(d) FILTER (ca <> cb), max(d) FILTER (ca = cb)) AS score FROM bl GROUP BY ca", "cluster", "intra inter score"))
def cluster_scores(spark, sf_dir):
    return rounded(S.cluster_scores(_pairs(spark, sf_dir), _clusters(spark)))


@query("pair_distances_all", SQL["pair_distances"])
def pair_distances_all(spark, sf_dir):
    """All 2,016 pairs by one aggregate of expressions instead of matrices of products, in groups of columns."""
    names = [f"d{k}" for k in range(_DIMS)]
    e = table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)])
    return rounded(S.distances(S.pair_correlations(e, names)))


@query("cluster_medoids_all", SQL["cluster_medoids"])
def cluster_medoids_all(spark, sf_dir):
    return S.representatives(_pairs(spark, sf_dir), _clusters(spark))


@query("cluster_scores_all", SQL["cluster_scores"])
def cluster_scores_all(spark, sf_dir):
    return rounded(S.cluster_scores(_pairs(spark, sf_dir), _clusters(spark)))


@query("cluster_centres", sql(CLUSTERS + """, lim AS (SELECT quantile_cont(d, 0.25) AS q FROM pd), nb AS (SELECT x.cluster, a, count(*) FILTER (x.cluster = y.cluster AND d <= q) AS n FROM bo JOIN cl x ON x.item = bo.a JOIN cl y ON y.item = bo.b, lim GROUP BY ALL)""", "SELECT cluster, arg_min(a, struct_pack(n := -n, a := a)) AS item FROM nb GROUP BY cluster", "cluster item", ""))
def cluster_centres(spark, sf_dir):
    """Of each cluster the item with the most neighbours in it within the lowest quarter of all distances."""
    return S.busiest(_pairs(spark, sf_dir), _clusters(spark))


VOTES = TAPE_SQL + """, v AS (SELECT user_id, CASE WHEN user_id % 7 <> 0 THEN (qty % 3)::INT END AS pred, 1 - qty / 202.0 - price / 400.0 AS p0, qty / 202.0 AS p1, price / 400.0 AS p2 FROM tape),
h AS (SELECT user_id, arg_min(pred, struct_pack(n := -n, p := pred)) AS hard FROM (SELECT user_id, pred, count(*) AS n FROM v WHERE pred IS NOT NULL GROUP BY ALL) GROUP BY user_id),
m AS (SELECT user_id, count(pred) AS votes_total, avg(p0) FILTER (pred IS NOT NULL) AS a0, avg(p1) FILTER (pred IS NOT NULL) AS a1, avg(p2) FILTER (pred IS NOT NULL) AS a2 FROM v GROUP BY user_id)"""


@query("ensemble_vote", sql(VOTES, "SELECT m.user_id, votes_total, hard, CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0 WHEN a1 >= a2 THEN 1 WHEN a1 IS NOT NULL THEN 2 END AS soft, a1 - a0 AS margin FROM m LEFT JOIN h USING (user_id)", "user_id votes_total hard soft", "margin"))
def ensemble_vote(spark, sf_dir):
    """Three classes; some users have no votes at all."""
    p1, p2 = F.col("qty") / 202.0, F.col("price") / 400.0
    t = tape(spark, sf_dir).select("user_id", F.when(F.col("user_id") % 7 != 0, (F.col("qty") % 3).cast("int")).alias("pred"), (1 - p1 - p2).alias("p0"), p1.alias("p1"), p2.alias("p2"))
    return rounded(S.vote(t, ["user_id"], ["p0", "p1", "p2"]))


@query("regression_metrics", sql(TAPE_SQL + ", z AS (SELECT symbol, price AS y, qty AS p, rank() OVER (PARTITION BY symbol ORDER BY price) + (count(*) OVER (PARTITION BY symbol, price) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY symbol ORDER BY qty) + (count(*) OVER (PARTITION BY symbol, qty) - 1) / 2.0 AS rp FROM tape)",
    "SELECT symbol, avg((y - p) * (y - p)) AS mse, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, avg(CASE WHEN abs(y - p) <= 1 THEN (y - p) * (y - p) / 2 ELSE abs(y - p) - 0.5 END) AS huber, corr(y, p) AS pearson, corr(ry, rp) AS spearman FROM z GROUP BY symbol", "symbol", "mse rmse mae huber pearson spearman"))
def regression_metrics(spark, sf_dir):
    return rounded(S.regression_metrics(tape(spark, sf_dir).select("symbol", F.col("price").alias("y"), F.col("qty").alias("p")), ["symbol"]))


CLASSES = TAPE_SQL + ", c AS (SELECT (seq % 3)::INT AS y, CASE WHEN qty > 60 THEN (seq % 3)::INT ELSE (qty % 3)::INT END AS p FROM tape)"


def _classes(spark, sf_dir):
    y = (F.col("seq") % 3).cast("int")
    return tape(spark, sf_dir).select(y.alias("y"), F.when(F.col("qty") > 60, y).otherwise((F.col("qty") % 3).cast("int")).alias("p"))


@query("class_metrics", sql(CLASSES + ", k AS (SELECT k AS class, count(*) FILTER (y = k) AS support, count(*) FILTER (y = k AND p = k) / count(*) FILTER (p = k) AS precision, count(*) FILTER (y = k AND p = k) / count(*) FILTER (y = k) AS recall FROM c, (VALUES (0), (1), (2)) v(k) GROUP BY k)", "SELECT class, support, precision, recall, 2 * precision * recall / (precision + recall) AS f1, 1.25 * precision * recall / (0.25 * precision + recall) AS f05 FROM k", "class support", "precision recall f1 f05"))
def class_metrics(spark, sf_dir):
    return rounded(S.class_metrics(_classes(spark, sf_dir)))


@query("summary_metrics", sql(CLASSES + """, n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (y = p)::DOUBLE AS c FROM c), k AS (SELECT k, (count(*) FILTER (y = k))::DOUBLE AS t, (count(*) FILTER (p = k))::DOUBLE AS s, (count(*) FILTER (y = k AND p = k))::DOUBLE AS h FROM c, (VALUES (0), (1), (2)) v(k) GROUP BY k),
 k2 AS (SELECT *, h / s AS pr, h / t AS rc, 2 * h / (s + t) AS f1, 1.25 * h / (s + 0.25 * t) AS f05 FROM k)""", """SELECT any_value(c) / any_value(n) AS accuracy, avg(pr) AS macro_precision, avg(rc) AS macro_recall, avg(f1) AS macro_f1, avg(f05) AS macro_f05, sum(f1 * t) / sum(t) AS weighted_f1,
 (any_value(c) * any_value(n) - sum(t * s)) / sqrt((any_value(n) * any_value(n) - sum(s * s)) * (any_value(n) * any_value(n) - sum(t * t))) AS mcc FROM k2, n""", "", "accuracy macro_precision macro_recall macro_f1 macro_f05 weighted_f1 mcc"))
def summary_metrics(spark, sf_dir):
    return rounded(S.summary_metrics(_classes(spark, sf_dir)))


@query("best_threshold", sql(TAPE_SQL + ", s AS (SELECT least(floor(qty / 101.0 * 100 + 1e-9), 100)::INT AS b, is_buyer_maker::INT AS y FROM tape), g AS (SELECT t, (SELECT count(*) FILTER (b >= t) FROM s) AS said, (SELECT sum(y) FILTER (b >= t) FROM s) AS tp, (SELECT sum(y) FROM s) AS pos FROM range(101) r(t))", "SELECT t / 100.0 AS threshold, coalesce(2.0 * tp / nullif(pos + said, 0), 0) AS fbeta FROM g ORDER BY fbeta DESC, threshold LIMIT 1", "", "threshold fbeta"))
def best_threshold(spark, sf_dir):
    t = tape(spark, sf_dir).select((F.col("qty") / 101.0).alias("score"), F.col("is_buyer_maker").cast("int").alias("y"))
    return rounded(S.best_threshold(t))


_LEVELS = [k / 200 for k in range(201)]


@query("threshold_sweep", sql(TAPE_SQL + f", s AS (SELECT price AS score, (qty >= 50)::INT AS y FROM tape), t AS (SELECT DISTINCT unnest(quantile_cont(score, {_LEVELS})) AS t FROM s), c AS (SELECT t, (SELECT count(*) FROM s) AS n, (SELECT sum(y) FROM s) AS p, (SELECT count(*) FROM s WHERE score >= t) AS said, (SELECT coalesce(sum(y), 0) FROM s WHERE score >= t) AS tp FROM t), f AS (SELECT t, coalesce(1.25 * tp / nullif(0.25 * p + said, 0), 0) AS one, coalesce(1.25 * (n - said - p + tp) / nullif(0.25 * (n - p) + n - said, 0), 0) AS other FROM c)", "SELECT t AS threshold, one AS fbeta, (one + other) / 2 AS macro FROM f", "", "threshold fbeta macro"))
def threshold_sweep(spark, sf_dir):
    """F-scores at the quantiles of unbounded scores."""
    t = tape(spark, sf_dir).select(F.col("price").alias("score"), (F.col("qty") >= 50).cast("int").alias("y"))
    return rounded(S.threshold_scores(t, S.quantile_grid(t)))


@query("sharpe", sql(BARS_SQL + ", p AS (SELECT symbol, sign(lag(close - open) OVER w) * ln(close / lag(close) OVER w) AS pnl FROM bars WHERE close > 0 WINDOW w AS (PARTITION BY symbol ORDER BY bar))", "SELECT symbol, avg(pnl) / stddev_samp(pnl) * sqrt(252) AS sharpe FROM p GROUP BY symbol", "symbol", "sharpe"))
def sharpe(spark, sf_dir):
    w = W.partitionBy("symbol").orderBy("bar")
    b = bars(spark, sf_dir).where("close > 0").select("symbol", "bar", (F.col("close") - F.col("open")).alias("signal"), F.log(F.col("close") / F.lag("close").over(w)).alias("ret"))
    return rounded(S.sharpe(b, ["symbol"], "bar", "signal", "ret"))


@query("sharpe_population", sql(BARS_SQL + ", p AS (SELECT symbol, sign(lag(close - open) OVER w) * ln(close / lag(close) OVER w) AS pnl FROM bars WHERE close > 0 WINDOW w AS (PARTITION BY symbol ORDER BY bar))", "SELECT symbol, avg(pnl) / (stddev_pop(pnl) + 1e-9) * sqrt(96 * 365) AS sharpe FROM p GROUP BY symbol", "symbol", "sharpe"))
def sharpe_population(spark, sf_dir):
    w = W.partitionBy("symbol").orderBy("bar")
    b = bars(spark, sf_dir).where("close > 0").select("symbol", "bar", (F.col("close") - F.col("open")).alias("signal"), F.log(F.col("close") / F.lag("close").over(w)).alias("ret"))
    return rounded(S.sharpe(b, ["symbol"], "bar", "signal", "ret", 96 * 365, population=True))


@query("class_weights", sql("c AS (SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1)", "SELECT class, n, n / sum(n) OVER () AS prior, (1.0 / n) / avg(1.0 / n) OVER () AS weight FROM c", "class", "n prior weight"))
def class_weights(spark, sf_dir):
    return rounded(S.class_weights(table(spark, sf_dir, "lineitem"), "l_returnflag"))


# ---------------------------------------------------------------- alpha expressions

TREES = {
    "a_mix": ("-", ("rolling_mean", "close", 5), ("delay", "close", 3)),
    "a_ratio": ("/", ("delta", "close", 2), ("rolling_std", "close", 10)),
    "a_corr": ("correlation", "close", "volume", 12),
    "a_decay": ("decay_linear", ("log", "volume"), 4),
    "a_power": ("signedpower", ("-", "close", "open"), 2),
    "a_rank": ("rank", "close"),
    "a_scale": ("scale", "volume"),
    "a_sig": ("sigmoid", ("inverse", ("sqrt", "close"))),
}
ALPHA_BODY = """SELECT symbol, bar, CASE WHEN count(*) OVER w5 = 5 THEN avg(close) OVER w5 END - lag(close, 3) OVER w AS a_mix,
 CASE WHEN count(*) OVER w10 = 10 AND stddev_samp(close) OVER w10 > 1e-12 THEN (close - lag(close, 2) OVER w) / stddev_samp(close) OVER w10 END AS a_ratio,
 CASE WHEN count(*) OVER w12 = 12 THEN corr(close, volume) OVER w12 END AS a_corr,
 (4 * ln(abs(volume) + 1) + 3 * ln(abs(lag(volume) OVER w) + 1) + 2 * ln(abs(lag(volume, 2) OVER w) + 1) + ln(abs(lag(volume, 3) OVER w) + 1)) / 10 AS a_decay,
 sign(close - open) * pow(abs(close - open), 2) AS a_power, (rank() OVER (PARTITION BY symbol ORDER BY close) + (count(*) OVER (PARTITION BY symbol, close) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol) AS a_rank,
 volume / sum(abs(volume)) OVER (PARTITION BY symbol) AS a_scale, CASE WHEN sqrt(close) > 1e-12 THEN 0.5 * (1 + tanh(1 / sqrt(close) / 2)) END AS a_sig
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar), w5 AS (PARTITION BY symbol ORDER BY bar ROWS 4 PRECEDING), w10 AS (PARTITION BY symbol ORDER BY bar ROWS 9 PRECEDING), w12 AS (PARTITION BY symbol ORDER BY bar ROWS 11 PRECEDING)"""
ALPHA_SQL = sql(BARS_SQL, ALPHA_BODY, "symbol bar", " ".join(TREES))
FITNESS_SQL = sql(BARS_SQL + f""", ax AS ({ALPHA_BODY}), ux AS (UNPIVOT ax ON {", ".join(TREES)} INTO NAME alpha VALUE v), tx AS (SELECT symbol, bar, lead(close) OVER (PARTITION BY symbol ORDER BY bar) - close AS target FROM bars)""",
    "SELECT symbol, alpha, corr(v, target) AS ic FROM ux JOIN tx USING (symbol, bar) GROUP BY ALL", "symbol alpha", "ic")


@query("alpha_expressions", ALPHA_SQL)
def alpha_expressions(spark, sf_dir):
    return rounded(A.evaluate(bars(spark, sf_dir), TREES, ["symbol"], "bar").select("symbol", "bar", *TREES))


@query("alpha_fitness", FITNESS_SQL)
def alpha_fitness(spark, sf_dir):
    b = bars(spark, sf_dir)
    w = W.partitionBy("symbol").orderBy("bar")
    with_target = A.evaluate(b, TREES, ["symbol"], "bar").withColumn("target", F.lead("close").over(w) - F.col("close"))
    return rounded(A.fitness(with_target, list(TREES), "target", ["symbol"]))
