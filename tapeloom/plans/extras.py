"""Queries over tables, window summaries, merges of predictions, files and clusters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import components as C
from ..operators import curves as R
from ..operators import folds as V
from ..operators import book as K
from ..operators import selection as P
from ..operators import stats as S
from ..operators import tables as T
from ..operators import windows as N
from ..sources import records
from ..sources.scratch import new_dir
from ..sources.store import FeatureTable
from .adapters import BARS_SQL, HOUR, TAPE_SQL, bars, rounded, sql, table, tape
from .research import _EMB, _clusters, _pairs

QUERIES: dict = {}
SQL: dict[str, str] = {}
DAY = 86_400_000


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


NUMBERED = BARS_SQL + ", nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS i FROM bars)"


@query("exponential_mean", sql(NUMBERED, "SELECT a.symbol, a.bar, sum(b.close * pow(exp(-ln(2) / 9), a.i - b.i) * CASE WHEN b.i = 0 THEN 1 ELSE 1 - exp(-ln(2) / 9) END) AS ewm FROM nb a JOIN nb b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY ALL", "symbol bar", "ewm"))
def exponential_mean(spark, sf_dir):
    """A half-life of 9 bars, in chunks of 50 rows, so that every series is several."""
    return rounded(N.exponential_mean(bars(spark, sf_dir).select("symbol", "bar", "close"), ["symbol"], "bar", "close", 1 - math.exp(-math.log(2) / 9), cell=48 * HOUR, chunk=50).select("symbol", "bar", "ewm"))


REDUCED = NUMBERED + """,
al AS (SELECT 1 - exp(-ln(2) / 12) AS alpha),
em AS (SELECT a.symbol, a.bar, a.i, a.close, sum(b.close * pow(1 - alpha, a.i - b.i) * CASE WHEN b.i = 0 THEN 1 ELSE alpha END) AS m, sum(pow(pow(1 - alpha, a.i - b.i) * CASE WHEN b.i = 0 THEN 1 ELSE alpha END, 2)) AS w2 FROM nb a JOIN nb b ON a.symbol = b.symbol AND b.i <= a.i, al GROUP BY ALL),
ev AS (SELECT e.symbol, e.bar, sum(pow(b.close - e.m, 2) * pow(1 - alpha, e.i - b.i) * CASE WHEN b.i = 0 THEN 1 ELSE alpha END) AS v FROM em e JOIN nb b ON e.symbol = b.symbol AND b.i <= e.i, al GROUP BY ALL),
r AS (SELECT symbol, bar, 'last' AS kind, close AS value FROM nb
 UNION ALL SELECT symbol, bar, 'sma', CASE WHEN i >= 5 THEN avg(close) OVER w END FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 23 PRECEDING)
 UNION ALL SELECT symbol, bar, 'zscore', CASE WHEN i >= 5 THEN (close - avg(close) OVER w) / (stddev_pop(close) OVER w + 1e-12) END FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 23 PRECEDING)
 UNION ALL SELECT symbol, bar, 'percentile', CASE WHEN i >= 5 THEN quantile_cont(close, 0.8) OVER w END FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 23 PRECEDING)
 UNION ALL SELECT symbol, bar, 'slope', CASE WHEN i >= 7 THEN regr_slope(close, i) OVER w END FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 23 PRECEDING)
 UNION ALL SELECT symbol, bar, 'ema', CASE WHEN i >= 5 THEN m END FROM em
 UNION ALL SELECT symbol, bar, 'ewm_zscore', CASE WHEN i >= 5 THEN (close - m) / (sqrt(v / (1 - w2)) + 1e-12) END FROM em JOIN ev USING (symbol, bar))"""


@query("window_reducers", sql(REDUCED, "SELECT * FROM r", "symbol bar kind", "value"))
def window_reducers(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "bar", "close")
    out = None
    for kind in ("last", "sma", "zscore", "percentile", "slope", "ema", "ewm_zscore"):
        one = N.reduced(b, ["symbol"], "bar", "close", kind, 24).select("symbol", "bar", F.lit(kind).alias("kind"), "value")
        out = one if out is None else out.union(one)
    return rounded(out)


@query("autocorrelation", sql(BARS_SQL, "SELECT symbol, corr(close, p) AS r FROM (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY bar) AS p FROM bars) GROUP BY symbol", "symbol", "r"))
def autocorrelation(spark, sf_dir):
    return rounded(T.autocorrelation(bars(spark, sf_dir), ["symbol"], "bar", "close"))


@query("at_times", sql(BARS_SQL, "SELECT symbol, bar, close FROM bars WHERE bar IN (SELECT max(bar) FROM bars GROUP BY bar // 86400000)", "symbol bar", "close"))
def at_times(spark, sf_dir):
    b = bars(spark, sf_dir)
    times = b.groupBy(F.floor(F.col("bar") / DAY).alias("day")).agg(F.max("bar").alias("bar")).select("bar")
    return rounded(T.at_times(b, times, "bar").select("symbol", "bar", "close"))


@query("merge_predictions", sql(TAPE_SQL + ", u AS (SELECT user_id, count(*) AS n, avg(qty) AS q FROM tape GROUP BY user_id)", "SELECT user_id, n, CASE WHEN user_id % 2 = 0 THEN (q > 50)::INT END AS m1, CASE WHEN user_id % 3 > 0 THEN (n > 60)::INT END AS m2 FROM u", "user_id n m1 m2", ""))
def merge_predictions(spark, sf_dir):
    """Two models that have each judged some users only."""
    u = tape(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("qty").alias("q"))
    parts = {"m1": u.where("user_id % 2 = 0").withColumn("pred", (F.col("q") > 50).cast("int")), "m2": u.where("user_id % 3 > 0").withColumn("pred", (F.col("n") > 60).cast("int"))}
    return T.merge_predictions(u.select("user_id", "n"), parts, ["user_id"])


@query("recode", "SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 9 END AS code FROM events")
def recode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view", "purchase"), F.col("event_type")).otherwise("other")
    return e.select("event_id", T.recode(kind, {"click": 0, "view": 1, "purchase": 2, "other": 9}).alias("code"))


@query("sample_rows")
def sample_rows(spark, sf_dir):
    """2,000 events, the same ones at each run (checked in the tests)."""
    return T.sample_rows(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], 2000, seed=7)


@query("due_bars", sql(BARS_SQL + ", l AS (SELECT symbol, max(bar) FILTER (bar // 3600000 % 5 = 0) AS last, max(bar) AS newest FROM bars GROUP BY symbol)", "SELECT symbol, unnest(range(last + 3600000, newest + 7200000, 3600000)) AS close FROM l", "symbol close", ""))
def due_bars(spark, sf_dir):
    """Closed bars still to be worked on: from the last one done to the one after the newest bar."""
    newest = bars(spark, sf_dir).groupBy("symbol").agg(F.max(F.when(F.floor(F.col("bar") / HOUR) % 5 == 0, F.col("bar"))).alias("last"), F.max("bar").alias("newest"))
    return T.due_bars(newest, HOUR, F.col("newest") + HOUR, ["symbol"])


@query("clipped", sql(BARS_SQL, "SELECT symbol, bar, close FROM bars WHERE bar <= (SELECT quantile_disc(bar, 0.5) FROM bars)", "symbol bar", "close"))
def clipped(spark, sf_dir):
    b = bars(spark, sf_dir)
    trigger = b.agg(F.expr("cast(percentile_disc(0.5) within group (order by bar) as long)").alias("trigger"))  # one row
    return rounded(T.clipped(b.crossJoin(F.broadcast(trigger)), "bar", F.col("trigger")).select("symbol", "bar", "close"))


@query("redundancy", f"""WITH {_EMB}, rk AS (SELECT vec_id, i, rank() OVER (PARTITION BY i ORDER BY v) + (count(*) OVER (PARTITION BY i, v) - 1) / 2.0 AS k FROM e),
pc AS (SELECT x.i AS a, y.i AS b, corr(x.k, y.k) AS r FROM rk x JOIN rk y ON x.vec_id = y.vec_id AND x.i < y.i GROUP BY ALL) SELECT count(r) AS pairs, round(avg(abs(r)), 6) + 0.0 AS mean_abs_rho FROM pc""")
def redundancy(spark, sf_dir):
    names = [f"d{k}" for k in range(64)]
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)])
    return rounded(S.redundancy(e, "vec_id", names))


@query("recent_objective", sql(TAPE_SQL + ", z AS (SELECT symbol, price AS y, qty AS p, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) - 1 AS k FROM tape)", "SELECT symbol, sum(pow(0.9, k) * (p - y) * (p - y)) / sum(pow(0.9, k)) AS ema_mse, corr(y, p) AS pearson, ema_mse + 1 - pearson AS objective FROM z GROUP BY symbol", "symbol", "ema_mse pearson objective"))
def recent_objective(spark, sf_dir):
    t = tape(spark, sf_dir).select("symbol", "seq", F.col("price").alias("y"), F.col("qty").alias("p"))
    return rounded(S.recent_objective(t, ["symbol"], "seq"))


_F = lambda c: f"coalesce(1.25 * count(*) FILTER (t = {c} AND s = {c}) / nullif(0.25 * count(*) FILTER (t = {c}) + count(*) FILTER (s = {c}), 0), 0)"
BANDS_SQL = sql(TAPE_SQL + f""", z AS (SELECT price - 50 AS y, (price - 50) * 0.5 + qty - 50 AS p FROM tape), c AS (SELECT quantile_cont(abs(y), 0.4) AS tb, quantile_cont(abs(p), [{", ".join(repr(0.05 + 0.9 * k / 200) for k in range(201))}]) AS bands FROM z),
 g AS (SELECT tb, unnest(bands) AS band, unnest(range(201)) AS k FROM c), l AS (SELECT k, band, tb, CASE WHEN y > tb THEN 2 WHEN y < -tb THEN 0 ELSE 1 END AS t, CASE WHEN p > band THEN 2 WHEN p < -band THEN 0 ELSE 1 END AS s FROM z CROSS JOIN g),
 f AS (SELECT k, any_value(tb) AS true_band, any_value(band) AS pred_band, ({" + ".join(map(_F, range(3)))}) / {" + ".join(f"(count(*) FILTER (t = {c} OR s = {c}) > 0)::INT" for c in range(3)).join("()")} AS score FROM l GROUP BY k)""",
    "SELECT true_band, pred_band, score FROM f ORDER BY round(score, 12) DESC, k LIMIT 1", "", "true_band pred_band score")


@query("class_bands", BANDS_SQL)
def class_bands(spark, sf_dir):
    """Bands that turn a regression into three classes."""
    t = tape(spark, sf_dir).select((F.col("price") - 50).alias("y"), ((F.col("price") - 50) * 0.5 + F.col("qty") - 50).alias("p"))
    return rounded(S.class_bands(t))


@query("mean_correlation", f"WITH {_EMB} SELECT count(r) AS n, round(avg(abs(r)), 6) + 0.0 AS mean_abs_r, round(avg(r), 6) + 0.0 AS mean_r FROM pr WHERE substr(a, 2)::INT % 3 = 0 AND substr(b, 2)::INT % 3 = 0")
def mean_correlation(spark, sf_dir):
    """The correlation of the items of one cluster."""
    return rounded(T.mean_correlation(_pairs(spark, sf_dir), _clusters(spark).where("cluster = 0").select("item")))


@query("grid_report", "SELECT l_quantity, l_returnflag, round(avg(l_extendedprice), 3) AS price FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def grid_report(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_quantity", "l_returnflag").agg(F.avg("l_extendedprice").alias("price"))
    return T.grid_report(g, F.col("l_returnflag") != "N", [F.desc("price"), F.asc("l_quantity")])


@query("last_write_wins", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_write_wins(spark, sf_dir):
    return K.last_write_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("align_to_snapshot", sql(TAPE_SQL + ", d AS (SELECT symbol, seq, seq * 3 AS first_id, seq * 3 + 2 AS final_id FROM tape), s AS (SELECT symbol, quantile_disc(final_id, 0.5) AS last_id FROM d GROUP BY symbol)", "SELECT d.symbol, d.seq FROM d JOIN s USING (symbol) WHERE final_id > last_id AND seq >= (SELECT min(seq) FROM d x WHERE x.symbol = d.symbol AND x.first_id <= s.last_id + 1 AND x.final_id >= s.last_id + 1)", "symbol seq", ""))
def align_to_snapshot(spark, sf_dir):
    """The diffs after a snapshot in the middle; only symbols whose next diff follows at once are continued."""
    d = tape(spark, sf_dir).select("symbol", "seq", (F.col("seq") * 3).alias("first_id"), (F.col("seq") * 3 + 2).alias("final_id"))
    s = d.groupBy("symbol").agg(F.expr("cast(percentile_disc(0.5) within group (order by final_id) as long)").alias("last_id"))
    return K.align_to_snapshot(d, s).select("symbol", "seq")


@query("variance_inflation", sql(BARS_SQL, "SELECT unnest(['close', 'volume']) AS feature, 1 / (1 - pow(corr(close, volume), 2)) AS vif FROM bars", "feature", "vif"))
def variance_inflation(spark, sf_dir):
    found = P.variance_inflation(S.pair_correlations(bars(spark, sf_dir), ["close", "volume"]), ["close", "volume"])
    return rounded(spark.createDataFrame(list(found.items()), "feature string, vif double"))


@query("class_curves", sql(TAPE_SQL + """, s AS (SELECT symbol, user_id % 3 AS y, qty / 101.0 AS a FROM tape), l AS (SELECT symbol, y, unnest([0, 1, 2]) AS k, unnest([(1 - a) * (1 - a), 2 * a * (1 - a), a * a]) AS score FROM s),
 d AS (SELECT symbol, k::VARCHAR AS curve, score, (y = k)::INT AS hit FROM l UNION ALL SELECT symbol, 'micro', score, (y = k)::INT FROM l), c AS (SELECT symbol, curve, score, sum(hit) AS hits, count(*) AS n FROM d GROUP BY ALL),
 k AS (SELECT *, sum(hits) OVER w AS tp, sum(n) OVER w AS said FROM c WINDOW w AS (PARTITION BY symbol, curve ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
 r AS (SELECT symbol, curve, sum((n - hits) * (tp - hits / 2.0)) / (sum(hits) * sum(n - hits)) AS auc, sum(hits * tp / said) / sum(hits) AS ap FROM k GROUP BY ALL)""",
    "SELECT * FROM r UNION ALL SELECT symbol, 'macro', avg(auc), avg(ap) FROM r WHERE curve <> 'micro' GROUP BY symbol", "symbol curve", "auc ap"))
def class_curves(spark, sf_dir):
    """Three classes, one against the rest, micro and macro."""
    a = F.col("qty") / 101.0
    t = tape(spark, sf_dir).select("symbol", (F.col("user_id") % 3).alias("y"), ((1 - a) * (1 - a)).alias("p0"), (2 * a * (1 - a)).alias("p1"), (a * a).alias("p2"))
    return rounded(R.curve_areas(t, ["symbol"], "y", ["p0", "p1", "p2"]))


@query("fold_components")
def fold_components(spark, sf_dir):
    """Shares of the first four components of the embeddings in five folds (checked against numpy in the tests)."""
    names = [f"d{k}" for k in range(64)]
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)])
    models = C.fit_folds(e, names, V.blocks(e, "vec_id", 5), "vec_id", 4, embargo=10)
    return rounded(C.component_tables(spark, models, names)[0])


@query("feature_table", sql(BARS_SQL, "SELECT symbol, bar, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar DESC) AS i FROM bars) WHERE i <= 24", "symbol bar", "close"))
def feature_table(spark, sf_dir):
    """Bars appended in three overlapping versions, the second made a base; of each symbol the last day is given out."""
    b = bars(spark, sf_dir).select("symbol", "bar", "close")
    store = FeatureTable(spark, new_dir(spark, "features"), on="bar", most=24)
    late = F.pmod(F.floor(F.col("bar") / HOUR), F.lit(3))
    store.append(b.where(late <= 1).withColumn("close", F.when(late == 1, -1.0).otherwise(F.col("close"))))
    store.append(b.where(late >= 1))
    store.compact()
    store.append(b.where(late == 0))
    return rounded(store.rows())


@query("average_precision", sql(TAPE_SQL + ", c AS (SELECT symbol, qty, sum(is_buyer_maker::INT) AS pos, count(*) AS n FROM tape GROUP BY ALL), k AS (SELECT *, sum(pos) OVER w / sum(n) OVER w AS pr FROM c WINDOW w AS (PARTITION BY symbol ORDER BY qty DESC ROWS UNBOUNDED PRECEDING))", "SELECT symbol, sum(pos * pr) / sum(pos) AS ap FROM k GROUP BY symbol", "symbol", "ap"))
def average_precision(spark, sf_dir):
    return rounded(P.average_precision(tape(spark, sf_dir).select("symbol", F.col("qty").alias("score"), F.col("is_buyer_maker").cast("int").alias("y")), ["symbol"]))


@query("linkage_clusters")
def linkage_clusters(spark, sf_dir):
    """Average-linkage clusters of the 64 dimensions (checked against a plain loop in the tests)."""
    found = P.linkage_clusters(_pairs(spark, sf_dir), [f"d{k}" for k in range(64)], 1.4)
    return spark.createDataFrame(list(found.items()), "item string, cluster int")


@query("msm_clusters")
def msm_clusters(spark, sf_dir):
    """Clusters of the symbols' daily means by move-split-merge distance, from the first and last series (checked in the tests)."""
    daily = tape(spark, sf_dir).groupBy("symbol", F.floor(F.col("ts_ms") / DAY).alias("day")).agg(F.avg("price").alias("v"))
    series = daily.groupBy(F.col("symbol").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda p: p.v).alias("x"))
    ends = series.agg(F.min_by("x", "id").alias("a"), F.max_by("x", "id").alias("b")).first()
    return rounded(P.msm_clusters(series, [ends.a, ends.b])[0])


@query("principal_components")
def principal_components(spark, sf_dir):
    """The share of variance of each of the first four components (checked against numpy in the tests)."""
    names = [f"d{k}" for k in range(64)]
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)])
    shares = P.principal_components(e, names, 4, ["vec_id"])[1]
    return rounded(spark.createDataFrame(list(enumerate(shares)), "component int, share double"))


@query("bars_from_lines", sql(TAPE_SQL, """SELECT symbol, ts_ms // 3600000 * 3600000 AS bar, count(*) AS trade_count, sum(qty) AS trade_volume, sum(price * qty) / sum(qty) AS vwap, arg_min(price, seq) AS first_price, arg_max(price, seq) AS last_price,
 coalesce(sum(CASE WHEN is_buyer_maker THEN qty END), 0) AS sell_volume, bool_or(seq % 10 = 0) AS missing_ts, max(recv_ms) AS last_recv_ms FROM tape GROUP BY ALL""", "symbol bar trade_count missing_ts last_recv_ms", "trade_volume vwap first_price last_price sell_volume"))
def bars_from_lines(spark, sf_dir):
    """From JSON lines to bars: the tape is written as raw lines (a tenth without a time of its own), read back, put in order and aggregated."""
    t = tape(spark, sf_dir)
    data = F.struct(F.col("symbol").alias("s"), F.col("ts_ms").alias("E"), F.when(F.col("seq") % 10 > 0, F.col("ts_ms")).alias("T"), F.col("price").cast("string").alias("p"), F.col("qty").cast("string").alias("q"), F.col("seq").alias("a"), F.col("is_buyer_maker").alias("m"))
    lines = t.select(F.to_json(F.struct(F.lit("trade").alias("type"), F.col("symbol"), (F.col("recv_ms") / 1000.0).cast("decimal(16,3)").alias("recv_ts"), F.struct(data.alias("data")).alias("msg"))).alias("value"))
    folder = new_dir(spark, "lines")
    lines.repartition(4).write.text(folder)
    back = records.in_order(records.trade_lines(spark, folder, glob="*.txt"))
    out = B.trade_bars(back, "1h")
    return rounded(out.select("symbol", F.col("bar_open_ms").alias("bar"), "trade_count", "trade_volume", "vwap", "first_price", "last_price", "sell_volume", "missing_ts", "last_recv_ms"))
