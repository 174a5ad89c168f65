"""Queries over reports, set operations, lookups and slow series."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import joins as J
from ..operators import levels as X
from ..operators import ranks as R
from ..operators import search as G
from ..operators import selection as P
from ..operators import tables as T
from ..operators import windows as N
from .adapters import BARS_SQL, HOUR, TAPE_SQL, bars, rounded, sql, table, tape
from .research import BARRIER, CLUSTERS, _barrier, _clusters, _pairs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


@query("roc_points", sql(TAPE_SQL + ", s AS (SELECT least(floor(qty / 101.0 * 20 + 1e-9), 20)::INT AS b, is_buyer_maker::INT AS y FROM tape), g AS (SELECT t, (SELECT count(*) FILTER (b >= t) FROM s) AS said, (SELECT coalesce(sum(y) FILTER (b >= t), 0) FROM s) AS tp, (SELECT sum(y) FROM s) AS p, (SELECT count(*) FROM s) AS n FROM range(21) r(t))",
    "SELECT t / 20.0 AS threshold, tp / p AS tpr, (said - tp) / (n - p) AS fpr, tp / nullif(said, 0) AS precision FROM g", "", "threshold tpr fpr precision"))
def roc_points(spark, sf_dir):
    t = tape(spark, sf_dir).select((F.col("qty") / 101.0).alias("score"), F.col("is_buyer_maker").cast("int").alias("y"))
    return rounded(P.roc_points(t, 21))


@query("silhouette", sql(CLUSTERS + ", mm AS (SELECT a, x.cluster AS ca, y.cluster AS cb, avg(d) AS d FROM bo JOIN cl x ON x.item = bo.a JOIN cl y ON y.item = bo.b GROUP BY ALL), so AS (SELECT a AS item, max(d) FILTER (ca = cb) AS own, min(d) FILTER (ca <> cb) AS other FROM mm GROUP BY a)", "SELECT item, CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END AS s FROM so", "item", "s"))
def silhouette(spark, sf_dir):
    return rounded(P.silhouette(_pairs(spark, sf_dir), _clusters(spark)))


@query("decile_returns", sql(BARS_SQL + ", r AS (SELECT symbol, (rank() OVER (PARTITION BY symbol ORDER BY close) + (count(*) OVER (PARTITION BY symbol, close) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol) AS rk, lead(close) OVER (PARTITION BY symbol ORDER BY bar) - close AS ret FROM bars)",
    "SELECT symbol, avg(CASE WHEN rk >= 0.8 THEN ret WHEN rk <= 0.2 THEN -ret ELSE 0 END / 2) * 96 * 365 AS yearly, count(*) FILTER (rk >= 0.8) AS longs, count(*) FILTER (rk <= 0.2) AS shorts FROM r WHERE ret IS NOT NULL GROUP BY symbol", "symbol longs shorts", "yearly"))
def decile_returns(spark, sf_dir):
    w = N.series(["symbol"], "bar")
    b = R.with_pct_rank(bars(spark, sf_dir).select("symbol", "close", (F.lead("close").over(w) - F.col("close")).alias("ret")), ["symbol"], "close", "rk")
    return rounded(P.decile_returns(b, ["symbol"], "rk", "ret"))


@query("side_normalise", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 WHEN 'error' THEN CASE WHEN value > 50 THEN 1 WHEN value < 50 THEN -1 END END AS side FROM events")
def side_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "click", " Long").when(F.col("event_type") == "view", "sell").when(F.col("event_type") == "error", (F.col("value") - 50).cast("string")).otherwise("?")
    return e.select("event_id", P.side_of(text).alias("side"))


@query("order_sizing", sql(TAPE_SQL, "SELECT seq, qty * 10 AS notional, qty * 10 / nullif(price, 0) AS quantity, CASE WHEN qty * 10 < 50 THEN 'below_min_notional' WHEN qty * 10 > 900 THEN 'above_max_notional' WHEN price / 10 > 8 THEN 'slippage' WHEN user_id % 10 >= 8 THEN 'open_orders' END AS rejected FROM tape", "seq rejected", "notional quantity"))
def order_sizing(spark, sf_dir):
    t = tape(spark, sf_dir)
    return rounded(t.select("seq", *P.order_size(F.col("qty"), F.lit(10.0), F.col("price"), 50.0, 900.0, F.col("price") / 10, 8.0, F.col("user_id") % 10, 8)))


@query("purged_months", """WITH m AS (SELECT *, ntile(5) OVER (ORDER BY month) - 1 AS fold FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS month FROM orders))
SELECT fold::INT AS fold, epoch_ms(max(month)) AS test_start, epoch_ms(max(month) + INTERVAL 1 MONTH) AS test_end, epoch_ms(max(month)) - 86400000 AS train_before, epoch_ms(max(month) + INTERVAL 1 MONTH) + 86400000 AS train_from FROM m GROUP BY fold""")
def purged_months(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("t"))
    f = P.purged_months(o, "t", 5, 24 * HOUR)
    return f.withColumn("fold", F.col("fold").cast("int"))


@query("folds_long_enough", """WITH m AS (SELECT *, ntile(5) OVER (ORDER BY month) - 1 AS fold FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS month FROM orders)),
f AS (SELECT fold::INT AS fold, epoch_ms(max(month)) AS test_start, epoch_ms(max(month) + INTERVAL 1 MONTH) AS test_end, epoch_ms(max(month)) - 86400000 AS train_before, epoch_ms(max(month) + INTERVAL 1 MONTH) + 86400000 AS train_from FROM m GROUP BY fold)
SELECT f.* FROM f WHERE (SELECT max(t // 86400000) - min(t // 86400000) + 1 FROM (SELECT epoch_ms(o_orderdate) AS t FROM orders) o WHERE t < train_before OR t >= train_from) >= 2404""")
def folds_long_enough(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("t"))
    f = P.purged_months(o, "t", 5, 24 * HOUR)
    return P.long_enough(o, "t", f, 2404).withColumn("fold", F.col("fold").cast("int"))


@query("order_margin", sql(TAPE_SQL, "SELECT seq, qty * 10 AS notional, CASE WHEN qty * 10 < 50 THEN 'below_min_notional' WHEN qty * 10 > 900 THEN 'above_max_notional' WHEN qty * 1.05 > price THEN 'margin' END AS rejected FROM tape", "seq rejected", "notional"))
def order_margin(spark, sf_dir):
    """Sizing with ten times leverage against the price as free cash."""
    t = tape(spark, sf_dir)
    return rounded(t.select("seq", *P.order_size(F.col("qty"), F.lit(10.0), F.col("price"), 50.0, 900.0, F.lit(0.0), 8.0, F.lit(0), 8, free=F.col("price"))).drop("quantity"))


@query("vote_backtest")
def vote_backtest(spark, sf_dir):
    """One position at a time over the labelled events (checked against a straight loop in the tests)."""
    return rounded(P.vote_backtest(bars(spark, sf_dir), _barrier(spark, sf_dir), ["symbol"], "bar"))


@query("msm_distances")
def msm_distances(spark, sf_dir):
    """Move-split-merge distances of all pairs of daily series (checked against the plain recurrence in the tests)."""
    daily = tape(spark, sf_dir).groupBy("symbol", F.floor(F.col("ts_ms") / 86_400_000).alias("day")).agg(F.avg("price").alias("v"))
    series = daily.groupBy(F.col("symbol").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda p: p.v).alias("x"))
    return rounded(P.msm_pairs(series))


@query("slow_series_merge", sql(BARS_SQL + ", d AS (SELECT ts_ms // 86400000 * 86400000 AS day, avg(price) AS fng FROM tape WHERE ts_ms // 86400000 % 3 <> 0 GROUP BY ALL)", "SELECT b.symbol, b.bar, d.fng FROM bars b ASOF LEFT JOIN d ON b.bar >= d.day", "symbol bar", "fng"))
def slow_series_merge(spark, sf_dir):
    """A daily series spread over the hours until the next value: the spine is made of the days alone, then an equi-join."""
    t = tape(spark, sf_dir)
    daily = t.where("floor(ts_ms / 86400000) % 3 <> 0").groupBy((F.floor(F.col("ts_ms") / 86_400_000) * 86_400_000).alias("bar")).agg(F.avg("price").alias("fng"))
    return rounded(T.spread_slow(bars(spark, sf_dir).select("symbol", "bar"), daily, "bar", "fng").select("symbol", "bar", "fng"))


EVENTS = BARS_SQL + """, ev AS (SELECT symbol, ts_ms // 3600000 * 3600000 AS t0, ts_ms, CASE WHEN seq % 3 = 0 THEN -1 ELSE 1 END AS side, CASE WHEN seq % 5 > 0 THEN (seq % 4 // 2)::INT END AS label, ts_ms // 3600000 * 3600000 + seq % 7 * 3600000 AS t1 FROM tape),
ex AS (SELECT symbol, t0, side, label, max(t1) AS t1 FROM ev WHERE label IS NOT NULL GROUP BY ALL)"""


def _label_sql(order: str, side: int) -> str:
    return sql(EVENTS, f"SELECT b.symbol, b.bar AS ts, o.side, o.label, o.t1 FROM bars b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY symbol, t0 ORDER BY {order}) AS k FROM ex WHERE side = {side}) o ON o.symbol = b.symbol AND o.t0 = b.bar AND o.k = 1", "symbol ts side label t1", "")


def _label_events(spark, sf_dir, exact: bool = True):
    hour = (F.floor(F.col("ts_ms") / HOUR) * HOUR).cast("long")
    seq = F.col("seq")
    return tape(spark, sf_dir).select("symbol", (hour if exact else F.col("ts_ms")).alias("t0"), F.when(seq % 3 == 0, -1).otherwise(1).alias("side"), F.when(seq % 5 > 0, F.floor(seq % 4 / 2).cast("int")).alias("label"), (hour + seq % 7 * HOUR).alias("t1"))


def _labelled(spark, sf_dir, policy: str, sides: str):
    b = bars(spark, sf_dir).select("symbol", F.col("bar").alias("ts"))
    return J.attach_labels(b, _label_events(spark, sf_dir), policy, sides)


@query("attach_labels", _label_sql("label, t1", 1))
def attach_labels(spark, sf_dir):
    """Several events of both sides at one time, some without label: failures come first."""
    return _labelled(spark, sf_dir, "prefer_fail", "long")


@query("attach_labels_win", _label_sql("label DESC, t1 DESC", -1))
def attach_labels_win(spark, sf_dir):
    return _labelled(spark, sf_dir, "prefer_win", "short")


@query("attach_labels_earliest", _label_sql("t1, label", 1))
def attach_labels_earliest(spark, sf_dir):
    return _labelled(spark, sf_dir, "earliest_t1", "long")


@query("attach_labels_latest", _label_sql("t1 DESC, label DESC", 1))
def attach_labels_latest(spark, sf_dir):
    return _labelled(spark, sf_dir, "latest_t1", "long")


@query("attach_labels_pad", sql(EVENTS, "SELECT b.symbol, b.bar AS ts, o.label FROM bars b LEFT JOIN (SELECT symbol, t0, arg_max(label, ts_ms) AS label FROM ev WHERE side = 1 AND label IS NOT NULL GROUP BY ALL) o ON o.symbol = b.symbol AND o.t0 = b.bar", "symbol ts label", ""))
def attach_labels_pad(spark, sf_dir):
    """Events off the grid go to the bar before; the last one of a bar counts."""
    b = bars(spark, sf_dir).select("symbol", F.col("bar").alias("ts"))
    return J.attach_labels(b, _label_events(spark, sf_dir, exact=False), sides="long", align_by="pad").select("symbol", "ts", "label")


@query("lookup_chain", """SELECT s_suppkey, coalesce(c.n_nationkey, -1) AS nation, coalesce(n.n_regionkey, -1) AS region, coalesce(r.place, -1) AS place FROM supplier LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 > 0) c ON c.n_nationkey = s_nationkey
LEFT JOIN (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey % 2 = 0) n ON n.n_nationkey = c.n_nationkey LEFT JOIN (SELECT r_regionkey, r_regionkey * 10 AS place FROM region WHERE r_regionkey < 4) r ON r.r_regionkey = n.n_regionkey""")
def lookup_chain(spark, sf_dir):
    """Three maps in a row, each with holes: what is absent is -1 from there on."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    maps = [
        (n.where("n_nationkey % 5 > 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_nationkey").alias("nation")), "s_nationkey", "nation"),
        (n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")), "nation", "region"),
        (r.where("r_regionkey < 4").select(F.col("r_regionkey").alias("region"), (F.col("r_regionkey") * 10).alias("place")), "region", "place"),
    ]
    return J.chain(s, maps, F.lit(-1)).select("s_suppkey", "nation", "region", "place")


@query("set_operations", sql(TAPE_SQL + ", a AS (SELECT DISTINCT user_id FROM tape WHERE symbol = 'click' AND qty > 90), b AS (SELECT DISTINCT user_id FROM tape WHERE symbol = 'view' AND qty > 90)", "SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)", "op n", ""))
def set_operations(spark, sf_dir):
    t = tape(spark, sf_dir)
    a, b = (t.where(f"symbol = '{s}' and qty > 90").select("user_id").distinct() for s in ("click", "view"))
    return T.set_counts({"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)})


@query("grid_pivot", sql("g AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS q FROM lineitem GROUP BY ALL)", "SELECT l_returnflag, max(q) FILTER (l_linestatus = 'F') AS \"F\", max(q) FILTER (l_linestatus = 'O') AS \"O\" FROM g GROUP BY l_returnflag", "l_returnflag", "F O"))
def grid_pivot(spark, sf_dir):
    return rounded(T.grid_pivot(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], "l_quantity"))


@query("label_counts", "SELECT v.label, coalesce(n, 0) AS n FROM (VALUES (0), (1), (2)) v(label) LEFT JOIN (SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1) USING (label)")
def label_counts(spark, sf_dir):
    return T.label_counts(table(spark, sf_dir, "labels"), "quality", (0, 1, 2))


@query("top_k_pairs", sql(CLUSTERS, "SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM bo) WHERE k <= 2", "a b", ""))
def top_k_pairs(spark, sf_dir):
    return T.nearest(_pairs(spark, sf_dir), 2)


@query("top_k_pairs_all", SQL["top_k_pairs"])
def top_k_pairs_all(spark, sf_dir):
    return top_k_pairs(spark, sf_dir)


@query("fold_summary", sql(BARS_SQL + ", f AS (SELECT symbol, bar, ntile(5) OVER (ORDER BY bar, symbol) AS fold, close FROM bars), m AS (SELECT symbol, fold, avg(close) AS x FROM f GROUP BY ALL)", "SELECT symbol, avg(x) AS mean, stddev_pop(x) AS std FROM m GROUP BY symbol", "symbol", "mean std"))
def fold_summary(spark, sf_dir):
    """Mean and deviation of a metric over folds; rows are numbered by counts of bars first, not by one global sort."""
    b = bars(spark, sf_dir).select("symbol", "bar", "close")
    per = b.groupBy("bar").agg(F.count(F.lit(1)).alias("n"))
    base = per.withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("bar").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each bar time
    total = F.broadcast(per.agg(F.sum("n").alias("total")))
    rows = b.join(base, "bar").withColumn("i", F.col("base") + F.row_number().over(W.partitionBy("bar").orderBy("symbol")) - 1).crossJoin(total)
    size, extra = F.floor(F.col("total") / 5), F.col("total") % 5
    fold = F.when(F.col("i") < extra * (size + 1), F.floor(F.col("i") / (size + 1))).otherwise(extra + F.floor((F.col("i") - extra * (size + 1)) / size))
    return rounded(T.fold_summary(rows.withColumn("fold", fold), ["symbol"], "fold", "close"))


RIDGE = BARS_SQL + """,
rr AS (SELECT symbol, bar, close - open AS x1, volume AS x2, lead(close) OVER (PARTITION BY symbol ORDER BY bar) - close AS y FROM bars),
rn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS i, ntile(5) OVER (PARTITION BY symbol ORDER BY bar) - 1 AS fold, count(*) OVER (PARTITION BY symbol) AS n FROM rr WHERE y IS NOT NULL),
sp AS (SELECT symbol, fold, min(i) - (n * 0.01)::INT AS lo, max(i) + floor(n * 0.01) AS hi FROM (SELECT * FROM rn) GROUP BY symbol, fold, n),
mo AS (SELECT s.symbol, s.fold, count(*) AS k, avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, covar_pop(x1, x2) AS c12 FROM sp s JOIN rn r ON r.symbol = s.symbol AND (r.i < s.lo OR r.i > s.hi) GROUP BY s.symbol, s.fold),
sv AS (SELECT *, k + 10.0 AS p, k * c12 / (s1 * s2) AS q, k * c1 / s1 AS g1, k * c2 / s2 AS g2 FROM mo),
w AS (SELECT *, (p * g1 - q * g2) / (p * p - q * q) / s1 AS w1, (p * g2 - q * g1) / (p * p - q * q) / s2 AS w2 FROM sv),
rp AS (SELECT r.symbol, r.bar, r.fold::INT AS fold, r.y, ay + w1 * (x1 - a1) + w2 * (x2 - a2) AS pred FROM rn r JOIN w USING (symbol, fold))""".replace("(n * 0.01)::INT", "floor(n * 0.01)")


def _ridge(spark, sf_dir):
    ahead = bars(spark, sf_dir).select("symbol", "bar", (F.col("close") - F.col("open")).alias("x1"), F.col("volume").alias("x2"), (F.lead("close").over(N.series(["symbol"], "bar")) - F.col("close")).alias("y"))
    return P.ridge_predictions(ahead, ["x1", "x2"], "y", "bar", 5, by=["symbol"])


@query("ridge_predictions", sql(RIDGE, "SELECT * FROM rp", "symbol bar fold", "y pred"))
def ridge_predictions(spark, sf_dir):
    """Every symbol fitted on its own."""
    return rounded(_ridge(spark, sf_dir).select("symbol", "bar", "fold", "y", "pred"))


@query("ridge_backtest", sql(RIDGE, "SELECT symbol, count(*) AS n, avg(sign(pred) * y) AS mean, avg(sign(pred) * y) / (stddev_pop(sign(pred) * y) + 1e-9) * sqrt(96 * 365) AS sharpe FROM rp GROUP BY symbol", "symbol n", "mean sharpe"))
def ridge_backtest(spark, sf_dir):
    return rounded(P.sign_report(_ridge(spark, sf_dir), "y", by=["symbol"]))


@query("ridge_predictions_all", SQL["ridge_predictions"])
def ridge_predictions_all(spark, sf_dir):
    return ridge_predictions(spark, sf_dir)


@query("ridge_backtest_all", SQL["ridge_backtest"])
def ridge_backtest_all(spark, sf_dir):
    return ridge_backtest(spark, sf_dir)


@query("level_signals")
def level_signals(spark, sf_dir):
    """Signals of flipped levels on hourly bars (checked against a plain loop in the tests)."""
    return rounded(X.level_signals(bars(spark, sf_dir), "symbol", "bar", HOUR, X.Rules(lookback=10)))


@query("alpha_search")
def alpha_search(spark, sf_dir):
    """The best expressions of a short genetic search; each generation is one job (checked in the tests)."""
    w = N.series(["symbol"], "bar")
    b = bars(spark, sf_dir).withColumn("target", F.lead("close").over(w) / F.when(F.col("close") > 0, F.col("close")) - 1)
    found = G.evolve(b, ["open", "close", "volume"], "target", ["symbol"], "bar", size=8, generations=2, depth=2, elite=2)
    return spark.createDataFrame([(k, repr(t), s) for k, (t, s) in enumerate(found)], "place int, tree string, score double")
