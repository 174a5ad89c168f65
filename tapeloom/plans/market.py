"""Queries over trades, bars, books and joins in time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import bartime, numeric
from ..operators import bars as B
from ..operators import book as K
from ..operators import joins as J
from ..operators import ranks as R
from ..operators import windows as N
from .adapters import BARS_SQL, BOOKS_SQL, HOUR, TAPE_SQL, bars, books, rounded, shuffled_tape, sql, table, tape

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


FLOW = """SELECT symbol, '1h' AS bar_interval, bar AS bar_open_ms, bar + 3599999 AS bar_close_ms, count(*) AS trade_count, sum(qty) AS trade_volume, sum(price*qty) AS trade_notional,
  coalesce(sum(CASE WHEN NOT is_buyer_maker THEN qty END), 0) AS buy_volume, coalesce(sum(CASE WHEN is_buyer_maker THEN qty END), 0) AS sell_volume,
  coalesce(sum(CASE WHEN NOT is_buyer_maker THEN qty*price END), 0) AS buy_notional, coalesce(sum(CASE WHEN is_buyer_maker THEN qty*price END), 0) AS sell_notional,
  buy_volume - sell_volume AS signed_volume, (buy_volume - sell_volume) / (buy_volume + sell_volume + 1e-12) AS volume_imbalance, sum(price*qty)/sum(qty) AS vwap,
  arg_min(price, seq) AS first_price, arg_max(price, seq) AS last_price, max(price) AS high_price, min(price) AS low_price,
  CASE WHEN first_price > 0 THEN last_price / first_price - 1 END AS trade_return, bool_or(qty <= 0) AS has_nonpositive_qty, bool_or(price <= 0) AS has_nonpositive_price, false AS missing_ts, 0 AS late_trade_count, max(recv_ms) AS last_recv_ms, bool_or(ts_ms < before) AS out_of_order,
 strftime(make_timestamp((bar + 28800000) * 1000), '%Y-%m-%d %H:%M:%S') AS bar_open_local, strftime(make_timestamp((bar + 28800000 + 3599000) * 1000), '%Y-%m-%d %H:%M:%S') AS bar_close_local
FROM (SELECT *, ts_ms // 3600000 * 3600000 AS bar, coalesce(lag(ts_ms) OVER (PARTITION BY symbol, ts_ms // 3600000 ORDER BY seq), ts_ms) AS before FROM tape) GROUP BY symbol, bar"""
_FLOW_DOUBLES = "trade_volume trade_notional buy_volume sell_volume buy_notional sell_notional signed_volume volume_imbalance vwap first_price last_price high_price low_price trade_return"


@query("trade_bars_1h", sql(TAPE_SQL, FLOW, "symbol bar_interval bar_open_ms bar_close_ms bar_open_local bar_close_local trade_count has_nonpositive_qty has_nonpositive_price out_of_order missing_ts late_trade_count last_recv_ms", _FLOW_DOUBLES))
def trade_bars_1h(spark, sf_dir):
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("bar_open_local", "bar_close_local")}
    return rounded(B.trade_bars(tape(spark, sf_dir), "1h")).withColumns(shown)


@query("closed_bars_1h", sql(TAPE_SQL, "SELECT symbol, bar, count(*) AS trade_count, sum(qty) AS trade_volume FROM (SELECT *, ts_ms // 3600000 * 3600000 AS bar, max(ts_ms // 3600000 * 3600000) OVER (PARTITION BY symbol) AS newest FROM tape) WHERE bar < newest GROUP BY ALL", "symbol bar trade_count", "trade_volume"))
def closed_bars_1h(spark, sf_dir):
    """Without a flush at the end: the bar still open is not there."""
    out = B.trade_bars(tape(spark, sf_dir), "1h", calculators=(B.base_stats,), flush=False)
    return rounded(out.select("symbol", F.col("bar_open_ms").alias("bar"), "trade_count", "trade_volume"))


LATE = TAPE_SQL + """,
s AS (SELECT symbol, seq * 10 + CASE WHEN seq % 7 = 3 THEN 401 ELSE 0 END AS seq, CASE WHEN seq % 50 = 9 THEN 0 ELSE ts_ms END AS ts_ms, CASE WHEN seq % 100 = 9 THEN ts_ms END AS fb, price, qty FROM tape),
r AS (SELECT *, NOT ts_ms > 0 AS miss, CASE WHEN ts_ms > 0 THEN ts_ms ELSE coalesce(fb, 0) END AS rt FROM s),
b AS (SELECT *, CASE WHEN rt > 0 THEN rt // 900000 * 900000 END AS bar FROM r),
p AS (SELECT *, max(bar) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b),
c AS (SELECT *, CASE WHEN bar IS NULL THEN 'bad' WHEN prev IS NOT NULL AND bar < prev THEN 'late' ELSE 'ok' END AS kind,
      CASE WHEN bar IS NULL THEN prev ELSE greatest(bar, coalesce(prev, bar)) END AS owner FROM p),
o AS (SELECT *, kind = 'late' OR (kind = 'ok' AND NOT miss AND coalesce(ts_ms < last_value(CASE WHEN kind = 'ok' AND ts_ms > 0 THEN ts_ms END IGNORE NULLS) OVER (PARTITION BY symbol, owner ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS disordered FROM c)"""


@query("late_events_15m", sql(LATE, "SELECT symbol, owner AS bar_open_ms, count(*) FILTER (kind = 'ok') AS trade_count, sum(qty) FILTER (kind = 'ok') AS trade_volume, count(*) FILTER (kind = 'late') AS late_trade_count, bool_or(miss) AS missing_ts, bool_or(disordered) AS out_of_order FROM o WHERE owner IS NOT NULL GROUP BY ALL", "symbol bar_open_ms trade_count late_trade_count missing_ts out_of_order", "trade_volume"))
def late_events_15m(spark, sf_dir):
    return rounded(B.trade_bars(shuffled_tape(spark, sf_dir), "15m").select("symbol", "bar_open_ms", "trade_count", "trade_volume", "late_trade_count", "missing_ts", "out_of_order"))


@query("late_events_cells", SQL["late_events_15m"])
def late_events_cells(spark, sf_dir):
    """The same with cells of 500 arrivals, so that each symbol is many tasks."""
    rows = B.classify(shuffled_tape(spark, sf_dir), "15m", cell=500).where("owner is not null")
    found = {k: v for c in (B.base_stats, B.quality) for k, v in c(F.col("kind") == "ok").items()}
    return rounded(rows.groupBy("symbol", F.col("owner").alias("bar_open_ms")).agg(*[found[k].alias(k) for k in ("trade_count", "trade_volume", "late_trade_count", "missing_ts", "out_of_order")]))


@query("bar_time_rules", """WITH t AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000 + 28800000 AS loc FROM events)
SELECT event_id, ms // 60000 * 60000 AS open_1m, ms // 21600000 * 21600000 AS open_6h, loc // 86400000 * 86400000 - 28800000 AS open_1d,
 loc // 86400000 // 3 * 3 * 86400000 - 28800000 AS open_3d, ((loc // 86400000 + 3) // 7 * 7 - 3) * 86400000 - 28800000 AS open_1w,
 epoch_ms(date_trunc('month', make_timestamp(loc * 1000))::TIMESTAMP) - 28800000 AS "open_1M",
 loc // 86400000 * 86400000 - 28800000 + 86399999 AS close_1d, epoch_ms((date_trunc('month', make_timestamp(loc * 1000)) + INTERVAL 1 MONTH)::TIMESTAMP) - 28800001 AS "close_1M" FROM t""")
def bar_time_rules(spark, sf_dir):
    """Minutes are m and months M, so its result is a table only where case tells columns apart, when it is written and when it is read (a setting of the session)."""
    spark.conf.set("spark.sql.caseSensitive", "true")
    ms = bartime.ms_of(F.col("ts"))
    opens = [bartime.bar_open_ms(ms, i).alias(f"open_{i}") for i in ("1m", "6h", "1d", "3d", "1w", "1M")]
    closes = [bartime.bar_close_ms(bartime.bar_open_ms(ms, i), i).alias(f"close_{i}") for i in ("1d", "1M")]
    return table(spark, sf_dir, "events").select("event_id", *opens, *closes)


STATS = """SELECT symbol, ts_ms // 3600000 * 3600000 AS bar, avg(price) AS price_mean, max(price) AS price_max, min(price) AS price_min, stddev_pop(price) AS price_std, max(price) - min(price) AS price_range,
 sum(price*qty)/sum(qty) AS vwap, count(*) AS trade_count, sum(qty) AS qty_sum, avg(qty) AS qty_mean, max(qty) AS qty_max, stddev_pop(qty) AS qty_std, sum(price*qty) AS quote_sum,
 coalesce(sum(CASE WHEN NOT is_buyer_maker THEN qty END), 0) AS buy_qty, coalesce(sum(CASE WHEN is_buyer_maker THEN qty END), 0) AS sell_qty, count(*) FILTER (NOT is_buyer_maker) AS buy_count, count(*) FILTER (is_buyer_maker) AS sell_count,
 buy_qty / nullif(buy_qty + sell_qty, 0) AS buy_ratio, buy_count / nullif(buy_count + sell_count, 0) AS buy_count_ratio, (buy_qty - sell_qty) / nullif(buy_qty + sell_qty, 0) AS imbalance, stddev_pop(price) / nullif(sum(price*qty)/sum(qty), 0) AS volatility_proxy,
 CASE WHEN count(*) >= 3 THEN CASE WHEN var_pop(qty) > 0 THEN skewness(qty) ELSE 0 END END AS qty_skew, CASE WHEN count(*) >= 4 THEN CASE WHEN var_pop(qty) > 0 THEN kurtosis(qty) ELSE 0 END END AS qty_kurt
FROM tape GROUP BY 1, 2"""


@query("minute_stats_1h", sql(TAPE_SQL, STATS, "symbol bar trade_count buy_count sell_count", "qty_skew qty_kurt price_mean price_max price_min price_std price_range vwap qty_sum qty_mean qty_max qty_std quote_sum buy_qty sell_qty buy_ratio buy_count_ratio imbalance volatility_proxy"))
def minute_stats_1h(spark, sf_dir):
    return rounded(B.minute_stats(tape(spark, sf_dir), 60))


@query("sample_moments_1d", sql(TAPE_SQL, """SELECT symbol, ts_ms // 86400000 * 86400000 AS bar, count(*) AS n,
 CASE WHEN count(*) >= 3 THEN CASE WHEN var_pop(qty) > 0 THEN skewness(qty) ELSE 0 END END AS qty_skew, CASE WHEN count(*) >= 4 THEN CASE WHEN var_pop(qty) > 0 THEN kurtosis(qty) ELSE 0 END END AS qty_kurt FROM tape GROUP BY 1, 2""", "symbol bar n", "qty_skew qty_kurt"))
def sample_moments_1d(spark, sf_dir):
    return rounded(B.minute_stats(tape(spark, sf_dir), 1440).select("symbol", "bar", F.col("trade_count").alias("n"), "qty_skew", "qty_kurt"))


@query("path_stats_1h", sql(TAPE_SQL + """, g AS (SELECT *, ts_ms // 3600000 * 3600000 AS bar, ln(price / lag(price) OVER w) AS r, (ts_ms - lag(ts_ms) OVER w) / 1000.0 AS gap FROM tape WHERE price > 0 AND qty > 0 WINDOW w AS (PARTITION BY symbol, ts_ms // 3600000 ORDER BY ts_ms, seq))""",
    "SELECT symbol, bar, sum(price*qty)/sum(qty) AS vwap, count(*) AS trade_count, coalesce(sum(CASE WHEN NOT is_buyer_maker THEN qty END), 0) AS buy_volume, coalesce(sum(CASE WHEN is_buyer_maker THEN qty END), 0) AS sell_volume, count(*) FILTER (NOT is_buyer_maker) AS buy_trades, count(*) FILTER (is_buyer_maker) AS sell_trades, coalesce(sum(r*r), 0) AS rv_var, max(price) - min(price) AS hl_range, avg(gap) AS mean_intertrade_time, max(gap) AS max_intertrade_time FROM g GROUP BY ALL", "symbol bar trade_count buy_trades sell_trades", "vwap buy_volume sell_volume rv_var hl_range mean_intertrade_time max_intertrade_time"))
def path_stats_1h(spark, sf_dir):
    return rounded(B.path_stats(tape(spark, sf_dir), 60))


@query("ohlcv_1h", sql(BARS_SQL, "SELECT * FROM bars", "symbol bar trades", "open high low close volume"))
def ohlcv_1h(spark, sf_dir):
    return rounded(bars(spark, sf_dir))


@query("full_grid_1h", sql(BARS_SQL, """SELECT g.symbol, g.bar, coalesce(trades, 0) AS trades, close FROM (SELECT symbol, unnest(range(min(bar), max(bar) + 1, 3600000)) AS bar FROM bars GROUP BY symbol) g LEFT JOIN bars b USING (symbol, bar)""", "symbol bar trades", "close"))
def full_grid_1h(spark, sf_dir):
    return rounded(B.full_grid(bars(spark, sf_dir).select("symbol", "bar", "trades", "close"), "1h", ("trades",)))


def _book_sql() -> tuple[str, str, str]:
    """The features of a snapshot in SQL, with the names of its plain and its rounded columns."""
    mid = "((asks[1].price + bids[1].price) / 2)"
    out = {
        "best_bid": "bids[1].price", "best_bid_qty": "bids[1].qty", "best_ask": "asks[1].price", "best_ask_qty": "asks[1].qty", "spread": "asks[1].price - bids[1].price", "mid": mid,
        "imbalance_l1": "CASE WHEN bids[1].qty + asks[1].qty = 0 THEN 0 ELSE (bids[1].qty - asks[1].qty) / (bids[1].qty + asks[1].qty) END",
        "microprice": "CASE WHEN bids[1].qty + asks[1].qty > 0 THEN (asks[1].price * bids[1].qty + bids[1].price * asks[1].qty) / (bids[1].qty + asks[1].qty) END",
    }
    total = lambda side, keep: f"CASE WHEN {mid} > 0 THEN coalesce(list_sum([x.qty FOR x IN {side}s IF {keep}]), 0) ELSE 0 END"
    for b in K.DEPTHS:
        out[f"depth_bid_{b}"], out[f"depth_ask_{b}"] = total("bid", f"x.price >= {mid} * (1 - {b} / 1e4)"), total("ask", f"x.price <= {mid} * (1 + {b} / 1e4)")
    for low, high in K.BINS:
        upper = "<=" if high == K.BINS[-1][1] else "<"
        for side, distance in (("bid", f"({mid} - x.price) / {mid} * 1e4"), ("ask", f"(x.price - {mid}) / {mid} * 1e4")):
            out[f"bin_{side}_{low}_{high}"] = total(side, f"{distance} >= {low} AND {distance} {upper} {high}")
    flags = {
        "flag_crossed": "bids[1].price >= asks[1].price", "flag_low_depth": "len(b) + len(a) < 20",
        "flag_bad_sorting": "[x.price FOR x IN bids] <> list_reverse_sort([x.price FOR x IN bids]) OR [x.price FOR x IN asks] <> list_sort([x.price FOR x IN asks])",
        "flag_nonpositive_qty": "len([x FOR x IN bids IF x.qty <= 0]) > 0 OR len([x FOR x IN asks IF x.qty <= 0]) > 0",
    }
    # some snapshots come with their bids the wrong way round, crossed, and with a quantity that is not positive
    source = """(SELECT symbol, bar, a, b, CASE WHEN bar // 3600000 % 7 = 3 THEN list_reverse(bids) ELSE bids END AS bids, [struct_pack(price := CASE WHEN bar // 3600000 % 11 = 5 THEN x.price - 60 ELSE x.price END, qty := CASE WHEN bar // 3600000 % 13 = 1 THEN x.qty - 20 ELSE x.qty END) FOR x IN asks] AS asks
 FROM (SELECT symbol, bar, bids, asks, bids AS b, asks AS a FROM books))"""
    both = out | flags
    return f"SELECT symbol, bar, {', '.join(f'{v} AS {k}' for k, v in both.items())} FROM {source}", " ".join(["symbol bar", *flags]), " ".join(out)


@query("book_features", sql(BOOKS_SQL, *_book_sql()))
def book_features(spark, sf_dir):
    h = F.floor(F.col("bar") / HOUR)
    odd = books(spark, sf_dir).withColumns({
        "bids": F.when(h % 7 == 3, F.reverse("bids")).otherwise(F.col("bids")),
        "asks": F.transform("asks", lambda x: F.struct(F.when(h % 11 == 5, x.price - 60).otherwise(x.price).alias("price"), F.when(h % 13 == 1, x.qty - 20).otherwise(x.qty).alias("qty"))),
    })
    quality = lambda: K.book_quality(20)
    return rounded(K.book_features(odd, "symbol", "bar", calculators=(K.top_of_book, K.depth_within, K.distance_bins, quality)))


@query("bars_with_books", sql(BOOKS_SQL + ", bs AS (SELECT symbol, ts_ms // 3600000 * 3600000 AS bar, count(*) AS trade_count, sum(qty) AS trade_volume FROM tape GROUP BY ALL)", "SELECT bs.symbol, '1h' AS bar_interval, bs.bar AS bar_open_ms, trade_count, trade_volume, asks[1].price - bids[1].price AS spread FROM bs LEFT JOIN books USING (symbol, bar)", "symbol bar_interval bar_open_ms trade_count", "trade_volume spread"))
def bars_with_books(spark, sf_dir):
    """Trade bars with the book's features at the same symbol, interval and opening time."""
    b = B.trade_bars(tape(spark, sf_dir), "1h", calculators=(B.base_stats,)).select("symbol", "bar_interval", "bar_open_ms", "trade_count", "trade_volume")
    k = K.book_features(books(spark, sf_dir), "symbol", F.lit("1h").alias("bar_interval"), F.col("bar").alias("bar_open_ms"), calculators=(K.top_of_book,))
    return rounded(J.on_bar_key(b, k.select("symbol", "bar_interval", "bar_open_ms", "spread")))


DIFFS = TAPE_SQL + ", diffs AS (SELECT symbol, CASE WHEN is_buyer_maker THEN 'bid' ELSE 'ask' END AS side, floor(price) AS price, CASE WHEN qty <= 10 THEN 0 ELSE qty END AS qty, seq FROM tape)"


def _diffs(spark, sf_dir):
    return tape(spark, sf_dir).select("symbol", F.when(F.col("is_buyer_maker"), "bid").otherwise("ask").alias("side"), F.floor("price").cast("double").alias("price"), F.when(F.col("qty") <= 10, 0.0).otherwise(F.col("qty")).alias("qty"), "seq")


@query("replayed_book", sql(DIFFS, "SELECT * FROM (SELECT symbol, side, price, arg_max(qty, seq) AS qty FROM diffs GROUP BY ALL) WHERE qty <> 0", "symbol side", "price qty"))
def replayed_book(spark, sf_dir):
    return rounded(K.replay_book(_diffs(spark, sf_dir)))


@query("top_book_levels", sql(DIFFS, "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS level FROM (SELECT symbol, side, price, arg_max(qty, seq) AS qty FROM diffs GROUP BY ALL) WHERE qty <> 0) WHERE level <= 5", "symbol side level", "price qty"))
def top_book_levels(spark, sf_dir):
    top = K.top_levels(K.replay_book(_diffs(spark, sf_dir)), 5)
    return rounded(top.select("symbol", "side", F.explode("levels").alias("x")).select("symbol", "side", F.col("x.level").cast("long").alias("level"), "x.price", "x.qty"))


@query("sequence_gaps", TAPE_SQL.join(["WITH ", """, d AS (SELECT symbol, seq, seq AS first_id, seq AS final_id FROM tape), g AS (SELECT *, coalesce(first_id - 1 <> lag(final_id) OVER (PARTITION BY symbol ORDER BY seq), false) AS gap FROM d)
SELECT symbol, count(*) AS n, count(*) FILTER (gap) AS gaps FROM g GROUP BY symbol"""]))
def sequence_gaps(spark, sf_dir):
    d = tape(spark, sf_dir).select("symbol", "seq", F.col("seq").alias("first_id"), F.col("seq").alias("final_id"), F.lit(None).cast("long").alias("prev_id"))
    return K.sequence_gaps(d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("epoch").alias("gaps"))


@query("sequence_epochs", TAPE_SQL.join(["WITH ", """, d AS (SELECT symbol, seq, coalesce(seq - 1 <> lag(seq) OVER (PARTITION BY symbol ORDER BY seq), false) AS gap FROM tape)
SELECT symbol, seq, gap, sum(gap::INT) OVER (PARTITION BY symbol ORDER BY seq)::BIGINT AS epoch FROM d"""]))
def sequence_epochs(spark, sf_dir):
    """Every diff with its flag and epoch, over cells of 500 arrivals."""
    d = tape(spark, sf_dir).select("symbol", "seq", F.col("seq").alias("first_id"), F.col("seq").alias("final_id"), F.lit(None).cast("long").alias("prev_id"))
    return K.sequence_gaps(d, 500).select("symbol", "seq", "gap", F.col("epoch").cast("long").alias("epoch"))


# ---------------------------------------------------------------- joins


def _slow(spark, sf_dir):
    """A slow series: the mean value of each six hours, known at their end."""
    return tape(spark, sf_dir).groupBy("symbol", ((F.floor(F.col("ts_ms") / (6 * HOUR)) + 1) * 6 * HOUR).alias("bar")).agg(F.avg("price").alias("fng"))


SLOW = BARS_SQL + ", slow AS (SELECT symbol, (ts_ms // 21600000 + 1) * 21600000 AS bar, avg(price) AS fng FROM tape GROUP BY ALL)"


@query("asof_backward", sql(SLOW, "SELECT b.symbol, b.bar, b.close, CASE WHEN b.bar - s.bar <= 7200000 THEN s.fng END AS fng FROM bars b ASOF LEFT JOIN slow s ON b.symbol = s.symbol AND b.bar >= s.bar", "symbol bar", "close fng"))
def asof_backward(spark, sf_dir):
    return rounded(J.asof_backward(bars(spark, sf_dir).select("symbol", "bar", "close"), _slow(spark, sf_dir), ["symbol"], "bar", ["fng"], tolerance=2 * HOUR))


@query("asof_strict", sql(SLOW, "SELECT b.symbol, b.bar, s.fng FROM bars b ASOF LEFT JOIN slow s ON b.symbol = s.symbol AND b.bar > s.bar", "symbol bar", "fng"))
def asof_strict(spark, sf_dir):
    return rounded(J.asof_backward(bars(spark, sf_dir).select("symbol", "bar"), _slow(spark, sf_dir), ["symbol"], "bar", ["fng"], exact=False))


@query("asof_fill", sql(SLOW, "SELECT b.symbol, b.bar, s.fng FROM bars b ASOF LEFT JOIN (SELECT * FROM slow WHERE bar // 21600000 % 3 <> 0) s ON b.symbol = s.symbol AND b.bar >= s.bar", "symbol bar", "fng"))
def asof_fill(spark, sf_dir):
    slow = _slow(spark, sf_dir).withColumn("fng", F.when(F.floor(F.col("bar") / (6 * HOUR)) % 3 != 0, F.col("fng")))
    return rounded(J.asof_fill(bars(spark, sf_dir).select("symbol", "bar"), slow, ["symbol"], "bar", "fng"))


@query("align_pad", sql(BARS_SQL, "SELECT t.symbol, t.seq, b.bar AS grid_time FROM (SELECT symbol, seq, ts_ms AS bar FROM tape) t ASOF JOIN bars b ON t.symbol = b.symbol AND t.bar >= b.bar", "symbol seq grid_time", ""))
def align_pad(spark, sf_dir):
    events = tape(spark, sf_dir).select("symbol", "seq", F.col("ts_ms").alias("bar"))
    return J.align(events, bars(spark, sf_dir), ["symbol"], "bar", "pad").select("symbol", "seq", "grid_time")


@query("align_pad_all", SQL["align_pad"])
def align_pad_all(spark, sf_dir):
    """The same in cells of two days, so that each symbol is many tasks."""
    t, b = tape(spark, sf_dir).select("symbol", "seq", F.col("ts_ms").alias("at")), bars(spark, sf_dir).select("symbol", F.col("bar").alias("at"), F.col("bar").alias("grid_time"))
    return J.asof_backward(t, b, ["symbol"], "at", ["grid_time"], cell=48 * HOUR).where("grid_time is not null").select("symbol", "seq", "grid_time")


@query("align_exact", sql(BARS_SQL, "SELECT symbol, seq, ts_ms // 60000 * 60000 AS grid_time FROM tape t WHERE EXISTS (SELECT 1 FROM bars b WHERE b.symbol = t.symbol AND b.bar = t.ts_ms // 60000 * 60000)", "symbol seq grid_time", ""))
def align_exact(spark, sf_dir):
    """Trades whose minute is a bar's time."""
    minutes = tape(spark, sf_dir).select("symbol", "seq", (F.floor(F.col("ts_ms") / 60_000) * 60_000).alias("bar"))
    return J.align(minutes, bars(spark, sf_dir), ["symbol"], "bar", "exact").select("symbol", "seq", "grid_time")


@query("flatten_minutes", sql(BARS_SQL, """SELECT b.symbol, b.bar, """ + ", ".join(f"max(CASE WHEN h.bar = b.bar - {n} * 3600000 THEN h.close END) AS m{4 - n}_close" for n in (4, 3, 2, 1)) + """ FROM bars b LEFT JOIN bars h ON b.symbol = h.symbol AND h.bar < b.bar AND h.bar >= b.bar - 14400000 GROUP BY ALL""", "symbol bar", "m0_close m1_close m2_close m3_close"))
def flatten_minutes(spark, sf_dir):
    # bars in hours stand for minutes: times divided by 60
    hours = bars(spark, sf_dir).select("symbol", (F.col("bar") / 60).cast("long").alias("bar"), "close")
    return rounded(J.flatten_minutes(hours.select("symbol", "bar"), hours, ["symbol"], "bar", ["close"], 4).withColumn("bar", F.col("bar") * 60))


@query("flatten_minutes_filled", sql(BARS_SQL + ", ho AS (SELECT symbol, bar, CASE WHEN bar // 3600000 % 4 > 1 THEN close END AS x FROM bars), fi AS (SELECT symbol, bar, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING), 0) AS x FROM ho)", """SELECT b.symbol, b.bar, """ + ", ".join(f"max(CASE WHEN h.bar = b.bar - {n} * 3600000 THEN h.x END) AS m{3 - n}_x" for n in (3, 2, 1)) + """ FROM bars b LEFT JOIN fi h ON b.symbol = h.symbol AND h.bar < b.bar AND h.bar >= b.bar - 10800000 GROUP BY ALL""", "symbol bar", "m0_x m1_x m2_x"))
def flatten_minutes_filled(spark, sf_dir):
    """Half the values are missing and taken over from before; hours stand for minutes."""
    hours = bars(spark, sf_dir).select("symbol", (F.col("bar") / 60).cast("long").alias("bar"), F.when(F.floor(F.col("bar") / HOUR) % 4 > 1, F.col("close")).alias("x"))
    return rounded(J.flatten_minutes(hours.select("symbol", "bar"), hours, ["symbol"], "bar", ["x"], 3, fill=True).withColumn("bar", F.col("bar") * 60))


@query("interval_join", sql(BARS_SQL, "SELECT t.symbol, t.seq, b.bar FROM tape t JOIN bars b ON t.symbol = b.symbol AND t.ts_ms >= b.bar AND t.ts_ms < b.bar + 3600000", "symbol seq bar", ""))
def interval_join(spark, sf_dir):
    spans = bars(spark, sf_dir).select("symbol", "bar", (F.col("bar") + HOUR).alias("bar_end"))
    points = tape(spark, sf_dir).select("symbol", "seq", "ts_ms")
    return J.within(points, spans, ["symbol"], "ts_ms", "bar", "bar_end", HOUR).select("symbol", "seq", "bar")


@query("interval_join_all", SQL["interval_join"])
def interval_join_all(spark, sf_dir):
    """The same with cells shorter than the spans, so that a span lies in several."""
    spans = bars(spark, sf_dir).select("symbol", "bar", (F.col("bar") + HOUR).alias("bar_end"))
    return J.within(tape(spark, sf_dir).select("symbol", "seq", "ts_ms"), spans, ["symbol"], "ts_ms", "bar", "bar_end", HOUR // 3).select("symbol", "seq", "bar")


@query("overlap_trim", sql(BARS_SQL, "SELECT * FROM bars WHERE bar >= (SELECT min(bar) FROM bars WHERE symbol = 'click') AND bar <= (SELECT max(bar) FROM bars WHERE symbol = 'click')", "symbol bar", "close"))
def overlap_trim(spark, sf_dir):
    b = bars(spark, sf_dir)
    return rounded(J.overlap_only(b, b.where("symbol = 'click'"), "bar").select("symbol", "bar", "close"))


@query("parity_counts", TAPE_SQL.join(["WITH ", """, a AS (SELECT seq AS k, qty AS v FROM tape WHERE seq % 3 <> 0), b AS (SELECT seq AS k, CASE WHEN seq % 11 = 0 THEN qty + 1 ELSE qty END AS v FROM tape WHERE seq % 5 <> 0)
SELECT CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' WHEN a.v = b.v THEN 'match' ELSE 'mismatch' END AS state, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1"""]))
def parity_counts(spark, sf_dir):
    t = tape(spark, sf_dir)
    a = t.where("seq % 3 <> 0").select(F.col("seq").alias("k"), F.col("qty").alias("v"))
    b = t.where("seq % 5 <> 0").select(F.col("seq").alias("k"), F.when(F.col("seq") % 11 == 0, F.col("qty") + 1).otherwise(F.col("qty")).alias("v"))
    return J.parity(a, b, ["k"], "v")


@query("match_in_order", sql(BARS_SQL, "SELECT a.user_id, a.k, a.seq AS seq_a, b.seq AS seq_b FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM tape WHERE seq % 2 = 0) a JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM tape WHERE seq % 2 = 1) b USING (user_id, k)", "user_id k seq_a seq_b", ""))
def match_in_order(spark, sf_dir):
    t = tape(spark, sf_dir)
    a, b = t.where("seq % 2 = 0").select("user_id", F.col("seq").alias("seq_a")), t.where("seq % 2 = 1").select("user_id", F.col("seq").alias("seq_b"))
    return J.match_in_order(a, b, ["user_id"], ["seq_a"], ["seq_b"]).select("user_id", F.col("k").cast("long").alias("k"), "seq_a", "seq_b")


@query("gaps_and_islands", sql(BARS_SQL, "SELECT symbol, bar + 3600000 AS gap_from, nxt - 3600000 AS gap_to FROM (SELECT symbol, bar, lead(bar) OVER (PARTITION BY symbol ORDER BY bar) AS nxt FROM bars) WHERE nxt - bar > 3600000", "symbol gap_from gap_to", ""))
def gaps_and_islands(spark, sf_dir):
    return J.gaps(bars(spark, sf_dir).select("symbol", "bar"), "bar", HOUR)


@query("missing_keys", "SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderdate::DATE NOT IN (SELECT l_shipdate::DATE FROM lineitem WHERE l_quantity > 49)")
def missing_keys(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct()
    present = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return J.missing_keys(wanted, present, "day")


# ---------------------------------------------------------------- windows

WINDOWED = """SELECT symbol, bar,
 CASE WHEN count(close) OVER w30 >= 10 THEN (close - avg(close) OVER w30) / greatest(stddev_pop(close) OVER w30, 1e-8) END AS z_offline,
 coalesce((close - avg(close) OVER w30) / CASE WHEN coalesce(stddev_samp(close) OVER w30, 0) = 0 THEN 1e-8 ELSE stddev_samp(close) OVER w30 END, 0) AS z_live,
 volume / nullif(avg(volume) OVER w20, 0) - 1 AS volume_spike
FROM bars WINDOW w30 AS (PARTITION BY symbol ORDER BY bar ROWS 29 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY bar ROWS 19 PRECEDING)"""


@query("rolling_scores", sql(BARS_SQL, WINDOWED, "symbol bar", "z_offline z_live volume_spike"))
def rolling_scores(spark, sf_dir):
    w = N.series(["symbol"], "bar")
    c = F.col("close")
    return rounded(bars(spark, sf_dir).select("symbol", "bar", N.rolling_z(c, w, 30, 10).alias("z_offline"), N.rolling_z(c, w, 30, 1, live=True).alias("z_live"), N.spike(F.col("volume"), w).alias("volume_spike")))


@query("rolling_scores_chunked", SQL["rolling_scores"])
def rolling_scores_chunked(spark, sf_dir):
    """The same on a full grid cut into chunks of days with a halo: what a hot symbol needs at scale."""
    b = N.positions(bars(spark, sf_dir), ["symbol"], "bar", 48 * HOUR)  # a halo of rows needs even times: number the bars first, by cells
    chunked = N.halo(b, "i", 64, 32)
    w = W.partitionBy("symbol", "chunk").orderBy("i")
    c = F.col("close")
    return rounded(N.own_rows(chunked.select("symbol", "bar", "chunk", "own", N.rolling_z(c, w, 30, 10).alias("z_offline"), N.rolling_z(c, w, 30, 1, live=True).alias("z_live"), N.spike(F.col("volume"), w).alias("volume_spike"))))


@query("trend_slope", sql(BARS_SQL + ", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS i FROM bars)", "SELECT symbol, bar, CASE WHEN count(close) OVER w = 5 THEN regr_slope(close, i) OVER w END AS slope5 FROM n WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS 4 PRECEDING)", "symbol bar", "slope5"))
def trend_slope(spark, sf_dir):
    return rounded(bars(spark, sf_dir).select("symbol", "bar", N.slope(F.col("close"), N.series(["symbol"], "bar"), 5).alias("slope5")))


@query("jump_flags", sql(BARS_SQL, "SELECT symbol, bar, coalesce((abs(ln(CASE WHEN close > 0 THEN close END) - lag(ln(CASE WHEN close > 0 THEN close END)) OVER (PARTITION BY symbol ORDER BY bar)) > 0.001)::INT, 0) AS jump FROM bars", "symbol bar jump", ""))
def jump_flags(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "bar", N.jump_flag(F.col("close"), N.series(["symbol"], "bar")).alias("jump"))


@query("decay_linear", sql(BARS_SQL, "SELECT symbol, bar, (4 * close + 3 * lag(close) OVER w + 2 * lag(close, 2) OVER w + lag(close, 3) OVER w) / 10 AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar)", "symbol bar", "d"))
def decay_linear(spark, sf_dir):
    return rounded(bars(spark, sf_dir).select("symbol", "bar", N.decay_linear(F.col("close"), N.series(["symbol"], "bar"), 4).alias("d")))


@query("pct_rank_all", sql(BARS_SQL, "SELECT symbol, bar, (rank() OVER (PARTITION BY symbol ORDER BY close) + (count(*) OVER (PARTITION BY symbol, close) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol) AS r FROM bars", "symbol bar", "r"))
def pct_rank_all(spark, sf_dir):
    return rounded(R.with_pct_rank(bars(spark, sf_dir).select("symbol", "bar", "close"), ["symbol"], "close", "r").drop("close"))


@query("expanding_pct_rank", sql(BARS_SQL + ", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS i FROM bars)", "SELECT a.symbol, a.bar, CASE WHEN count(*) >= 50 THEN (count(*) FILTER (b.close < a.close) + (count(*) FILTER (b.close = a.close) + 1) / 2.0) / count(*) END AS pct_rank FROM n a JOIN n b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY a.symbol, a.bar", "symbol bar", "pct_rank"))
def expanding_pct_rank(spark, sf_dir):
    return rounded(R.expanding_pct_rank(bars(spark, sf_dir).select("symbol", "bar", "close"), ["symbol"], "bar", "close", 50).drop("close"))


@query("expanding_quantile", sql(BARS_SQL, "SELECT symbol, bar, CASE WHEN count(close) OVER w >= 50 THEN quantile_cont(close, 0.7) OVER w END AS q FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "symbol bar", "q"))
def expanding_quantile(spark, sf_dir):
    return rounded(R.expanding_quantile(bars(spark, sf_dir).select("symbol", "bar", "close"), ["symbol"], "bar", "close", {"q": 0.7}, 50).drop("close"))


HOLES = BARS_SQL + ", holes AS (SELECT symbol, bar, CASE WHEN bar // 3600000 % 4 <> 1 THEN close END AS x, row_number() OVER (PARTITION BY symbol ORDER BY bar) AS i FROM bars)"


def _holes(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", "bar", F.when(F.floor(F.col("bar") / HOUR) % 4 != 1, F.col("close")).alias("x"))


@query("fill_last", sql(HOLES, "SELECT symbol, bar, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM holes", "symbol bar", "x"))
def fill_last(spark, sf_dir):
    return rounded(N.fill(_holes(spark, sf_dir), ["symbol"], "bar", ["x"], "last"))


@query("fill_linear", sql(HOLES, """SELECT symbol, bar, coalesce(x, a + (b - a) * (i - ia) / nullif(ib - ia, 0), a, b) AS x FROM (SELECT *, last_value(x IGNORE NULLS) OVER p AS a, first_value(x IGNORE NULLS) OVER f AS b,
 last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER p AS ia, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ib FROM holes
 WINDOW p AS (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", "symbol bar", "x"))
def fill_linear(spark, sf_dir):
    return rounded(N.fill(_holes(spark, sf_dir), ["symbol"], "bar", ["x"], "linear"))


_FFD = N.fractional_weights(0.4, 0.02)


@query("fractional_difference", sql(BARS_SQL, f"SELECT symbol, bar, {' + '.join(f'({w!r}) * lag(close, {k}) OVER w' for k, w in enumerate(_FFD))} AS f FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar)", "symbol bar", "f"))
def fractional_difference(spark, sf_dir):
    return rounded(bars(spark, sf_dir).select("symbol", "bar", N.fractional_difference(F.col("close"), N.series(["symbol"], "bar"), 0.4, 0.02).alias("f")))


@query("equal_spacing", sql(BARS_SQL, "SELECT symbol, count(DISTINCT s) AS steps, median(s) AS median_step, count(DISTINCT s) = 1 AS even FROM (SELECT symbol, bar - lag(bar) OVER (PARTITION BY symbol ORDER BY bar) AS s FROM bars) WHERE s IS NOT NULL GROUP BY symbol", "symbol steps even", "median_step"))
def equal_spacing(spark, sf_dir):
    return rounded(N.equal_spacing(bars(spark, sf_dir), ["symbol"], "bar"))


@query("dedup_keep_last", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def dedup_keep_last(spark, sf_dir):
    return N.keep_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_id", "event_type")


@query("dedup_keep_first", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def dedup_keep_first(spark, sf_dir):
    return N.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_id", "event_type")


@query("latest_rows", sql(BARS_SQL, "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar DESC) AS k FROM bars) WHERE k <= 10", "symbol bar", "close"))
def latest_rows(spark, sf_dir):
    return rounded(N.tail(bars(spark, sf_dir), ["symbol"], "bar", 10).select("symbol", "bar", "close"))


@query("every_nth", sql(BARS_SQL, "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS k FROM bars) WHERE k % 7 = 0", "symbol bar", "close"))
def every_nth(spark, sf_dir):
    return rounded(R.every_nth(bars(spark, sf_dir), ["symbol"], "bar", 7).select("symbol", "bar", "close"))


@query("sequence_windows", sql(BARS_SQL, "SELECT symbol, bar, s FROM (SELECT symbol, bar, count(*) OVER w AS n, sum(close) OVER w AS s, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE n = 12 AND (i - 12) % 3 = 0", "symbol bar", "s"))
def sequence_windows(spark, sf_dir):
    seq = R.sequences(bars(spark, sf_dir), ["symbol"], "bar", ["close"], 12, 3, include=False)
    return rounded(seq.select("symbol", "bar", F.aggregate("window", F.lit(0.0), lambda a, x: a + x.close).alias("s")))


@query("time_cycle", sql(BARS_SQL, "SELECT symbol, bar, sin((bar // 60000 % 1440) / 60.0 * 2 * pi() / 24) AS tod_sin, cos((bar // 60000 % 1440) / 60.0 * 2 * pi() / 24) AS tod_cos, sin((bar // 86400000 + 3) % 7 * 2 * pi() / 7) AS dow_sin, cos((bar // 86400000 + 3) % 7 * 2 * pi() / 7) AS dow_cos FROM bars", "symbol bar", "tod_sin tod_cos dow_sin dow_cos"))
def time_cycle(spark, sf_dir):
    return rounded(bars(spark, sf_dir).select("symbol", "bar", *bartime.day_cycle(F.col("bar"))))


@query("finite_rows", sql(BARS_SQL, "SELECT symbol, bar, close FROM (SELECT symbol, bar, close, lag(close, 3) OVER (PARTITION BY symbol ORDER BY bar) AS p FROM bars) WHERE p IS NOT NULL", "symbol bar", "close"))
def finite_rows(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("p", F.lag("close", 3).over(N.series(["symbol"], "bar")))
    return rounded(b.where(numeric.all_finite("close", "p")).select("symbol", "bar", "close"))
