"""Small cases with known results: bars, books, time rules, indicators, sources, streams."""

import datetime as dt
import json
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import bartime, numeric
from tapeloom.operators import alpha, bars, book, indicators, joins, stats, windows
from tapeloom.plans import market
from tapeloom.sources import records
from tapeloom.streaming import bars as streams

TAPE = "symbol string, seq long, ts_ms long, fallback_ms long, recv_ms long, price double, qty double, is_buyer_maker boolean"
ZONE = dt.timezone(dt.timedelta(hours=8))


def at(hour, minute, second=0):
    return int(dt.datetime(2026, 2, 17, hour, minute, second, tzinfo=ZONE).timestamp() * 1000)


def tape(spark, rows):
    return spark.createDataFrame([("BTC", i, t, None, (t or 0) + 5, float(p), float(q), m) for i, (t, p, q, m) in enumerate(rows)], TAPE)


def test_flow_and_vwap(spark):
    r = bars.trade_bars(tape(spark, [(at(11, 0, 1), 100, 2, False), (at(11, 0, 20), 110, 1, True)])).first()
    assert r.bar_open_ms == at(11, 0) and r.bar_close_ms == at(11, 1) - 1 and r.trade_count == 2
    assert r.vwap == pytest.approx(310 / 3) and r.buy_volume == 2 and r.sell_volume == 1 and r.signed_volume == 1
    assert r.volume_imbalance == pytest.approx(1 / 3) and r.trade_return == pytest.approx(0.1)


def test_late_trades_count_with_the_open_bar(spark):
    rows = {r.bar_open_ms: r for r in bars.trade_bars(tape(spark, [(at(10, 0, 5), 100, 1, False), (at(10, 1, 5), 101, 1, False), (at(10, 0, 50), 99, 1, False)])).collect()}
    assert rows[at(10, 0)].trade_count == 1 and rows[at(10, 1)].late_trade_count == 1 and rows[at(10, 1)].out_of_order


def test_bars_equal_a_sequential_pass(spark):
    rng = np.random.default_rng(5)
    rows = [(0 if rng.random() < 0.1 else int(1_700_000_000_000 + i * 20_000 + rng.integers(-90_000, 90_000)), 100 + rng.random(), 1.0, bool(rng.random() < 0.5)) for i in range(300)]
    counts, late, open_bar = {}, {}, None
    for t, *_ in rows:
        if t <= 0:
            continue
        b = t // 60_000 * 60_000
        if open_bar is not None and b < open_bar:
            late[open_bar] = late.get(open_bar, 0) + 1
        else:
            open_bar = b
            counts[b] = counts.get(b, 0) + 1
    got = bars.trade_bars(tape(spark, rows)).collect()
    assert {r.bar_open_ms: r.trade_count for r in got} == counts
    assert {r.bar_open_ms: r.late_trade_count for r in got if r.late_trade_count} == late


def test_time_contract(spark):
    ms = at(10, 1, 23) + 456
    r = spark.range(1).select(*[bartime.bar_open_ms(F.lit(ms), i).alias("o" + i) for i in [*bartime.FIXED, *bartime.CALENDAR]], bartime.bar_close_ms(F.lit(at(10, 1)), "1m").alias("close")).first()
    assert r.o1m == at(10, 1) and r.close == at(10, 1) + 59_999
    assert r.o1d == at(0, 0) and r.o12h == at(8, 0)  # fixed intervals count in UTC
    assert r.o1w == int(dt.datetime(2026, 2, 16, tzinfo=ZONE).timestamp() * 1000) and r["o1M"] == int(dt.datetime(2026, 2, 1, tzinfo=ZONE).timestamp() * 1000)


def test_minutes_and_months_are_two_columns_of_a_table(spark, tmp_path):
    own, out = spark.newSession(), str(tmp_path / "bars")
    rows = market.QUERIES["bar_time_rules"](own, "/root/testdata/sf0.001")
    rows.write.parquet(out)
    kept = own.read.parquet(out)
    assert kept.columns == rows.columns and {"open_1m", "open_1M"} < set(kept.columns)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))
    assert kept.where("open_1m <> open_1M").count() > 0


BOOK = "symbol string, bar long, depth int, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>"


def test_book_features(spark):
    df = spark.createDataFrame([("B", 0, 1000, [(100.0, 2.0), (99.9, 3.0), (99.6, 5.0)], [(100.1, 4.0), (100.2, 1.0), (100.6, 5.0)]), ("B", 1, 1000, [], [(1.0, 1.0)])], BOOK)
    (r,) = book.book_features(df, "symbol", "bar").collect()
    assert r.spread == pytest.approx(0.1) and r.imbalance_l1 == pytest.approx(-1 / 3) and r.microprice == pytest.approx((100.1 * 2 + 100.0 * 4) / 6)
    assert [r[f"depth_bid_{b}"] for b in (5, 10, 25, 50)] == [2, 2, 5, 10] and [r[f"depth_ask_{b}"] for b in (5, 10, 25, 50)] == [4, 4, 5, 5]
    assert [r[f"bin_bid_{b}"] for b in ("0_5", "5_10", "10_25", "25_50")] == [2, 0, 3, 5] and [r[f"bin_ask_{b}"] for b in ("0_5", "5_10", "10_25", "25_50")] == [4, 0, 1, 0]
    assert not any((r.flag_crossed, r.flag_bad_sorting, r.flag_low_depth, r.flag_nonpositive_qty))
    assert book.rejected(df).count() == 1


def test_last_write_wins(spark):
    df = spark.createDataFrame([("B", 1, 1, "a"), ("B", 1, 2, "b"), ("B", 2, 3, "c")], "symbol string, bar long, seq long, x string")
    assert {(r.bar, r.x) for r in book.last_write_wins(df, ["symbol", "bar"], "seq").collect()} == {(1, "b"), (2, "c")}


def test_align_to_snapshot(spark):
    diffs = spark.createDataFrame([("B", 1, 1, 5), ("B", 2, 6, 10), ("B", 3, 11, 15)], "symbol string, seq long, first_id long, final_id long")
    snap = spark.createDataFrame([("B", 7)], "symbol string, last_id long")
    assert [r.seq for r in book.align_to_snapshot(diffs, snap).orderBy("seq").collect()] == [2, 3]


def _series(n=400, seed=1):
    rng = np.random.default_rng(seed)
    c = 100 + rng.normal(size=n).cumsum()
    o = c + rng.normal(size=n) * 0.3
    return pd.DataFrame({"symbol": "S", "bar": np.arange(n) * 60_000, "open": o, "high": np.maximum(o, c) + rng.random(n), "low": np.minimum(o, c) - rng.random(n), "close": c, "volume": rng.random(n) * 100 + 1})


def _loop_mean(x, n, alpha):
    out, v = [math.nan] * len(x), None
    first = next(i for i, a in enumerate(x) if not math.isnan(a))
    for i in range(first + n - 1, len(x)):
        v = sum(x[i - n + 1 : i + 1]) / n if v is None else v + alpha * (x[i] - v)
        out[i] = v
    return out


def test_recursive_indicators_equal_loops(spark):
    d = _series()
    got = indicators.compute(spark.createDataFrame(d), ["ema_12", "rsi_14", "atr_14", "macd_12_26_9"], ["symbol"], "bar").orderBy("bar").toPandas()
    c = d.close.tolist()
    diff = [math.nan] + [b - a for a, b in zip(c, c[1:])]
    up, down = _loop_mean([max(x, 0) if x == x else x for x in diff], 14, 1 / 14), _loop_mean([max(-x, 0) if x == x else x for x in diff], 14, 1 / 14)
    tr = [math.nan] + [max(h - l, abs(h - p), abs(l - p)) for h, l, p in zip(d.high[1:], d.low[1:], c)]
    same = lambda name, want: np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-9, equal_nan=True)
    same("ema_12", _loop_mean(c, 12, 2 / 13))
    same("rsi_14", [100 * a / (a + b) for a, b in zip(up, down)])
    same("atr_14", _loop_mean(tr, 14, 1 / 14))
    same("macd_12_26_9", [a - b for a, b in zip(_loop_mean(c, 12, 2 / 13), _loop_mean(c, 26, 2 / 27))])


def test_whole_plan_and_chunks(spark):
    d = spark.createDataFrame(_series(600))
    names = list(indicators.DEFAULT_PLAN)
    whole = indicators.compute(d, names, ["symbol"], "bar").orderBy("bar").toPandas()
    assert all(whole[n].notna().any() for n in names)
    shifted = indicators.compute(d, ["mom_10"], ["symbol"], "bar", shift=1).orderBy("bar").toPandas()
    np.testing.assert_allclose(shifted.mom_10[1:].astype(float), whole.mom_10[:-1].astype(float), equal_nan=True)


def test_names_and_plans():
    assert indicators.parse("bbp_16_2.0") == ("bbp", (16, 2.0)) and indicators.parse("aobv_lr_1_14_2") == ("aobv_lr", (1, 14, 2)) and indicators.parse("fng_z7d") == ("fng_z7d", ())
    assert indicators.read_plan(["rsi_14", "# no", "", "rsi_14 # again", "ema_5"]) == ["rsi_14", "ema_5"]
    with pytest.raises(ValueError):
        indicators.parse("!")


def test_normal_cdf(spark):
    zs = [-5.0, -1.96, -0.3, 0.0, 0.3, 1.96, 2.7, 3.5, 6.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", numeric.normal_cdf(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / 2**0.5), abs=1e-9)


def test_auc_of_the_negative(spark):
    rows = [("f", float(i % 7), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "feature string, x double, y int")
    a, b = stats.auc(df, ["feature"]).first().auc, stats.auc(df.withColumn("x", -F.col("x")), ["feature"]).first().auc
    assert a == pytest.approx(1 - b)


def test_asof_keeps_left_rows_and_tolerance(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 3)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 2, 2.0)], "k string, t long, v double")
    got = {(r.k, r.t): r.v for r in joins.asof_backward(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 5): 1.0, ("a", 9): 1.0, ("b", 3): None}
    assert {r.t: r.v for r in joins.asof_backward(left, right, ["k"], "t", ["v"], tolerance=3, exact=False).where("k = 'a'").collect()} == {1: None, 5: 2.0, 9: None}


def test_halo_equals_whole_windows(spark):
    df = spark.createDataFrame([("a", i, float(i * i % 17)) for i in range(200)], "k string, t long, x double")
    w = windows.series(["k"], "t")
    whole = df.select("t", windows.rolling_z(F.col("x"), w, 10, 5).alias("z")).orderBy("t").collect()
    cw = windows.series(["k", "chunk"], "t")
    part = windows.own_rows(windows.halo(df, "t", 25, 10).select("t", "chunk", "own", windows.rolling_z(F.col("x"), cw, 10, 5).alias("z"))).orderBy("t").collect()
    assert whole == part


def test_alpha_canonical_and_division(spark):
    assert alpha.canonical(("+", "b", "a")) == alpha.canonical(("+", "a", "b")) and alpha.canonical(("-", "b", "a")) != alpha.canonical(("-", "a", "b"))
    df = spark.createDataFrame([("a", 1, 2.0, 0.0), ("a", 2, 3.0, 1.5)], "k string, t long, x double, y double")
    assert [r.q for r in alpha.evaluate(df, {"q": ("/", "x", "y")}, ["k"], "t").orderBy("t").collect()] == [None, 2.0]


def test_json_lines_and_zip(spark, tmp_path):
    lines = [{"type": "trade", "symbol": "B", "recv_ts": 1700000000.5, "msg": {"data": {"s": "B", "E": 1, "T": 1700000000000, "p": "10.5", "q": "2", "a": 7, "m": True}}}, {"type": "trade", "symbol": "B", "recv_ts": 1700000001.0, "msg": {"data": {"E": 5, "p": "11", "nq": "3", "a": 8, "m": False}}}]
    (tmp_path / "trades_1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    rows = records.trade_lines(spark, str(tmp_path), "B").orderBy("agg_trade_id").collect()
    assert [(r.ts_ms, r.fallback_ms, r.recv_ms, r.price, r.qty) for r in rows] == [(1700000000000, 1700000000000, 1700000000500, 10.5, 2.0), (0, 5000, 1700000001000, 11.0, 3.0)]
    assert records.bad_lines(spark, str(tmp_path), records.TRADE, "trades_*.jsonl").count() == 1
    with zipfile.ZipFile(tmp_path / "B-trades-2024-01-01.zip", "w") as z:
        z.writestr("a.csv", "price,qty,quote_qty,time,is_buyer_maker\n10,1,10,1.7e12,TRUE\n-1,1,1,1,0\n11,2,22,1700000060000,\n")
    got = records.clean_trades(records.zipped_csv(spark, str(tmp_path))).orderBy("ts_ms").collect()
    assert [(r.price, r.ts_ms, r.is_buyer_maker) for r in got] == [(10.0, 1700000000000, True), (11.0, 1700000060000, False)]


def test_book_lines(spark, tmp_path):
    (tmp_path / "x_snapshot_1.jsonl").write_text(json.dumps({"symbol": "B", "snapshot_ts": 1700000000.0, "bids": [[1.0, 2.0], [0.5, 1.0]], "asks": [[1.5, 1.0]]}) + "\n")
    r = records.book_lines(spark, str(tmp_path)).first()
    assert r.depth == 1 and r.bids[0].price == 1.0 and r.recv_ms == 1700000000000


def test_day_partitions(spark, tmp_path):
    path = str(tmp_path / "days")
    records.write_days(spark.createDataFrame([(at(23, 0), 1)], "ts long, x int"), path, "ts")
    records.write_days(spark.createDataFrame([(at(23, 0) + 86_400_000, 2)], "ts long, x int"), path, "ts")
    wanted = spark.createDataFrame([("2026-02-17",), ("2026-02-18",), ("2026-02-19",)], "dt string")
    assert [r.dt for r in records.missing_days(spark, path, wanted).collect()] == ["2026-02-19"]


def test_streaming_bars(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "state")
    schema = "symbol string, seq long, ts_ms long, price double, qty double"
    rows = [("B", 1, at(10, 0, 5), 100.0, 1.0), ("B", 2, at(10, 0, 30), 101.0, 2.0), ("B", 3, at(10, 1, 1), 102.0, 1.0), ("B", 4, at(10, 0, 50), 99.0, 1.0), ("B", 5, at(10, 2, 1), 103.0, 1.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    q = streams.bars_on_arrival(spark.readStream.schema(schema).parquet(str(source))).writeStream.format("memory").queryName("arrival").option("checkpointLocation", out).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.bar: r for r in spark.table("arrival").collect()}
    assert set(got) == {at(10, 0), at(10, 1)} and got[at(10, 0)].trade_count == 2 and got[at(10, 1)].late_trade_count == 1


def test_merge_latest(spark, tmp_path):
    path = str(tmp_path / "latest")
    step = streams.merge_latest(path, ["k"], "seq")
    schema = "k string, seq long, x string"
    step(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema), 0)
    for _ in range(2):
        step(spark.createDataFrame([("a", 2, "z")], schema), 1)
    assert {(r.k, r.x) for r in spark.read.parquet(f"{path}/v1").collect()} == {("a", "z"), ("b", "y")}


@pytest.mark.parametrize("name", ["align_pad_all", "interval_join_all"])
def test_every_trade_is_joined(spark, name):
    folder = "/root/testdata/sf0.001"
    trades = market.tape(spark, folder).collect()
    got = market.QUERIES[name](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted((r.symbol, r.seq, r.ts_ms // market.HOUR * market.HOUR) for r in trades)
