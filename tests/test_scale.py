"""Work by cells and chunks gives the values of whole series; files and streams give the values of the batch."""

import json
import math
import time
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeloom import plans
from tapeloom.operators import bars as B
from tapeloom.operators import book, folds, indicators, joins, selection, stats, tables, windows
from tapeloom.plans import adapters
from tapeloom.sources import records
from tapeloom.streaming import bars as streams

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def one_symbol(spark):
    """A tape of one symbol with late trades and trades without a time."""
    return adapters.shuffled_tape(spark, DATA).withColumn("symbol", F.lit("hot")).cache()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_late_events_by_cells(one_symbol):
    whole = rows(B.classify(one_symbol, "15m"), "seq")
    assert rows(B.classify(one_symbol, "15m", cell=700), "seq") == whole and {r[-2] for r in whole} != {None}


def test_asof_and_fills_by_cells(spark, one_symbol):
    t = one_symbol.where("ts_ms > 0").select("symbol", "seq", "ts_ms")
    grid = t.where("seq % 7 = 0").select("symbol", "ts_ms", F.col("seq").alias("v"))
    for exact in (True, False):
        want = rows(joins.asof_backward(t, grid, ["symbol"], "ts_ms", ["v"], exact=exact), "seq")
        assert rows(joins.asof_backward(t, grid, ["symbol"], "ts_ms", ["v"], exact=exact, cell=3_600_000), "seq") == want
        at = grid.orderBy("ts_ms", "v").toPandas()
        side = "right" if exact else "left"
        for r in want[::37]:
            k = int(np.searchsorted(at.ts_ms, r[2], side)) - 1
            assert r[3] == (None if k < 0 else at.v[k])
    s = t.select("symbol", F.col("seq").alias("i"), F.when(F.col("seq") % 3 == 0, F.col("ts_ms") / 1e6).alias("x")).where("i > 40")
    for method, fill in (("last", lambda x: x.ffill().bfill()), ("linear", lambda x: x.interpolate(limit_direction="both"))):
        own = s.orderBy("i").toPandas()
        got = windows.fill(s, ["symbol"], "i", ["x"], method, cell=100).orderBy("i").toPandas()
        assert np.allclose(got.x, fill(own.x)) and list(got.columns) == ["symbol", "i", "x"]


def test_gaps_and_splits_by_cells(one_symbol):
    d = one_symbol.select("symbol", "seq", F.col("seq").alias("first_id"), F.col("seq").alias("final_id"), F.lit(None).cast("long").alias("prev_id"))
    w = W.partitionBy("symbol").orderBy("seq")
    want = d.withColumn("gap", F.coalesce(F.col("first_id") - 1 != F.lag("final_id").over(w), F.lit(False)))
    want = want.withColumn("epoch", F.sum(F.col("gap").cast("int")).over(w))
    assert rows(book.sequence_gaps(d, cell=90), "seq") == rows(want, "seq")
    times = one_symbol.select("seq").distinct().count()
    for ratio in (0.0, 0.3, 1.0):
        n = {r.part: r["count"] for r in folds.split_by_position(one_symbol, "seq", ratio, cell=50).groupBy("part").count().collect()}
        assert n.get("train", 0) == int(times * ratio)


@pytest.mark.parametrize("alpha, chunk", [(0.5, None), (0.02, 16), (0.9, 3), (1e-4, None)])
def test_exponential_means(spark, alpha, chunk):
    rng = np.random.default_rng(1)
    x = rng.normal(100, 5, 700)
    df = spark.createDataFrame([("a", i * 10, float(v)) for i, v in enumerate(x)] + [("b", 5, 1.0), ("b", 7, None), ("b", 9, 3.0)], "k string, t long, x double")
    got = windows.exponential_mean(df, ["k"], "t", "x", alpha, cell=1000, chunk=chunk).orderBy("k", "t").collect()
    want = pd.Series(x).ewm(alpha=alpha, adjust=False).mean()
    assert np.allclose([r.ewm for r in got if r.k == "a"], want, rtol=1e-12, atol=0)
    assert [r.ewm for r in got if r.k == "b"] == pytest.approx([1.0, 1.0 + alpha * 2])


def test_reducers_equal_pandas(spark):
    rng = np.random.default_rng(2)
    x = pd.Series(rng.normal(50, 3, 120))
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, t long, x double")
    minp = 5
    want = {
        "last": x, "sma": x.rolling(20, min_periods=minp).mean(), "percentile": x.rolling(20, min_periods=minp).quantile(0.8),
        "zscore": (x - x.rolling(20, min_periods=minp).mean()) / (x.rolling(20, min_periods=minp).std(ddof=0) + 1e-12), "ema": x.ewm(halflife=10, adjust=False, min_periods=minp).mean(),
    }
    e = x.ewm(halflife=10, adjust=False, min_periods=minp)
    want["ewm_zscore"] = (x - e.mean()) / (e.std(bias=False) + 1e-12)
    for kind, series in want.items():
        got = [r.value for r in windows.reduced(df, ["k"], "t", "x", kind, 20).orderBy("t").collect()]
        assert np.allclose(np.array(got, float), series, equal_nan=True), kind


def test_labels_are_attached_by_the_rules(spark):
    b = spark.createDataFrame([("s", t) for t in (0, 10, 20, 30)], "symbol string, ts long")
    schema = "symbol string, t0 long, side int, label int, t1 long"
    ev = spark.createDataFrame([("s", 0, 1, None, 1), ("s", 0, 1, 0, 9), ("s", 0, 1, 1, 5), ("s", 0, 1, 1, 7), ("s", 14, 1, 0, 20), ("s", 18, 1, 1, 20), ("s", 20, -1, 1, 22), ("s", -5, 1, 1, 0)], schema)
    got = lambda **o: {r.ts: (r.side, r.label, r.t1) for r in joins.attach_labels(b, ev, **o).collect() if r.side is not None}
    assert got() == {0: (1, 0, 9), 20: (-1, 1, 22)}
    assert got(policy="prefer_win")[0] == (1, 1, 7) and got(policy="earliest_t1")[0] == (1, 1, 7) and got(policy="latest_t1")[0] == (1, 0, 9)
    assert got(sides="short") == {20: (-1, 1, 22)}
    assert got(sides="long", align_by="pad") == {0: (1, 0, 9), 10: (1, 1, 20)}
    both = ev.union(spark.createDataFrame([("s", 20, 1, 0, 21)], schema))
    with pytest.raises(Exception, match="choose a side"):
        joins.attach_labels(b, both).collect()


def test_votes_of_several_classes(spark):
    votes = [(1, 2, 0.2, 0.2, 0.6), (1, 2, 0.1, 0.5, 0.4), (1, 0, 0.9, 0.1, 0.0), (2, 1, 0.5, 0.5, 0.0), (2, 0, 0.5, 0.5, 0.0), (3, None, 0.9, 0.1, 0.0)]
    got = {r.k: r for r in stats.vote(spark.createDataFrame(votes, "k int, pred int, p0 double, p1 double, p2 double"), ["k"], ["p0", "p1", "p2"]).collect()}
    assert (got[1].votes_total, got[1].hard, got[1].soft) == (3, 2, 0) and (got[2].hard, got[2].soft, got[2].margin) == (0, 0, 0.0)
    assert tuple(got[3]) == (3, 0, None, None, None)


def test_table_helpers(spark):
    names = ["m_a", "m1_b", "PC2", "PC10", "PC1", "PCx", "close", "feat_1"]
    assert tables.pick_columns(names, ["feat_*"], ["m"], ["close"]) == ["m_a", "m1_b", "close", "feat_1"]
    assert tables.numbered_columns(names) == ["PC1", "PC2", "PC10"] and tables.split_columns(names)[0] == ["m_a", "m1_b"]
    df = spark.createDataFrame([(1, -1), (2, 0), (3, None)], "k int, label int")
    assert [r.c for r in df.select("k", tables.recode(F.col("label"), {-1: 0, 0: 1, 1: 2}).alias("c")).orderBy("k").collect()] == [0, 1, None]
    with pytest.raises(Exception, match="no code"):
        df.select(tables.recode(F.col("label"), {0: 1}).alias("c")).collect()
    twice = df.union(df)
    with pytest.raises(Exception, match="not unique"):
        tables.one_to_one(df, twice, ["k"]).collect()
    assert tables.one_to_one(df, df.withColumnRenamed("label", "other"), ["k"]).count() == 3
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id")
    a, b = (sorted(r.event_id for r in tables.sample_rows(e, ["event_id"], 50, 3).collect()) for e in (events, events.repartition(7)))
    assert a == b and len(a) == 50


def test_three_class_bands(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(0, 1, 400)
    p = 0.6 * y + rng.normal(0, 0.7, 400)
    r = stats.class_bands(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double"), steps=41).first()
    tri = lambda x, t: np.where(x > t, 2, np.where(x < -t, 0, 1))
    truth, best = tri(y, np.quantile(np.abs(y), 0.4)), (-1.0, None)
    for t in np.quantile(np.abs(p), np.linspace(0.05, 0.95, 41)):
        said, f = tri(p, t), []
        for c in range(3):
            hit, a, b = ((truth == c) & (said == c)).sum(), (truth == c).sum(), (said == c).sum()
            f.append(1.25 * hit / (0.25 * a + b) if a + b else 0.0)
        if np.mean(f) > best[0] + 1e-12:
            best = (np.mean(f), t)
    assert (r.true_band, r.score, r.pred_band) == pytest.approx((np.quantile(np.abs(y), 0.4), *best))


def test_components_and_clusters_of_all_dimensions(spark):
    x = np.array([r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()], float)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    share = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    got = [r.share for r in plans.queries()["principal_components"](spark, DATA).orderBy("component").collect()]
    assert got == pytest.approx((share / share.sum())[:4], abs=1e-5)
    d = np.sqrt(np.maximum(2 * (1 - np.corrcoef(x.T)), 0))
    groups = [[i] for i in range(64)]
    while len(groups) > 1:  # average linkage by plain means of the original distances
        near = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if near[0] >= 1.4:
            break
        groups[near[1]] += groups.pop(near[2])
    found = {}
    for r in plans.queries()["linkage_clusters"](spark, DATA).collect():
        found.setdefault(r.cluster, set()).add(int(r.item[1:]))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups))


def test_indicator_plan_is_built_quickly(spark):
    bars = adapters.bars(spark, DATA)
    indicators.compute(bars, ["sma_10"], ["symbol"], "bar")
    began = time.perf_counter()
    indicators.compute(bars, indicators.DEFAULT_PLAN, ["symbol"], "bar", shift=1)
    assert time.perf_counter() - began < 15  # seconds rather than the minute of one projection a column


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    tape = adapters.shuffled_tape(spark, "/root/testdata/sf0.01").withColumn("symbol", F.when(F.col("user_id") % 3 == 0, "a").otherwise("b"))
    n = tape.count()
    tape.repartitionByRange(1, F.rand(3)).write.parquet(str(tmp_path / "in"))  # one file: one micro-batch, in no order
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = streams.bars_on_arrival(source, 900_000).writeStream.format("memory").queryName("whole_bars").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    columns = ["symbol", "bar", *[c for c in [*streams.FIELDS][1:]], "signed_volume", "volume_imbalance", "vwap", "trade_return"]
    got = spark.table("whole_bars").select(*columns).orderBy("symbol", "bar").toPandas()
    want = B.trade_bars(tape, "15m", flush=False).withColumnRenamed("bar_open_ms", "bar").select(*columns).orderBy("symbol", "bar").toPandas()
    assert n == 10_000 and len(got) == len(want) > 1000
    for c in columns:
        if got[c].dtype == float:
            assert np.allclose(got[c], want[c].astype(float), equal_nan=True), c
        else:
            assert got[c].tolist() == want[c].tolist(), c


def test_stream_bars_are_flushed_after_silence(spark, tmp_path):
    schema = "symbol string, seq long, ts_ms long, price double, qty double"
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("s", 1, 60_000, 10.0, 1.0), ("s", 2, 61_000, 12.0, 2.0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streams.bars_on_arrival(source, flush_after_ms=1).writeStream.format("memory").queryName("flushed").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if spark.table("flushed").count():
                break
        spark.createDataFrame([("s", 3, 1_000, 5.0, 1.0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(120):
            time.sleep(0.5)
            if spark.table("flushed").count() > 1:
                break
    finally:
        q.stop()
    assert sorted((r.bar, r.trade_count, r.last_price) for r in spark.table("flushed").collect()) == [(0, 1, 5.0), (60_000, 2, 12.0)]


def test_closed_bars_once_and_watermark_bars(spark, tmp_path):
    rows_ = [("s", datetime(2024, 1, 1, 0, 1), True), ("s", datetime(2024, 1, 1, 0, 1), True), ("s", datetime(2024, 1, 1, 0, 2), False), ("s", datetime(2024, 1, 1, 0, 3), True)]
    spark.createDataFrame(rows_, "symbol string, close_ts timestamp, is_closed boolean").coalesce(1).write.parquet(str(tmp_path / "k"))
    q = streams.closed_once(spark.readStream.schema("symbol string, close_ts timestamp, is_closed boolean").parquet(str(tmp_path / "k"))).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "kc")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.close_ts.minute for r in spark.table("closed").collect()) == [1, 3]
    tape = [("s", datetime(2024, 1, 1, 0, 0, 10), 1.0, 10.0), ("s", datetime(2024, 1, 1, 0, 0, 50), 2.0, 10.0), ("s", datetime(2024, 1, 1, 0, 9), 1.0, 11.0)]
    spark.createDataFrame(tape, "symbol string, ts timestamp, qty double, price double").coalesce(1).write.parquet(str(tmp_path / "t"))
    q = streams.bars_by_watermark(spark.readStream.schema("symbol string, ts timestamp, qty double, price double").parquet(str(tmp_path / "t"))).writeStream.format("memory").queryName("marked").option("checkpointLocation", str(tmp_path / "tc")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.trade_count, r.trade_volume, r.trade_notional) for r in spark.table("marked").collect()] == [(2, 3.0, 30.0)]


def test_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("t0,t1,side,label,entry_price\n2024-01-01 00:00:00,2024-01-01 01:00:00,Long,1,10\n2024-01-01 00:00:00+08:00,,short,x,11\nbad,,Long,1,1\n")
    got = sorted((r.t0, r.t1, r.side, r.label) for r in records.event_labels(spark, str(tmp_path / "e.csv")).collect())
    assert got == [(1704038400000, None, -1, None), (1704067200000, 1704070800000, 1, 1.0)]
    df = spark.createDataFrame([(1, 1, 0.5, None)], "t0 long, side int, pred double, label int")
    records.write_predictions(df, str(tmp_path / "p"))
    assert "".join(f.read_text() for f in (tmp_path / "p").glob("*.csv")).splitlines()[0] == "t0,side,label,pred"
    records.write_json(df, str(tmp_path / "j"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "j").glob("*.json"))) == {"t0": 1, "side": 1, "pred": 0.5, "label": None}
    records.write_both(df, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b" / "parquet")).count() == spark.read.option("header", True).csv(str(tmp_path / "b" / "csv")).count() == 1
    with pytest.raises(KeyError):
        records.numbers(df, "open")
    assert records.numbers(spark.createDataFrame([("1.5",), ("x",)], "open string"), "open").collect()[0].open == 1.5
    (tmp_path / "f.csv").write_text("Datetime, Close\n2024-01-01 00:00:00,1\n2024-01-01 00:00:00,2\n2024-01-01 00:15:00,3\n")
    assert [r.close for r in records.feature_table(spark, str(tmp_path / "f.csv"), one_per_time=True).orderBy("ts").collect()] == [2.0, 3.0]
    lines = [{"recv_ts": 1700000000.0 + k, "symbol": "B", "msg": {"data": {"s": "B", "E": 1700000000000 + 1000 * (k // 2), "p": str(k), "q": "1"}}} for k in range(6)]
    (tmp_path / "trades_1.jsonl").write_text("\n".join(map(json.dumps, lines)))
    back = records.in_order(records.trade_lines(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r.seq, r.price) for r in back] == [(k, float(k)) for k in range(6)]


def test_zero_variance_and_shares(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, None)], "a double, b double, c double")
    assert stats.zero_variance(df, ["a", "b", "c"]) == ["b"]
    assert math.isclose(selection.temperature(spark.createDataFrame([(2.0, 1), (-2.0, 0), (2.0, 0), (-2.0, 1), (2.0, 1), (-2.0, 0)], "logit double, y int")), 2.0 / math.log(2), rel_tol=0.05)


def test_softmax_temperature(spark):
    rng = np.random.default_rng(9)
    z = rng.normal(0, 2, (300, 3))
    p = np.exp(z / 2.5) / np.exp(z / 2.5).sum(1, keepdims=True)
    y = [int(rng.choice(3, p=q)) for q in p]
    found = selection.softmax_temperature(spark.createDataFrame([(row.tolist(), k) for row, k in zip(z, y)], "logits array<double>, y int"))
    loss = lambda t: np.mean([np.log(np.exp(a / t).sum()) - a[k] / t for a, k in zip(z, y)])
    best = min(np.linspace(0.5, 8, 2000), key=loss)
    assert found == pytest.approx(best, rel=0.02)


def test_barriers_to_the_end_by_blocks(spark, monkeypatch):
    """Small blocks, so that barriers lie in the same block, the same area and areas beyond; against a loop over all bars."""
    from tapeloom.operators import labels as L

    monkeypatch.setattr(L, "BLOCK", 3)
    rng = np.random.default_rng(5)
    rows, prices = [], {}
    for s in ("a", "b"):
        price, prices[s] = 100.0, []
        for t in range(90 if s == "a" else 7):
            price *= float(np.exp(rng.normal(0, 0.01)))
            o, h, low = price * float(np.exp(rng.normal(0, 0.004))), price * 1.006, price * 0.994
            h, low = max(h, o), min(low, o)
            prices[s].append((t, o, h, low))
            rows.append((s, t, o, h, low))
    bars = spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double")
    events = [(s, t0, side, prices[s][t0][1], 0.05) for s in prices for t0 in range(0, len(prices[s]), 2) for side in (1, -1)]
    events += [("a", 0, 1, prices["a"][0][1], 0.05), ("a", 500, 1, 100.0, 0.05), ("a", 4, 1, 100.0, None), ("c", 0, 1, 100.0, 0.05)]
    ev = spark.createDataFrame(events, "symbol string, t0 long, side int, entry_price double, vol double")
    got = {(r.symbol, r.t0, r.side, r.vol): (r.label, r.t1) for r in L.triple_barrier(bars, ev, ["symbol"], "t", None, 1, 1.0, 1.0, both="nan").collect()}

    def plain(s, t0, side, entry, vol):
        if vol is None or s not in prices or t0 >= len(prices[s]):
            return None, None
        upper, lower = entry * math.exp(vol), entry * math.exp(-vol)
        for t, o, h, low in prices[s][t0:]:
            win = int(side > 0)
            if t > t0 and o >= upper:
                return win, t
            if t > t0 and o <= lower:
                return 1 - win, t
            if h >= upper and low <= lower:
                return None, t
            if h >= upper:
                return win, t
            if low <= lower:
                return 1 - win, t
        return None, prices[s][-1][0]

    want = {(s, t0, side, vol): plain(s, t0, side, entry, vol) for s, t0, side, entry, vol in events}
    assert got == want
    assert len({t1 // 9 - k[1] // 9 for k, (_, t1) in want.items() if t1 is not None}) > 3  # within an area and several beyond
    grid = L.barrier_grid(bars, ev.where("vol is not null"), ["symbol"], "t", None, 1, [1.0], [1.0], both="nan").first()
    known = [v[0] for k, v in want.items() if k[3] is not None]
    assert (grid.events, grid.wins, grid.losses) == (len(known), known.count(1), known.count(0))


def test_label_kinds(spark):
    """Sizes by plain pandas: the first bar is flat, quantiles of both sides, deviations, moves of the fractionally differenced log price."""
    from tapeloom.operators import labels as L
    from tapeloom.operators.windows import fractional_weights

    rng = np.random.default_rng(9)
    close = pd.Series(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 80))))
    bars = spark.createDataFrame([("a", i, float(c)) for i, c in enumerate(close)], "symbol string, t long, close double")
    k, logs = 3, np.log(close)
    ahead, past = logs.shift(-k) - logs, logs - logs.shift(k)
    deviation = logs.diff().rolling(12, min_periods=6).std()
    first = pd.Series([np.nan] + [1.0] * 79)
    sizes = {
        "bps": first * 0.002, "cost": first * 0.01, "vol": (0.5 * deviation * k**0.5).shift(1),
        "quantile": pd.concat([past.expanding(10).quantile(0.3).abs(), past.expanding(10).quantile(0.7).abs()], axis=1).max(axis=1).shift(1),
    }
    options = {"bps": {"bps": 20.0}, "cost": {"cost_bps": 100.0}, "vol": {"width": 12}, "quantile": {"least": 10}}
    for kind, size in sizes.items():
        got = L.fixed_horizon(bars, ["symbol"], "t", k, kind, **options[kind]).orderBy("t").toPandas()
        assert got.y_cls.tolist() == np.where(ahead > size, 2, np.where(ahead < -size, 0, 1)).tolist(), kind
        assert np.allclose(got.y_reg, ahead, equal_nan=True) and got.columns.tolist() == ["symbol", "t", "close", "y_reg", "y_cls"]
    want = []
    for t in range(80):
        moves = [logs[j] - logs[t] for j in range(t + 1, min(80, t + 1 + k))]
        up, down = any(m >= 0.5 * deviation[t] for m in moves), any(m <= -0.5 * deviation[t] for m in moves)
        want.append(-1 if len(moves) < k or np.isnan(deviation[t]) else 2 if up and not down else 0 if down and not up else 1)
    assert [r.y_cls for r in L.fixed_horizon(bars, ["symbol"], "t", k, "triple", width=12).orderBy("t").collect()] == want
    w = fractional_weights(0.4, 0.02)
    level = pd.Series([np.nan if t < len(w) - 1 else sum(v * logs[t - j] for j, v in enumerate(w)) for t in range(80)])
    got = L.fixed_horizon(bars, ["symbol"], "t", k, fractional=(0.4, 0.02)).orderBy("t").toPandas()
    assert np.allclose(got.y_reg.astype(float), level.shift(-k) - level, equal_nan=True)
    with pytest.raises(ValueError):
        L.fixed_horizon(bars, ["symbol"], "t", k, "none")
    assert L.fixed_horizon(bars.limit(0), ["symbol"], "t", k, "quantile").count() == 0
