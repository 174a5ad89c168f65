"""Selection and report operators against straight loops."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom import plans
from tapeloom.operators import labels, levels, search, selection, stats
from tapeloom.plans import adapters


def plain_msm(x, y, c=1.0):
    def cost(new, a, b):
        return c if min(a, b) <= new <= max(a, b) else c + min(abs(new - a), abs(new - b))

    d = np.zeros((len(x), len(y)))
    d[0, 0] = abs(x[0] - y[0])
    for i in range(1, len(x)):
        d[i, 0] = d[i - 1, 0] + cost(x[i], x[i - 1], y[0])
    for j in range(1, len(y)):
        d[0, j] = d[0, j - 1] + cost(y[j], x[0], y[j - 1])
    for i in range(1, len(x)):
        for j in range(1, len(y)):
            d[i, j] = min(d[i - 1, j - 1] + abs(x[i] - y[j]), d[i - 1, j] + cost(x[i], x[i - 1], y[j]), d[i, j - 1] + cost(y[j], x[i], y[j - 1]))
    return d[-1, -1]


def test_msm_equals_the_recurrence(spark):
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (1, 5), (6, 1), (7, 9), (20, 20)):
        x, y = rng.normal(size=n), rng.normal(size=m)
        assert selection.msm(x, y) == pytest.approx(plain_msm(x, y))
    rows = [(k, rng.normal(size=12).tolist()) for k in range(5)]
    got = {(r.a, r.b): r.d for r in selection.msm_pairs(spark.createDataFrame(rows, "id int, x array<double>")).collect()}
    assert got == pytest.approx({(a, b): plain_msm(x, y) for a, x in rows for b, y in rows if a < b})


def test_msm_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=10) * 0.1 + (5 if k % 2 else 0)).tolist()) for k in range(10)]
    out, centres = selection.msm_clusters(spark.createDataFrame(rows, "id int, x array<double>"), [rows[0][1], rows[1][1]])
    found = {r.id: r.cluster for r in out.collect()}
    assert found == {k: k % 2 for k in range(10)} and np.mean(centres[1]) == pytest.approx(5, abs=0.2)


def test_backtest_holds_one_position(spark):
    bars = spark.createDataFrame([("s", t, 100.0 + t) for t in range(20)], "symbol string, t long, close double")
    events = spark.createDataFrame([("s", 1, 5, 1), ("s", 3, 8, -1), ("s", 5, 9, -1), ("s", 10, 10, 1), ("s", 11, 12, 1)], "symbol string, t0 long, t1 long, side int")
    rows = selection.vote_backtest(bars, events, ["symbol"], "t").orderBy("entry").collect()
    assert [(r.entry, r.exit, r.side) for r in rows] == [(1, 5, 1), (5, 9, -1), (11, 12, 1)]
    assert rows[0].pnl == pytest.approx(1000 * (105 / 101 - 1 - 0.002)) and rows[1].pnl == pytest.approx(1000 * (-(109 / 105 - 1) - 0.002))


def test_redundancy_reports(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=300), rng.normal(size=300)
    rows = [(float(x), float(x + 0.05 * z), float(y), float(y + 0.05 * w)) for x, y, z, w in zip(a, b, rng.normal(size=300), rng.normal(size=300))]
    df = spark.createDataFrame(rows, "p double, q double, r double, s double")
    names = ["p", "q", "r", "s"]
    pairs = stats.distances(stats.pair_correlations(df, names))
    clusters = selection.linkage_clusters(pairs, names, 0.5)
    assert clusters["p"] == clusters["q"] != clusters["r"] == clusters["s"]
    want = np.diag(np.linalg.inv(np.corrcoef(np.array(rows).T)))
    assert [selection.variance_inflation(pairs, names)[n] for n in names] == pytest.approx(want.tolist(), rel=1e-6)
    pcs, share = selection.principal_components(df, names, 2, ["p"])
    assert sum(share) > 0.95 and len(pcs.first().pc) == 2


def test_barriers_mirror_for_shorts(spark):
    bars = spark.createDataFrame([("s", t, 100.0, h, lo) for t, (h, lo) in enumerate([(101.0, 99.0), (104.0, 99.0), (104.0, 90.0)])], "symbol string, t long, open double, high double, low double")
    events = spark.createDataFrame([("s", 0, 1, 100.0, 0.03), ("s", 0, -1, 100.0, 0.03)], "symbol string, t0 long, side int, entry_price double, vol double")
    got = {r.side: r for r in labels.triple_barrier(bars, events, ["symbol"], "t", 3, 1, 1.0, 1.0).collect()}
    assert got[1].label == 1 and got[-1].label == 0 and got[1].t1 == got[-1].t1 == 1 and got[1].pt == got[-1].sl


def test_summary_of_no_trades(spark, tmp_path):
    trades = spark.createDataFrame([(1, 1, 100.0, 110.0, 95.0), (1, None, 100.0, 110.0, 95.0), (None, 0, 100.0, 110.0, 95.0)], "side int, label int, entry_price double, pt double, sl double")
    got = sorted(map(tuple, labels.trade_summary(trades).select("side", "trades", "wins", "win_rate").collect()), key=str)
    assert got == [(1, 2, 1, 0.5), (None, 1, 0, 0.0), (None, 3, 1, 1 / 3)]  # of a side unknown, and of all
    assert list(map(tuple, labels.trade_summary(trades.limit(0)).collect())) == [(None, 0, 0, None, None, None)]

    # the values of each hour lie within those of the hours before, so there is no signal
    rows = ", ".join(f"({h}, TIMESTAMP_NTZ '2024-01-01 {h:02}:00:00', 1L, 'view', 5.0D, '{{\"k\": 1}}')" for h in range(12))
    spark.sql(f"SELECT * FROM VALUES {rows} AS t(event_id, ts, user_id, event_type, value, props)").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = plans.queries()["trade_summary"](spark, str(tmp_path))
    text = lambda rows: [tuple(map(str, r)) for r in rows]
    want = con.execute(plans.oracle_sql()["trade_summary"])
    assert df.columns == [c[0] for c in want.description] and text(df.collect()) == text(want.fetchall()) == [("None", "0", "0", "None", "None", "nan")]


def test_side_words(spark):
    rows = [("Long", 1), (" sell ", -1), ("空", -1), ("2.5", 1), ("-1", -1), ("0", None), ("x", None), (None, None)]
    got = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(rows)], "k int, a string").select("k", selection.side_of(F.col("a")).alias("s")).collect()
    assert [r.s for r in sorted(got)] == [s for _, s in rows]


def test_temperature(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame([(float(3 * a), int(b)) for a, b in zip(z, y)], "logit double, y int")
    assert selection.temperature(df) == pytest.approx(3, rel=0.15)


def test_ranked_features_and_loadings(spark):
    report = spark.createDataFrame([("a", 0.5, False), ("b", 0.9, False), ("c", 0.1, True), ("d", None, False)], "feature string, score double, reject boolean")
    assert [r.feature for r in selection.ranked_features(report, "score", 1).collect()] == ["b", "c"]
    loads = spark.createDataFrame([(1, "a", 0.2), (1, "b", -0.9), (1, "c", 0.5)], "component int, feature string, loading double")
    assert [r.feature for r in selection.top_loadings(loads, 2).orderBy("place").collect()] == ["b", "c"]


def test_source_helpers(spark, tmp_path):
    from tapeloom.sources import records

    old = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 2.0)], "symbol string, ts long, close double")
    new = spark.createDataFrame([("s", 2, 3.0), ("s", 3, 4.0)], "symbol string, ts long, close double")
    assert {(r.ts, r.close) for r in records.append_bars(old, new, ["symbol", "ts"]).collect()} == {(1, 1.0), (2, 3.0), (3, 4.0)}
    assert {r.ts for r in records.closed_only(new, "ts", 1, F.lit(3)).collect()} == {2}
    with pytest.raises(KeyError):
        records.require(old, "ts", "volume")
    (tmp_path / "f.csv").write_text("DateTime, X\n2024-01-01 00:00:00,1.5\n1704067260,2\nbad,3\n")
    rows = records.feature_table(spark, str(tmp_path / "f.csv")).orderBy("ts").collect()
    assert [(r.ts, r.x) for r in rows] == [(1704067200000, 1.5), (1704067260000, 2.0)]
    r = spark.range(1).select(records.iso_time(F.lit(1704067200000)).alias("t")).first()
    assert r.t == "2024-01-01 00:00:00+00:00"
    files = spark.createDataFrame([("x-2024-01-01.zip",), ("x-2024-02-01.zip",)], "f string")
    assert records.dated(files, F.col("f"), "2024-01-15", "2024-02-15").count() == 1


def plain_signals(rows, step, span, most, lookback):
    """Level signals by the rules, one level and one bar at a time."""
    levels, out, ema, before = [], [], None, None
    for k, (t, o, h, lo, c, v) in enumerate(rows):
        ema = v if ema is None else ema + 2 / (span + 1) * (v - ema)
        busy, end = v >= ema, t + step
        if before:
            o0, c0, busy0 = before
            rise0, rise, b0, b = c0 > o0, c > o, abs(c0 - o0), abs(c - o)
            if busy and busy0 and rise0 == rise:
                levels.append(dict(p=(c0 + o) / 2, s=1 if rise else -1, kind=2, ok=True, made=end, flip=None, test=None))
            elif busy and busy0 and abs(b0 - b) <= 0.25 * max(b0, b):
                levels.append(dict(p=(c0 + o) / 2, s=-1 if rise0 else 1, kind=1, ok=True, made=end, flip=None, test=None))
            for x in levels:
                past = c < x["p"] if x["s"] > 0 else c > x["p"]
                opened_inside = o > x["p"] if x["s"] > 0 else o < x["p"]
                if not x["ok"]:
                    x["ok"] = past
                elif past and opened_inside:
                    x["s"], x["flip"] = -x["s"], end
                elif lo <= x["p"] <= h and not min(o, c) <= x["p"] <= max(o, c):
                    x["test"], x["ok"] = end, False
            levels = levels[-most:]
            hit = [x for x in levels if x["test"] == end and x["flip"] is not None and x["flip"] < end]
            if busy and hit and k > lookback and k + 1 < len(rows):
                x = hit[0]
                out.append((end, x["s"], x["p"], x["kind"], x["made"], x["flip"], rows[k + 1][1]))
        before = o, c, busy
    return out


def walk(seed, n=400):
    rng = np.random.default_rng(seed)
    c = np.round(100 + rng.normal(size=n).cumsum(), 2)
    o = np.round(c + rng.normal(size=n), 2)
    h, lo = np.maximum(o, c) + rng.random(n), np.minimum(o, c) - rng.random(n)
    return [(int(t) * 60, *map(float, x)) for t, x in enumerate(zip(o, h, lo, c, rng.integers(1, 9, n)))]


BARS = "symbol string, t long, open double, high double, low double, close double, volume double"


def test_level_signals_equal_a_plain_loop(spark):
    data = {s: walk(k) for k, s in enumerate("abc")}
    df = spark.createDataFrame([(s, *r) for s, rows in data.items() for r in rows] + [("d", 0, 1.0, 1.0, 1.0, None, 1.0)], BARS)
    rules = levels.Rules(span=5, most=30, lookback=20)
    got = sorted(tuple(r) for r in levels.level_signals(df, "symbol", "t", 60, rules).collect())
    want = sorted((s, *x) for s, rows in data.items() for x in plain_signals(rows, 60, 5, 30, 20))
    assert len(want) > 20 and got == want
    assert levels.level_signals(df.limit(0), "symbol", "t", 60).count() == 0


def test_level_signals_on_arrival(spark, tmp_path):
    rows = [("a", *r) for r in walk(0, 120)]
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], BARS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rules = levels.Rules(span=5, most=30, lookback=20)
    stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = levels.level_signals_on_arrival(stream, "symbol", "t", 60, rules).writeStream.format("memory").queryName("level_stream").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    want = sorted(tuple(r) for r in levels.level_signals(spark.createDataFrame(rows, BARS), "symbol", "t", 60, rules).collect())
    assert want and sorted(tuple(r) for r in spark.table("level_stream").collect()) == want


def test_ridge_equals_normal_equations(spark):
    rng = np.random.default_rng(4)
    n, k, alpha = 203, 5, 10.0
    x = rng.normal(size=(n, 3)) * [1, 50, 0] + [0, 1000, 7]
    y = x[:, 0] - 0.02 * x[:, 1] + rng.normal(size=n) + 5
    df = spark.createDataFrame([(t * 1000, *map(float, x[t]), float(y[t])) for t in range(n)] + [(10**9, None, 1.0, 1.0, 1.0)], "t long, p double, q double, r double, y double")
    got = {r.t // 1000: (r.fold, r.pred) for r in selection.ridge_predictions(df, ["p", "q", "r"], "y", "t", k, 0.02, alpha, cell=7000).collect()}
    assert len(got) == n
    for f, test in enumerate(np.array_split(np.arange(n), k)):
        train = np.array([i for i in range(n) if i < test[0] - 4 or i > test[-1] + 4])
        m, s = x[train].mean(0), x[train].std(0)
        s[s < 1e-12] = 1
        z = (x - m) / s
        w = np.linalg.solve(z[train].T @ z[train] + alpha * np.eye(3), z[train].T @ (y[train] - y[train].mean()))
        for i in test:
            assert got[i][0] == f and got[i][1] == pytest.approx(z[i] @ w + y[train].mean(), rel=1e-6)


def test_search_finds_the_target(spark):
    rng = np.random.default_rng(6)
    rows = [("s", t, float(a), float(b), float(a + b)) for t, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "symbol string, t long, a double, b double, y double")
    found = search.evolve(df, ["a", "b"], "y", ["symbol"], "t", size=12, generations=2, depth=2, elite=2, seed=1)
    assert found[0][1] == max(s for _, s in found) >= 0.65
    assert found == search.evolve(df, ["a", "b"], "y", ["symbol"], "t", size=12, generations=2, depth=2, elite=2, seed=1)
    tree = ("+", ("delay", "a", 3), "b")
    assert search.spots(tree) == [(), (1,), (1, 1), (2,)] and search.graft(tree, (1, 1), "c") == ("+", ("delay", "c", 3), "b")


def test_double_hits_are_drilled(spark):
    bars = spark.createDataFrame([("s", 0, 100.0, 101.0, 99.0), ("s", 60, 100.0, 120.0, 80.0), ("s", 240, 100.0, 101.0, 99.0)], "symbol string, t long, open double, high double, low double")
    low = spark.createDataFrame([("s", 60, 100.0, 101.0, 80.0), ("s", 90, 100.0, 120.0, 100.0)], bars.schema)
    ev = spark.createDataFrame([("s", 0, 1, 100.0, 0.1), ("s", 0, -1, 100.0, 0.1), ("s", 7, 1, 100.0, 0.1), ("s", 240, 1, 100.0, None)], "symbol string, t0 long, side int, entry_price double, vol double")
    run = lambda **o: {(r.t0, r.side): (r.label, r.t1) for r in labels.triple_barrier(bars, ev, ["symbol"], "t", 2, 60, 1.0, 1.0, **o).collect()}
    assert run(low=low, both="win") == {(0, 1): (0, 60), (0, -1): (1, 60), (7, 1): (None, None), (240, 1): (None, None)}
    assert run(both="win")[0, 1] == (1, 60) and run(both="nan")[0, 1] == (None, 60) and run(both="nearer")[0, 1] == (0, 60)


def test_all_dimensions_are_paired(spark):
    queries, folder = plans.queries(), "/root/testdata/sf0.001"
    x = np.array([r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()], float)
    r = np.corrcoef(x.T)
    d = np.sqrt(np.maximum(2 * (1 - r), 0))
    got = {(p.a, p.b): p for p in queries["pair_distances_all"](spark, folder).collect()}
    assert set(got) == {(f"d{i}", f"d{j}") for i in range(64) for j in range(i + 1, 64)}
    assert all(got[f"d{i}", f"d{j}"].r == pytest.approx(r[i, j], abs=1e-6) and got[f"d{i}", f"d{j}"].d == pytest.approx(d[i, j], abs=1e-6) for i in range(64) for j in range(i + 1, 64))
    near = {(f"d{i}", f"d{j}") for i in range(64) for j in [k for k in np.argsort(d[i]) if k != i][:2]}
    assert {tuple(p) for p in queries["top_k_pairs_all"](spark, folder).collect()} == near
    groups = [np.arange(c, 64, 3) for c in range(3)]
    medoids = {c: f"d{g[np.argmin(d[np.ix_(g, g)].mean(axis=1))]}" for c, g in enumerate(groups)}
    assert {m.cluster: m.item for m in queries["cluster_medoids_all"](spark, folder).collect()} == medoids
    scores = {s.cluster: s for s in queries["cluster_scores_all"](spark, folder).collect()}
    for c, g in enumerate(groups):
        intra = d[np.ix_(g, g)].sum() / (len(g) * (len(g) - 1))
        inter = min(d[np.ix_(g, o)].mean() for k, o in enumerate(groups) if k != c)
        assert (scores[c].intra, scores[c].inter) == pytest.approx((intra, inter), abs=2e-6)


def test_pairs_with_missing_values(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 1.0, 5.0), (None, 4.0, 5.0), (4.0, 3.0, 5.0)], "p double, q double, r double")
    got = {(x.a, x.b): x.r for x in stats.pair_products(df, ["p", "q", "r"]).collect()}
    assert got["p", "q"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 1, 3])[0, 1]) and got["p", "r"] is None


def test_every_symbol_is_fitted(spark):
    queries, folder = plans.queries(), "/root/testdata/sf0.001"
    rows = queries["ridge_predictions_all"](spark, folder).collect()
    counts = {r.symbol: r["count"] - 1 for r in adapters.bars(spark, folder).groupBy("symbol").count().collect()}
    assert {s: sum(r.symbol == s for r in rows) for s in counts} == counts and len(counts) == 5
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries["ridge_predictions"](spark, folder).collect()))
    assert {r.symbol: r.n for r in queries["ridge_backtest_all"](spark, folder).collect()} == counts
