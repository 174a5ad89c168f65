"""Rules that tables, thresholds, folds and clusters keep, and tables that streams keep."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import alpha, selection, stats, windows
from tapeloom.streaming import bars as streams


def test_thresholds_at_quantiles(spark):
    rng = np.random.default_rng(3)
    score = np.round(rng.normal(size=300), 2)
    y = (score + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(float(s), int(t)) for s, t in zip(score, y)] + [(None, 1), (float("nan"), 0)], "score double, y int")
    grid = stats.quantile_grid(df, 21)
    assert np.allclose(grid, np.unique(np.quantile(score, np.linspace(0, 1, 21))))

    def plain(t, one):
        said, real = (score >= t) == one, (y == 1) == one
        tp = (said & real).sum()
        p, r = tp / said.sum() if said.any() else 0.0, tp / real.sum() if real.any() else 0.0
        return 1.25 * p * r / (0.25 * p + r) if tp else 0.0

    grid = [*grid, 99.0]
    got = stats.threshold_scores(df, grid).orderBy("threshold").collect()
    assert [r.threshold for r in got] == grid
    assert np.allclose([r.fbeta for r in got], [plain(t, True) for t in grid])
    assert np.allclose([r.macro for r in got], [(plain(t, True) + plain(t, False)) / 2 for t in grid])
    assert stats.quantile_grid(df.limit(0)) == [] and stats.quantile_grid(spark.createDataFrame([(2.0,)] * 3, "score double")) == [2.0]


def test_fills_and_spacing_refuse(spark):
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 60, 2.0), ("s", 180, None)], "k string, t long, x double")
    assert windows.fill(df.where("t < 180"), ["k"], "t", ["x"], "raise").count() == 2
    with pytest.raises(Exception, match="no number in x"):
        windows.fill(df, ["k"], "t", ["x"], "raise").collect()
    assert [r.t for r in windows.require_spacing(df.where("t < 180"), ["k"], "t", 60).orderBy("t").collect()] == [0, 60]
    with pytest.raises(Exception, match="uneven step at 180"):
        windows.require_spacing(df, ["k"], "t", 60).collect()


def test_other_measures_of_alphas(spark):
    rng = np.random.default_rng(4)
    a, y = rng.normal(size=50), rng.normal(size=50)
    df = spark.createDataFrame([("s", float(p), float(q)) for p, q in zip(a, y)], "symbol string, a double, y double")
    gain = np.sign(a) * y
    assert alpha.fitness(df, ["a"], "y", ["symbol"], alpha.sign_sharpe).first().ic == pytest.approx(gain.mean() / gain.std())
    assert alpha.fitness(df, ["a"], "y", ["symbol"]).first().ic == pytest.approx(np.corrcoef(a, y)[0, 1])


def test_short_folds_go(spark):
    day = 86_400_000
    times = spark.createDataFrame([(d * day,) for d in range(90)], "t long")  # January, February and March 1970
    folds = selection.purged_months(times, "t", 3, day)
    spans = {f.fold: (lambda kept: max(kept) - min(kept) + 1)([d for d in range(90) if d * day < f.train_before or d * day >= f.train_from]) for f in folds.collect()}
    for least in (1, 60, 85, 91):
        assert {f.fold for f in selection.long_enough(times, "t", folds, least).collect()} == {f for f, n in spans.items() if n >= least}
    assert selection.long_enough(times, "t", folds.limit(0)).count() == 0


def test_best_of_several_starts(spark):
    rows = [(i, [float(v), float(v) + 0.1]) for i, v in enumerate([0.0, 0.1, 0.2, 9.0, 9.1, 9.2])]
    series = spark.createDataFrame(rows, "id int, x array<double>")
    bad, good = [[0.0, 0.1], [0.1, 0.2]], [[0.0, 0.1], [9.0, 9.1]]
    found, centres, inertia = selection.msm_clusters_best(series, [[[0.0, 0.1], [500.0, 500.0]], good], rounds=5)
    labels = {r.id: (r.cluster, r.d) for r in found.collect()}
    assert {i: c for i, (c, _) in labels.items()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    assert inertia == pytest.approx(sum(d * d for _, d in labels.values())) and np.allclose(centres, [[0.1, 0.2], [9.1, 9.2]])
    far = selection.msm_clusters(series, [[0.0, 0.1], [500.0, 500.0]], rounds=5, reseed=True)[0]
    kept = selection.msm_clusters(series, [[0.0, 0.1], [500.0, 500.0]], rounds=5)[0]
    assert len({r.cluster for r in far.collect()}) == 2 and len({r.cluster for r in kept.collect()}) == 1
    assert len({r.cluster for r in selection.msm_clusters_best(series, [bad, good], rounds=5)[0].collect()}) == 2


def _stream(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def _run(stream, sink, checkpoint):
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_latest_rows_without_rewriting(spark, tmp_path):
    schema, path = "k string, seq long, v double", str(tmp_path / "table")
    rng, want = np.random.default_rng(8), {}
    sink = streams.append_latest(path, ["k"], "seq", every=2)
    for batch in range(5):
        rows = [(f"k{rng.integers(4)}", batch * 10 + i, float(rng.normal())) for i in range(6)]
        want |= {k: (s, v) for k, s, v in rows}
        _run(_stream(spark, str(tmp_path / "in"), rows, schema), sink, str(tmp_path / "cp"))
        assert {r.k: (r.seq, r.v) for r in streams.read_latest(spark, path, ["k"], "seq").collect()} == want
    again = spark.createDataFrame(rows, schema)
    sink(again, 4), sink(spark.read.parquet(f"{path}/kind=part/version=3"), 3)  # batches that come again
    assert {r.k: (r.seq, r.v) for r in streams.read_latest(spark, path, ["k"], "seq").collect()} == want
    assert sorted(p.name for p in (tmp_path / "table" / "kind=base").iterdir()) == ["version=1", "version=3"]


def test_days_and_newest_books_of_streams(spark, tmp_path):
    late = 1_704_124_800_000  # midnight of 2 January 2024 in Taipei
    source = _stream(spark, str(tmp_path / "in"), [("a", late - 1), ("b", late), (None, late + 5)], "symbol string, recv_ms long")
    streams.write_days_on_arrival(source, str(tmp_path / "days"), str(tmp_path / "cp"), once=True).awaitTermination()
    found = {d.name: sorted(json.loads(line)["recv_ms"] for f in d.glob("*.json") for line in f.read_text().splitlines()) for d in (tmp_path / "days").glob("dt=*")}
    assert found == {"dt=2024-01-01": [late - 1], "dt=2024-01-02": [late, late + 5]}

    book = lambda s, seq, top: [(s, "bid", top - i, 1.0 + i, seq) for i in range(3)] + [(s, "ask", top + 1 + i, 2.0 + i, seq) for i in range(3)]
    schema, path = "symbol string, side string, price double, qty double, seq long", str(tmp_path / "book")
    sink = streams.newest_book(path, 2)
    for rows in (book("x", 1, 10.0) + book("x", 2, 20.0) + book("y", 1, 5.0), book("x", 3, 30.0)):
        _run(_stream(spark, str(tmp_path / "books"), rows, schema), sink, str(tmp_path / "cp2"))
    got = {(r.symbol, r.side, r.level): r.price for r in spark.read.parquet(path).collect()}
    assert got == {("x", "bid", 1): 30.0, ("x", "bid", 2): 29.0, ("x", "ask", 1): 31.0, ("x", "ask", 2): 32.0, ("y", "bid", 1): 5.0, ("y", "bid", 2): 4.0, ("y", "ask", 1): 6.0, ("y", "ask", 2): 7.0}
