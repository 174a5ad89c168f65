"""Ranks, places and expanding order statistics by cells against plain forms, with hot groups, ties, nulls and values of any size."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import ranks as R
from tapeloom.operators import stats
from tapeloom.operators.windows import exponential_mean


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(3), []
    for s, n in (("a", 700), ("b", 300), (None, 40), ("c", 1)):
        for i in range(n):
            x = rng.choice([None, float("nan"), 1.0, 1.0, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1) * 10 ** rng.randrange(300), round(rng.gauss(0, 1), 1)])
            out.append((s, i * 7 - 50, x))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "s string, t long, x double").repartition(5)


def series(rows):
    for s in {r[0] for r in rows}:
        yield s, [(t, x) for own, t, x in rows if own == s]


def equal(got, want, name):
    found = {(r.s, r.t): r[name] for r in got}
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert (found[k] is None) == (v is None) and (v is None or found[k] == pytest.approx(v, rel=1e-12)), k


def test_ranks_and_shares(df, rows):
    known = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    want = {}
    for s, own in series(rows):
        r = pd.Series([x for _, x in own], dtype=float)
        want |= {(s, t): None if math.isnan(k) else k for (t, _), k in zip(own, r.rank())}
        assert len(r)
    equal(R.with_rank(known, ["s"], "x", "r").collect(), want, "r")
    n = {s: sum(x is not None and x == x for _, x in own) for s, own in series(rows)}
    equal(R.with_pct_rank(known, ["s"], "x", "r").collect(), {k: None if v is None else v / n[k[0]] for k, v in want.items()}, "r")


def test_places_and_quantiles(df, rows):
    want = {(s, t): i for s, own in series(rows) for i, (t, _) in enumerate(sorted(own))}
    equal(R.numbered(df, ["s"], "t").collect(), want, "i")
    levels = [0, 0.1, 0.5, 0.77, 1]
    known = np.array([x for _, _, x in rows if x is not None and x == x])
    found = R.exact_quantiles(df.withColumn("none", F.lit(None).cast("double")), {"x": levels, "none": levels, "t": [0.5]})
    assert found["x"] == pytest.approx(np.quantile(known, levels).tolist()) and found["none"] == [] and found["t"] == [np.quantile([t for _, t, _ in rows], 0.5)]


@pytest.mark.parametrize("cell, most", [(16, 1024), (4096, 1024), (8, 10)])
def test_expanding_ranks_and_quantiles(df, rows, cell, most):
    ranks, quantiles = {}, {}
    for s, own in series(rows):
        past = []
        for t, x in own:
            quantiles[s, t] = np.quantile(past, 0.7) if len(past) >= 5 else None
            ranks[s, t] = None
            if x is not None and x == x:
                past.append(x)
                a = np.array(past)
                if len(past) >= 5:
                    ranks[s, t] = ((a < x).sum() + ((a == x).sum() + 1) / 2) / len(past)
    equal(R.expanding_pct_rank(df, ["s"], "t", "x", 5, cell, most).collect(), ranks, "pct_rank")
    equal(R.expanding_quantile(df, ["s"], "t", "x", {"q": 0.7}, 5, cell, most).collect(), quantiles, "q")


def test_counting_and_selecting_within_a_cell():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100, 1000):
        v = rng.integers(0, n // 2 + 1, n)
        assert R.smaller_before(v).tolist() == [int((v[:i] < v[i]).sum()) for i in range(n)]
        times, until = rng.permutation(n), rng.integers(1, n + 1, 50)
        place = (rng.random(50) * [(times < u).sum() for u in until]).astype(int)
        for u, p, at in zip(until, place, R.select_before(times, until, place)):
            assert times[at] < u and (times[:at] < u).sum() == p


def test_one_hot_group_is_many_cells(spark):
    """A million continuous values of one group, with outliers: no window spans more than a part of them, and no plan sorts or numbers the group."""
    n = 1_000_000
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        x = F.when(F.col("id") % 100_000 == 0, F.exp(F.col("id") / 5000.0)).otherwise(F.rand(7))
        df = spark.range(n).select(F.lit("hot").alias("s"), F.col("id").alias("t"), x.alias("x"))
        counts = R.written(df.groupBy("s", "x").agg(F.count(F.lit(1)).alias("ties")), "hot")
        parts = R.dealt(counts, ["s"], "x").groupBy("s", "part").count().collect()
        assert len(parts) >= 12 and max(r["count"] for r in parts) < n / 6
        ranked = R.below(counts, ["s"], "x", ["ties"])
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if " Window [" in line]
        assert windows and all("part" in line for line in windows)
        r = ranked.agg(F.max("below ties").alias("top"), F.countDistinct("below ties").alias("places")).first()
        assert r.top == n - 1 and r.places == n
        middle = R.exact_quantiles(df, {"x": [0.5]})["x"][0]
        assert abs(df.where(F.col("x") < middle).count() - n / 2) <= 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_exponential_mean_of_alpha_one_is_the_value(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 5.0)], "s string, t long, x double")
    assert sorted(tuple(r) for r in exponential_mean(df, ["s"], "t", "x", 1.0).select("t", "i", "ewm").collect()) == [(1, 0, 2.0), (3, 1, 5.0)]


def test_rank_correlation_of_groups(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 800), "x": rng.integers(0, 30, 800).astype(float), "y": rng.normal(size=800).round(1)})
    pdf.loc[pdf.g == 3, "x"] = 1.0
    df = spark.createDataFrame(pdf)
    got = {r.g: r.ic for r in stats.rank_ic(df, ["g"]).collect()}
    for g, own in pdf.groupby("g"):
        assert got[g] is None if g == 3 else got[g] == pytest.approx(own.x.rank().corr(own.y.rank()))
