"""Curves of several classes and components for each fold against numpy."""

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import components, curves, folds


def plain_areas(score, hit):
    order = np.argsort(-score, kind="stable")
    s, h = score[order], hit[order]
    ends = np.flatnonzero(np.append(np.diff(s) != 0, True))
    tp, n = np.cumsum(h)[ends], ends + 1
    fp = n - tp
    tpr, fpr = tp / tp[-1], fp / fp[-1]
    auc = float(np.sum(np.diff(fpr, prepend=0) * (tpr + np.append(0, tpr[:-1])) / 2))
    return auc, float(np.sum(np.diff(tp, prepend=0) / tp[-1] * tp / n))


def test_curves_of_three_classes(spark):
    rng = np.random.default_rng(0)
    n = 3000
    p = rng.dirichlet([1, 2, 3], n).round(2)
    d = pd.DataFrame({"g": rng.integers(0, 2, n), "y": [int(rng.choice(3, p=q / q.sum())) for q in p], "p0": p[:, 0], "p1": p[:, 1], "p2": p[:, 2]})
    df = spark.createDataFrame(d)
    got = {(r.g, r.curve): (r.auc, r.ap) for r in curves.curve_areas(df, ["g"], "y", ["p0", "p1", "p2"]).collect()}
    for g, own in d.groupby("g"):
        each = [plain_areas(own[f"p{k}"].to_numpy(), (own.y == k).to_numpy().astype(int)) for k in range(3)]
        for k in range(3):
            assert got[g, str(k)] == pytest.approx(each[k])
        assert got[g, "macro"] == pytest.approx(np.mean(each, axis=0).tolist())
        score, hit = own[["p0", "p1", "p2"]].to_numpy().ravel(), np.eye(3, dtype=int)[own.y].ravel()
        assert got[g, "micro"] == pytest.approx(plain_areas(score, hit))
    points = curves.curve_points(df.where("g = 0"), [], "y", ["p0", "p1", "p2"]).where("curve = '1'").orderBy("score").toPandas()
    own = d[d.g == 0]
    for r in points.iloc[[0, 17, len(points) - 1]].itertuples():
        said = own.p1 >= r.score
        assert (r.tp, r.fp) == ((said & (own.y == 1)).sum(), (said & (own.y != 1)).sum())


def test_a_class_without_rows_has_no_area(spark):
    df = spark.createDataFrame([(0, 0.7, 0.2, 0.1), (1, 0.2, 0.7, 0.1), (None, 1.0, 0.0, 0.0), (1, None, 0.5, 0.5)], "y int, a double, b double, c double")
    got = {r.curve: (r.auc, r.ap) for r in curves.curve_areas(df, [], "y", ["a", "b", "c"]).collect()}
    assert got == {"0": (1.0, 1.0), "1": (1.0, 1.0), "2": (None, None), "micro": got["micro"], "macro": (1.0, 1.0)}
    assert curves.curve_areas(df.limit(0), [], "y", ["a", "b", "c"]).where("curve <> 'macro'").count() == 0


def test_components_of_folds(spark):
    rng = np.random.default_rng(1)
    n, d, embargo = 900, 6, 20
    base = rng.normal(size=(n, 3))
    x = np.concatenate([base, base @ rng.normal(size=(3, 2)) + rng.normal(size=(n, 2)), np.full((n, 1), 5.0)], axis=1) + 1e4
    x[rng.random((n, d)) < 0.05] = np.nan
    x[:, 5] = 5.0
    names = [f"f{k}" for k in range(d)]
    t = np.arange(n) * 3
    pdf = pd.DataFrame(x, columns=names).assign(t=t, id=np.arange(n))
    df = spark.createDataFrame(pdf).repartition(4)
    f = folds.blocks(df, "t", 4)
    models = components.fit_folds(df, names, f, "t", 3, embargo)
    blocks = sorted((r.fold, r.lo, r.hi) for r in f.collect())
    last = np.full(n, -1)
    fitted = {}
    for m, (fold, lo, hi) in zip(models, blocks):
        train = (t < lo - embargo) | (t > hi + embargo)
        mean = np.nanmean(x[train], axis=0)
        z = np.where(np.isnan(x), mean, x) - mean
        sd = z[train].std(axis=0)
        sd[sd < 1e-9] = 1
        z = z / sd
        u, s, v = np.linalg.svd(z[train], full_matrices=False)
        v = v[:3] * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:3, None]
        assert m.fold == fold and m.n == train.sum()
        np.testing.assert_allclose(m.shares, (s**2 / (s**2).sum())[:3], rtol=1e-7)
        np.testing.assert_allclose(m.loadings, v, atol=1e-6)
        last[train | ((t >= lo) & (t <= hi))] = fold
        fitted[fold] = z @ v.T
    got = components.fold_scores(df, names, f, "t", models, ["id"], embargo).toPandas().set_index("id").sort_index()
    assert got.fold.tolist() == last.tolist() and len(set(last)) > 1
    np.testing.assert_allclose(np.stack(got.pc), [fitted[k][i] for i, k in enumerate(last)], atol=1e-5)
    shares, loads = components.component_tables(spark, models, names)
    assert shares.count() == 12 and loads.count() == 72
