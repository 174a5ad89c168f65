"""Feature selection and model reports: curves, redundancy, move-split-merge distances and clusters, principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import EPS, ratio
from .ranks import below, join_on, streamed
from .windows import positions


def roc_points(scores: DataFrame, steps: int = 101) -> DataFrame:
    """(threshold, tpr, fpr, precision) on an even grid of thresholds: scores are binned first, then cumulated over the bins."""
    b = F.least(F.floor(F.col("score") * (steps - 1) + 1e-9), F.lit(steps - 1)).cast("int")
    binned = scores.select(b.alias("b"), F.col("y").cast("long").alias("y")).groupBy("b").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    grid = scores.sparkSession.range(steps).select(F.col("id").cast("int").alias("b")).join(F.broadcast(binned), "b", "left").fillna(0)
    down, one = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(F.lit(0))  # a row for each step
    g = grid.select("b", F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("said"), F.sum("pos").over(one).alias("p"), F.sum("n").over(one).alias("all"))
    return g.select((F.col("b") / (steps - 1.0)).alias("threshold"), ratio(F.col("tp") * 1.0, F.col("p")).alias("tpr"), ratio((F.col("said") - F.col("tp")) * 1.0, F.col("all") - F.col("p")).alias("fpr"), ratio(F.col("tp") * 1.0, F.col("said")).alias("precision"))


def average_precision(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, ap) of (score, y): the precision at each distinct score, weighted by the share of ones that it adds. Equal scores are counted together first."""
    counts = scores.where(F.col("score").isNotNull() & F.col("y").isNotNull()).groupBy(*by, "score").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("all pos"), F.sum("n").alias("all n"))
    steps = join_on(below(counts, by, "score", ["pos", "n"]), totals, by).withColumn("precision", (F.col("`all pos`") - F.col("`below pos`")) / (F.col("`all n`") - F.col("`below n`")))
    return steps.groupBy(*by).agg(ratio(F.sum(F.col("pos") * F.col("precision")), F.sum("pos")).alias("ap"))


def correlation_matrix(pairs: DataFrame, names: list[str]) -> np.ndarray:
    """The symmetric matrix of (a, b, r) rows; as small as the number of features squared."""
    at = {n: i for i, n in enumerate(names)}
    m = np.eye(len(names))
    for a, b, r in pairs.select("a", "b", "r").collect():
        m[at[a], at[b]] = m[at[b], at[a]] = 0.0 if r is None else r
    return m


def variance_inflation(pairs: DataFrame, names: list[str], most: int = 100) -> dict[str, float]:
    """Diagonal of the inverse correlation matrix; nothing beyond ``most`` features."""
    if len(names) > most:
        return {}
    return dict(zip(names, np.diag(np.linalg.pinv(correlation_matrix(pairs, names))).tolist()))


def linkage_clusters(pairs: DataFrame, names: list[str], cut: float) -> dict[str, int]:
    """Average-linkage clusters of features: the nearest two are joined while they are nearer than ``cut``. The pair table is small."""
    at = {n: i for i, n in enumerate(names)}
    d = np.full((len(names), len(names)), np.inf)
    for a, b, x in pairs.select("a", "b", "d").collect():
        d[at[a], at[b]] = d[at[b], at[a]] = x
    members, live = {i: [i] for i in range(len(names))}, list(range(len(names)))
    while len(live) > 1:
        sub = d[np.ix_(live, live)]
        i, j = divmod(int(sub.argmin()), len(live))
        if not sub[i, j] < cut:
            break
        a, b = live[min(i, j)], live[max(i, j)]
        na, nb = len(members[a]), len(members[b])
        d[a] = d[:, a] = (na * d[a] + nb * d[b]) / (na + nb)
        d[a, a] = np.inf
        members[a] += members.pop(b)
        live.remove(b)
    return {names[i]: k for k, a in enumerate(live) for i in members[a]}


def msm(x: np.ndarray, y: np.ndarray, c: float = 1.0, limit: float = np.inf) -> float:
    """Move-split-merge distance of two series: dynamic programming over anti-diagonals, each computed as one vector. Infinite once it is known to be above
    ``limit``: costs are no less than zero, and every path meets one of two neighbouring diagonals."""
    n, m = len(x), len(y)
    if not n or not m:
        return float(c * (n + m))

    def cost(new: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        inside = (np.minimum(a, b) <= new) & (new <= np.maximum(a, b))
        return np.where(inside, c, c + np.minimum(np.abs(new - a), np.abs(new - b)))

    # best[i] of a diagonal is the cell (i, diagonal - i); three diagonals are held, so memory grows with the length and not with its square
    before, last = np.full(n, np.inf), np.full(n, np.inf)
    last[0] = abs(x[0] - y[0])
    for k in range(1, n + m - 1):
        best = np.full(n, np.inf)
        i = np.arange(max(1, k - m + 1), min(n - 1, k - 1) + 1)
        if len(i):
            j = k - i
            up, left = last[i - 1] + cost(x[i], x[i - 1], y[j]), last[i] + cost(y[j], x[i], y[j - 1])
            best[i] = np.minimum(before[i - 1] + np.abs(x[i] - y[j]), np.minimum(up, left))
        if k < n:
            best[k] = last[k - 1] + cost(x[k], x[k - 1], y[0])
        if k < m:
            best[0] = last[0] + cost(y[k], x[0], y[k - 1])
        before, last = last, best
        if min(before.min(), last.min()) > limit:
            return np.inf
    return float(last[-1])


def nearest(x: np.ndarray, centres: list[np.ndarray], c: float = 1.0) -> tuple[int, float]:
    """(number, distance) of the nearest centre, the first of equals. A distance is at least that of the first values, so centres are tried in that order, the later ones only
    as far as they may still be nearest."""
    bounds = [abs(float(x[0]) - float(v[0])) if len(x) and len(v) else 0.0 for v in centres]
    best, at = np.inf, 0
    for k in sorted(range(len(centres)), key=bounds.__getitem__):
        if bounds[k] > best:
            break
        d = msm(x, centres[k], c, best)
        if d < best or (d == best and k < at):
            best, at = d, k
    return at, float(best)


def msm_pairs(series: DataFrame, c: float = 1.0, blocks: int = 16) -> DataFrame:
    """(a, b, d) for a < b of (id, x array<double>), ids unique.

    Series are dealt into blocks by the hash of their id, and every two blocks meet in a group of their own, so a series is sent once for each block and not once
    for each pair; a task holds two blocks."""
    kind = series.schema["id"].dataType.simpleString()
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = series.select("id", "x", own.alias("block")).withColumn("other", other)
    rows = rows.select(F.least("block", "other").alias("low block"), F.greatest("block", "other").alias("high block"), "block", "id", "x")

    def run(table: pa.Table) -> list:
        block, low, high = (table.column(k).to_numpy() for k in ("block", "low block", "high block"))
        ids, x = table.column("id").to_pylist(), [np.asarray(v) for v in table.column("x").to_pylist()]
        same = low[0] == high[0]
        first = np.flatnonzero(block == low[0]).tolist()
        pairs = [(i, j) for i in first for j in (first if same else np.flatnonzero(block == high[0]).tolist()) if (ids[i] < ids[j] if same else True)]
        pairs = [(i, j) if ids[i] < ids[j] else (j, i) for i, j in pairs]
        return [pa.array([ids[i] for i, _ in pairs], table.schema.field("id").type), pa.array([ids[j] for _, j in pairs], table.schema.field("id").type), pa.array([msm(x[i], x[j], c) for i, j in pairs], pa.float64())]

    return streamed(rows, ["low block", "high block"], ["block", "id"], f"a {kind}, b {kind}, d double", run)


def msm_clusters(series: DataFrame, centres: list[list[float]], c: float = 1.0, rounds: int = 20, tolerance: float = 1e-6, reseed: bool = False) -> tuple[DataFrame, list[list[float]]]:
    """K-means with the move-split-merge distance from given centres: (id, cluster, d) and the last centres.

    Assignment is a pass over the series with the centres in the closure; new centres are means by position, aggregated in
    Spark. An empty cluster keeps its centre or, with ``reseed``, takes the series farthest from its own. Only the centres come to the driver.
    """
    kind = series.schema["id"].dataType.simpleString()

    def assigned(now: list[list[float]]) -> DataFrame:
        held = [np.asarray(v) for v in now]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                found = [nearest(np.asarray(x), held, c) for x in p.x]
                yield pd.DataFrame({"id": p.id, "x": p.x, "cluster": [k for k, _ in found], "d": [d for _, d in found]})

        return series.select("id", "x").mapInPandas(run, f"id {kind}, x array<double>, cluster int, d double")

    for _ in range(rounds):
        means = assigned(centres).select("cluster", F.posexplode("x").alias("at", "v")).groupBy("cluster", "at").agg(F.avg("v").alias("v"))
        rows = means.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("c")).collect()  # as many rows as clusters
        new = list(centres)
        for r in rows:
            new[r.cluster] = [p.v for p in r.c]
        empty = sorted(set(range(len(centres))) - {r.cluster for r in rows})
        if reseed and empty:
            for k, far in zip(empty, assigned(centres).orderBy(F.desc("d"), "id").limit(len(empty)).collect()):
                new[k] = list(far.x)
        shift = max((float(np.linalg.norm(np.subtract(a, b))) for a, b in zip(new, centres)), default=0.0)
        centres = new
        if shift < tolerance:
            break
    return assigned(centres).drop("x"), centres


def msm_clusters_best(series: DataFrame, starts: list[list[list[float]]], c: float = 1.0, rounds: int = 20, tolerance: float = 1e-6) -> tuple[DataFrame, list[list[float]], float]:
    """``msm_clusters`` from each of several sets of centres: assignment, centres and sum of squared distances of the set with the least sum, the first of equals."""
    best = None
    for centres in starts:
        found, last = msm_clusters(series, centres, c, rounds, tolerance)
        inertia = found.agg(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0))).first()[0]
        if best is None or inertia < best[2]:
            best = found, last, inertia
    return best


def silhouette(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(item, s) from pair distances: (b - a) / max(a, b) with a the mean distance inside, b the least mean distance to another cluster."""
    left, right = clusters.select(F.col("item").alias("a"), F.col("cluster").alias("ca")), clusters.select(F.col("item").alias("b"), F.col("cluster").alias("cb"))
    both = pairs.select("a", "b", "d").union(pairs.select("b", "a", "d")).join(left, "a").join(right, "b").groupBy("a", "ca", "cb").agg(F.avg("d").alias("d"))
    s = both.groupBy(F.col("a").alias("item")).agg(F.max(F.when(F.col("ca") == F.col("cb"), F.col("d"))).alias("own"), F.min(F.when(F.col("ca") != F.col("cb"), F.col("d"))).alias("other"))
    return s.select("item", F.when(F.col("own").isNull(), 0.0).otherwise(ratio(F.col("other") - F.col("own"), F.greatest("own", "other"))).alias("s"))


def principal_components(df: DataFrame, columns: list[str], k: int, keep: list[str]) -> tuple[DataFrame, list[float]]:
    """(keep, pc array) and the explained shares: median imputation, scaling and PCA by MLlib."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    stages = [Imputer(inputCols=columns, outputCols=[f"{c}_full" for c in columns], strategy="median"), VectorAssembler(inputCols=[f"{c}_full" for c in columns], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PCA(k=k, inputCol="scaled", outputCol="pc_vector")]
    model = Pipeline(stages=stages).fit(df)
    return model.transform(df).select(*keep, vector_to_array("pc_vector").alias("pc")), [float(x) for x in model.stages[-1].explainedVariance]


def decile_returns(df: DataFrame, by: list[str], rank: str, ret: str, per_year: float = 96 * 365) -> DataFrame:
    """Mean of half the return of the top fifth less that of the bottom fifth of a ranked signal, by year; rows without rank are left out."""
    side = F.when(F.col(rank) >= 0.8, F.col(ret)).when(F.col(rank) <= 0.2, -F.col(ret)).otherwise(0.0) / 2
    return df.where(F.col(rank).isNotNull() & F.col(ret).isNotNull()).groupBy(*by).agg((F.avg(side) * per_year).alias("yearly"), F.count_if(F.col(rank) >= 0.8).alias("longs"), F.count_if(F.col(rank) <= 0.2).alias("shorts"))


def side_of(x: Column) -> Column:
    """1 or -1 from numbers or words for long and short; null for anything else."""
    word, number = F.lower(F.trim(x.cast("string"))), x.cast("string").try_cast("double")
    return F.when(word.isin("long", "buy", "多"), 1).when(word.isin("short", "sell", "空"), -1).when(number > 0, 1).when(number < 0, -1)


def order_size(budget: Column, leverage: Column, price: Column, least: float, most: float, slippage_bps: Column, max_slippage_bps: float, open_orders: Column, max_open: int, free: Column | None = None, buffer: float = 0.05) -> list[Column]:
    """Notional, quantity and the first reason against an order (null: none). With ``free`` cash the margin, notional over leverage and a buffer, must not exceed it."""
    notional = budget * leverage
    reason = F.when(notional < least, "below_min_notional").when(notional > most, "above_max_notional").when(slippage_bps > max_slippage_bps, "slippage").when(open_orders >= max_open, "open_orders")
    if free is not None:
        reason = reason.when(ratio(notional, leverage) * (1 + max(0.0, buffer)) > free, "margin")
    return [notional.alias("notional"), ratio(notional, price).alias("quantity"), reason.alias("rejected")]


def vote_backtest(bars: DataFrame, events: DataFrame, by: list[str], on: str, cash: float = 1000.0, fee: float = 0.001) -> DataFrame:
    """Trades of a portfolio that holds one position at a time: (by, entry, exit, side, pnl) from events (t0, t1, side).

    An event is taken if no earlier taken one is still open; its exit may not lie on its entry bar. The choice depends on the one
    before, so it is a pass over the events of each key, which are few; prices are joined in Spark.
    """

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        free, taken = -np.inf, []
        for row in pdf.sort_values(["t0", "t1", "side"]).itertuples(index=False):
            if row.t0 >= free and row.t1 > row.t0:
                taken.append(row)
                free = row.t1
        return pd.DataFrame(taken, columns=pdf.columns)

    cols = events.select(*by, "t0", "t1", "side")
    chosen = cols.groupBy(*by).applyInPandas(take, cols.schema)
    price = bars.select(*by, F.col(on), F.col("close"))
    out = chosen.join(price.withColumnsRenamed({on: "t0", "close": "p0"}), [*by, "t0"]).join(price.withColumnsRenamed({on: "t1", "close": "p1"}), [*by, "t1"])
    gross = F.col("side") * (F.col("p1") / F.when(F.abs("p0") > EPS, F.col("p0")) - 1)
    return out.select(*by, F.col("t0").alias("entry"), F.col("t1").alias("exit"), "side", (cash * (gross - 2 * fee)).alias("pnl"))


def purged_months(times: DataFrame, on: str, k: int, embargo: int = 0, every: Column | None = None) -> DataFrame:
    """(fold, test_start, test_end): the months cut into k groups, the first ones longer; the last month of each group is tested."""
    from .folds import months

    m = months(times, on)
    w = W.orderBy("i")  # a row for each month
    g = m.withColumn("fold", F.ntile(k).over(w) - 1)
    last = g.groupBy("fold").agg(F.max_by("start", "i").alias("test_start"), F.max("next").alias("test_end"))
    return last.withColumns({"train_before": F.col("test_start") - embargo, "train_from": F.col("test_end") + embargo})


def long_enough(times: DataFrame, on: str, folds: DataFrame, days: int = 30) -> DataFrame:
    """Folds (of ``purged_months``) whose training times span at least ``days`` days, first and last counted: one aggregate with two values a fold."""
    day = F.floor(F.col(on) / 86_400_000)
    bounds = folds.select("fold", "train_before", "train_from").collect()  # a row for each fold
    if not bounds:
        return folds
    outside = lambda f: F.when((F.col(on) < f.train_before) | (F.col(on) >= f.train_from), day)
    spans = times.agg(*[(F.max(outside(f)) - F.min(outside(f)) + 1).alias(str(f.fold)) for f in bounds]).first()
    return folds.where(F.col("fold").isin([f.fold for f in bounds if (spans[str(f.fold)] or 0) >= days]))


def top_loadings(loadings: DataFrame, n: int) -> DataFrame:
    """The n features with the greatest absolute loading on each component, of (component, feature, loading); ties by name."""
    order = W.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
    return loadings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def ranked_features(report: DataFrame, score: str, k: int) -> DataFrame:
    """The k best features by score and all with ``reject``, each once, in order of score."""
    place = F.row_number().over(W.orderBy(F.desc_nulls_last(score), "feature"))  # a row for each feature
    return report.withColumn("place", place).where((F.col("place") <= k) | F.col("reject")).orderBy("place")


def temperature(logits: DataFrame, steps: int = 60) -> float:
    """The temperature that gives the least cross-entropy of (logit, y): a grid narrowed four times, one aggregate for all probes of a round."""
    low, high = 0.05, 20.0
    for _ in range(4):
        probes = [low * (high / low) ** (k / (steps - 1)) for k in range(steps)]
        loss = lambda t: F.avg(F.log1p(F.exp(-F.when(F.col("y") == 1, F.col("logit")).otherwise(-F.col("logit")) / t)))
        row = logits.agg(*[loss(t).alias(f"p{k}") for k, t in enumerate(probes)]).first()
        best = min(range(steps), key=lambda k: row[k] if row[k] is not None else 0.0)
        low, high = probes[max(best - 1, 0)], probes[min(best + 1, steps - 1)]
    return (low * high) ** 0.5


def softmax_temperature(logits: DataFrame, steps: int = 60) -> float:
    """``temperature`` for several classes, of (logits array, y the class)."""
    top = F.array_max("logits")
    low, high = 0.05, 20.0
    for _ in range(4):
        probes = [low * (high / low) ** (k / (steps - 1)) for k in range(steps)]
        loss = lambda t: F.avg(F.log(F.aggregate("logits", F.lit(0.0), lambda a, z: a + F.exp((z - top) / t))) + (top - F.get("logits", F.col("y").cast("int"))) / t)
        row = logits.agg(*[loss(t).alias(f"p{k}") for k, t in enumerate(probes)]).first()
        best = min(range(steps), key=lambda k: row[k] if row[k] is not None else 0.0)
        low, high = probes[max(best - 1, 0)], probes[min(best + 1, steps - 1)]
    return (low * high) ** 0.5


def ridge_predictions(df: DataFrame, features: list[str], y: str, on: str, k: int, embargo: float = 0.01, alpha: float = 10.0, cell: int = 86_400_000, by: list[str] | None = None) -> DataFrame:
    """Add fold and pred: out-of-fold ridge regression over k contiguous blocks of rows in order of the times ``on``, unique in a series of ``by``.

    Every series is fitted on its own. A fold trains on the rows outside its block and int(n * embargo) rows on either side, with features scaled by the moments of those
    rows and a penalty of ``alpha`` on the scaled weights. All folds are one aggregate of sums of products (partial on each
    task); only k rows of (features squared) sums of each series come to the driver, so for some hundred features at most. Rows with nulls or
    NaN or without a key are left out; a constant feature has weight 0, and a fold without training rows no prediction.
    """
    cols, keys = [*features, y], [*(by or []), "one_key"]
    good = F.lit(True)
    for c in cols:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = positions(df.where(good).withColumn("one_key", F.lit(0)), keys, on, cell)
    key_types = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by or []] + ["one_key int"]
    heads = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(f"mean_{j}") for j, c in enumerate(cols)]).collect()  # a row for each series
    spans, middles = [], {}
    for r in heads:
        size, extra = divmod(r.n_rows, k)
        starts = [f * size + min(f, extra) for f in range(k + 1)]
        around, key = int(r.n_rows * embargo), tuple(r[c] for c in keys)
        middles[key] = [float(r[f"mean_{j}"]) for j in range(len(cols))]
        spans += [(*key, f, starts[f], starts[f + 1] - 1, starts[f] - around, starts[f + 1] - 1 + around, middles[key]) for f in range(k)]
    spans = rows.sparkSession.createDataFrame(spans, ", ".join([*key_types, "fold int, at_lo long, at_hi long, lo long, hi long, mid array<double>"]))
    rows = rows.join(F.broadcast(spans.drop("lo", "hi")), keys).where("i between at_lo and at_hi").drop("at_lo", "at_hi")  # k rows of spans for each series
    v = lambda names: F.array(*[F.col(c).cast("double") - F.col("mid")[j] for j, c in enumerate(names)])
    d = len(cols)
    centred = rows.select(*keys, "i", v(cols).alias("v"))
    train = centred.join(F.broadcast(spans.select(*keys, F.col("fold").alias("trained_for"), "lo", "hi")), keys).where("i < lo or i > hi")
    sums = train.groupBy(*keys, "trained_for").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("v")[a]) for a in range(d)]).alias("s"), F.array(*[F.sum(F.col("v")[a] * F.col("v")[b]) for a in range(d) for b in range(a, d)]).alias("p"))
    fitted = []
    for r in sums.collect():  # k rows for each series
        mean, products = np.array(r.s) / r.n, np.zeros((d, d))
        products[np.triu_indices(d)] = r.p
        cov = (products + np.triu(products, 1).T) / r.n - np.outer(mean, mean)
        std = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
        live = std > EPS
        scale = np.where(live, std, 1.0)
        z = r.n * cov[:-1, :-1] / np.outer(scale, scale)
        w = np.where(live, np.linalg.solve(z + alpha * np.eye(d - 1), r.n * cov[:-1, -1] / scale), 0.0) / scale
        key = tuple(r[c] for c in keys)
        fitted.append((*key, r.trained_for, w.tolist(), float(middles[key][-1] + mean[-1] - w @ mean[:-1])))
    models = rows.sparkSession.createDataFrame(fitted, ", ".join([*key_types, "fold int, w array<double>, b double"]))
    pred = F.col("b") + F.aggregate(F.zip_with("w", v(features), lambda a, x: a * x), F.lit(0.0), lambda a, x: a + x)
    return rows.join(F.broadcast(models), [*keys, "fold"], "left").withColumn("pred", pred).drop("w", "b", "i", "mid", "one_key")


def sign_report(predictions: DataFrame, y: str, per_year: float = 96 * 365, by: list[str] | None = None) -> DataFrame:
    """(n, sharpe, mean) of returns taken to the side of pred, of each series of ``by``: mean over population deviation, by year."""
    r = F.signum("pred") * F.col(y)
    rows = predictions.where("pred is not null").select(*(by or []), r.alias("r"))
    return rows.groupBy(*(by or [])).agg(F.count("r").alias("n"), F.avg("r").alias("mean"), (F.avg("r") / (F.stddev_pop("r") + 1e-9) * per_year**0.5).alias("sharpe"))
