"""Statistics of features, scores and ensembles, as aggregates over long tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import EPS, correlation, normal_cdf, ratio
from .ranks import below, exact_quantiles, join_on, numbered, rank_correlation


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "x") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def rank_sums(long: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Per group: n1, n0, the rank sum of the ones and the tie term, for AUC and its kin.

    Values are counted first, then ranked by cells (``ranks``), so no window spans a hot group.
    """
    counts = long.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("t"), F.sum(F.col(y).cast("long")).alias("ones"))
    ranked = below(counts, by, x, ["t"]).withColumn("r", F.col("`below t`") + (F.col("t") + 1) / 2.0)
    t = F.col("t").cast("double")
    return ranked.groupBy(*by).agg(F.sum("ones").alias("n1"), F.sum(F.col("t") - F.col("ones")).alias("n0"), F.sum(F.col("r") * F.col("ones")).alias("r1"), F.sum(t * t * t - t).alias("ties"))


def auc(long: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """Per group: AUC, U, rank-biserial correlation with its variance, z and 95 % interval; null where a class is missing."""
    s = rank_sums(long, by)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    ok = (n1 > 0) & (n0 > 0) & (n >= least)
    u = F.col("r1") - n1 * (n1 + 1) / 2
    pairs = F.when(ok, n1 * n0)
    rows = s.withColumns({"u": F.when(ok, u), "auc": F.when(ok, u / pairs)}).withColumn("rrb", 2 * F.col("auc") - 1)
    var_u = n1 * n0 / 12 * (n + 1 - ratio(F.col("ties"), n * (n - 1)))
    rows = rows.withColumn("var_rrb", F.when(ok, F.pow(2 / pairs, 2) * var_u))
    se = F.sqrt("var_rrb")
    return rows.withColumns({"z": ratio(F.col("rrb"), se), "ci_low": F.col("rrb") - 1.959963984540054 * se, "ci_high": F.col("rrb") + 1.959963984540054 * se}).drop("r1", "ties")


def p_two_sided(z: Column) -> Column:
    return F.greatest(2 * (1 - normal_cdf(F.abs(z))), F.lit(1e-300))


def fixed_effect(parts: DataFrame, by: list[str], effect: str = "rrb", var: str = "var_rrb") -> DataFrame:
    """Inverse-variance mean with standard error, z, two-sided p and 95 % interval."""
    w = 1 / F.when(F.col(var) > 0, F.col(var))
    out = parts.where(F.col(effect).isNotNull() & (F.col(var) > 0)).groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum(w * F.col(effect)).alias("we"), F.sum(w).alias("w"))
    out = out.select(*by, "k", (F.col("we") / F.col("w")).alias("mean"), F.sqrt(1 / F.col("w")).alias("se"), (F.col("we") / F.sqrt("w")).alias("z"))
    half = 1.959963984540054 * F.col("se")
    return out.withColumns({"p": p_two_sided(F.col("z")), "ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def random_effects(parts: DataFrame, by: list[str], effect: str = "rrb", var: str = "var_rrb") -> DataFrame:
    """DerSimonian-Laird: Q, tau2, I2 and the mean under tau2. Two aggregates, as sums of powers of the weights suffice."""
    good = parts.where(F.col(effect).isNotNull() & (F.col(var) > 0))
    e, w = F.col(effect), 1 / F.col(var)
    s = good.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * e).alias("we"), F.sum(w * e * e).alias("we2"))
    q, c = F.col("we2") - F.col("we") * F.col("we") / F.col("w"), F.col("w") - F.col("w2") / F.col("w")
    s = s.withColumns({"q": q, "tau2": F.when(c > 0, F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / F.when(c > 0, c))).otherwise(0.0)})
    s = s.withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.when(F.col("q") > 0, F.col("q")))).otherwise(0.0))
    v = F.col(var) + F.col("tau2")
    return good.join(s.select(*by, "k", "q", "tau2", "i2"), by).groupBy(*by, "k", "q", "tau2", "i2").agg((F.sum(e / v) / F.sum(1 / v)).alias("mean"), F.sqrt(1 / F.sum(1 / v)).alias("se"))


def stouffer(parts: DataFrame, by: list[str]) -> DataFrame:
    """Combined z of parts (auc, z, n1, n0): weights are roots of the sizes, signs those of AUC - 1/2."""
    w = F.sqrt((F.col("n1") + F.col("n0")).cast("double"))
    z = F.signum(F.col("auc") - 0.5) * F.abs("z")
    out = parts.where("z is not null").groupBy(*by).agg(F.sum(w * z).alias("a"), F.sum(w * w).alias("b"))
    return out.select(*by, (F.col("a") / F.sqrt("b")).alias("z")).withColumn("p", p_two_sided(F.col("z")))


def false_discovery(tests: DataFrame, p: str = "p", q: float = 0.05) -> DataFrame:
    """Add reject (Benjamini-Hochberg); a missing p counts as 1. ``tests`` has a row for each feature."""
    rows = tests.withColumn("pp", F.coalesce(F.when(~F.isnan(p), F.col(p)), F.lit(1.0)))
    order = W.orderBy("pp")
    rows = rows.withColumns({"i": F.rank().over(order) + F.count(F.lit(1)).over(W.partitionBy("pp")) - 1, "m": F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))})
    limit = F.max(F.when(F.col("pp") <= q * F.col("i") / F.col("m"), F.col("pp"))).over(W.partitionBy(F.lit(0)))
    return rows.withColumn("reject", F.coalesce(F.col("pp") <= limit, F.lit(False))).drop("pp", "i", "m")


def rank_ic(long: DataFrame, by: list[str], least: int = 10, eps: float = 1e-12) -> DataFrame:
    """Spearman correlation of x and y in each group; null for few rows or no spread."""
    rows = long.where("x is not null and y is not null")
    good = (F.count(F.lit(1)) >= least) & (F.stddev_pop("y") > 0) & (F.stddev_pop("x") > eps)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), good.alias("good"))
    return join_on(sizes, rank_correlation(rows, by, "x", "y"), by, "left").select(*by, "n", F.when(F.col("good"), F.col("spearman")).alias("ic"))


def ic_summary(ics: DataFrame, by: list[str]) -> DataFrame:
    """Mean, deviation, information ratio and t of the correlations of each series, and whether t is beyond 2 (``strong_share`` counts those)."""
    out = ics.where("ic is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("days"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"))
    out = out.withColumn("icir", F.col("ic_mean") / (F.col("ic_std") + 1e-9))
    out = out.withColumn("t", F.col("icir") * F.sqrt(F.col("days").cast("double")))
    return out.withColumn("strong", (F.abs("t") > 2).cast("int"))


def strong_share(summary: DataFrame) -> DataFrame:
    """(series, strong, strong_share): how many series have a t beyond 2."""
    n = summary.where("t is not null").agg(F.count(F.lit(1)).alias("series"), F.sum(F.col("strong").cast("long")).alias("strong"))
    return n.withColumn("strong_share", ratio(F.col("strong") * 1.0, F.col("series")))


def pair_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for a < b: all pairs in one aggregation pass, by sums of products. For more than a dozen columns the pairs of a row are exploded, so that
    the plan stays small; ``pair_products`` does that work on matrices and suits large tables better."""
    if len(columns) <= 12:
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
        row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(a, b).alias("r")) for a, b in pairs]).alias("p"))
        return row.select(F.explode("p").alias("p")).select("p.*")
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)])
    # both sides come from one array of the row, so no join is needed
    first = df.select(cells.alias("cells")).select("cells", F.explode("cells").alias("x"))
    rows = first.select("x", F.explode(F.slice("cells", F.col("x.k") + 2, F.lit(len(columns)))).alias("y"))
    return rows.groupBy(F.col("x.c").alias("a"), F.col("y.c").alias("b")).agg(correlation(F.col("x.v"), F.col("y.v")).alias("r"))


def pair_products(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) like ``pair_correlations``, for some hundred columns: each task adds up matrices of products, which are then summed by pair.

    A row counts for the pairs of which it has both values (NaN counts as none); r is null if one of the two is constant.
    """
    d = len(columns)
    i, j = np.triu_indices(d, 1)
    value = [F.col(c).cast("double").alias(c) for c in columns]
    first = df.select(*value).agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns]).first()
    middle = np.array([first[c] or 0.0 for c in columns])  # sums about the means lose few digits
    sums = ["n", "si", "sj", "sii", "sjj", "sij"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(sums), d, d))
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(d)], axis=1) - middle
            here = ~np.isnan(x)
            x, m = np.where(here, x, 0.0), here.astype(float)
            out += [m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x]
        yield pa.RecordBatch.from_pydict({"i": i, "j": j} | {s: out[k][i, j] for k, s in enumerate(sums)})

    t = df.select(*value).mapInArrow(run, "i long, j long, " + ", ".join(f"{s} double" for s in sums))
    t = t.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])
    n, vi, vj = F.col("n"), F.col("sii") - F.col("si") * F.col("si") / F.col("n"), F.col("sjj") - F.col("sj") * F.col("sj") / F.col("n")
    name = F.array(*[F.lit(c) for c in columns])
    r = F.when((n > 0) & (vi > EPS) & (vj > EPS), (F.col("sij") - F.col("si") * F.col("sj") / n) / F.sqrt(vi * vj))
    return t.select(F.get(name, F.col("i").cast("int")).alias("a"), F.get(name, F.col("j").cast("int")).alias("b"), r.alias("r"))


def distances(pairs: DataFrame, kind: str = "mantegna") -> DataFrame:
    d = F.sqrt(F.greatest(2 * (1 - F.col("r")), F.lit(0.0))) if kind == "mantegna" else 1 - F.abs("r")
    return pairs.withColumn("d", d)


def representatives(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, item): of each cluster the item with the least mean distance to its members, itself (0) included; ties to the first name."""
    both = pairs.select("a", "b", "d").union(pairs.select("b", "a", "d")).union(clusters.select("item", "item", F.lit(0.0)))
    left, right = clusters.select(F.col("item").alias("a"), "cluster"), clusters.select(F.col("item").alias("b"), F.col("cluster").alias("cb"))
    mean = both.join(left, "a").join(right, "b").where("cluster = cb").groupBy("cluster", "a").agg(F.avg("d").alias("mean_d"))
    return mean.groupBy("cluster").agg(F.min_by("a", F.struct("mean_d", "a")).alias("item"))


def busiest(pairs: DataFrame, clusters: DataFrame, quantile: float = 0.25) -> DataFrame:
    """(cluster, item): of each cluster the item with the most neighbours in it, at a distance within the quantile of all pairs; ties to the first name."""
    limit = (exact_quantiles(pairs, {"d": [quantile]})["d"] or [None])[0]
    both = pairs.select("a", "b", "d").union(pairs.select("b", "a", "d"))
    left, right = clusters.select(F.col("item").alias("a"), "cluster"), clusters.select(F.col("item").alias("b"), F.col("cluster").alias("cb"))
    near = both.join(left, "a").join(right, "b").groupBy("cluster", "a").agg(F.count_if((F.col("cluster") == F.col("cb")) & (F.col("d") <= F.lit(limit))).alias("n"))
    return near.groupBy("cluster").agg(F.min_by("a", F.struct((-F.col("n")).alias("n"), "a")).alias("item"))


def cluster_scores(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster: mean distance inside, least mean distance to another, and (inter - intra) / max of both."""
    left, right = clusters.select(F.col("item").alias("a"), F.col("cluster").alias("ca")), clusters.select(F.col("item").alias("b"), F.col("cluster").alias("cb"))
    both = pairs.select("a", "b", "d").union(pairs.select("b", "a", "d")).join(left, "a").join(right, "b")
    blocks = both.groupBy("ca", "cb").agg(F.avg("d").alias("d"))
    out = blocks.groupBy(F.col("ca").alias("cluster")).agg(F.max(F.when(F.col("ca") == F.col("cb"), F.col("d"))).alias("intra"), F.min(F.when(F.col("ca") != F.col("cb"), F.col("d"))).alias("inter"))
    intra = F.coalesce(F.col("intra"), F.lit(0.0))
    return out.withColumn("intra", intra).withColumn("score", ratio(F.col("inter") - intra, F.greatest(F.col("inter"), intra)))


def vote(long: DataFrame, by: list[str], probs: list[str]) -> DataFrame:
    """Hard and soft votes of models (pred, one probability column for each class): the most frequent class and the class of the greatest mean
    probability; the lower class wins ties. margin is that of class 1 over class 0. Keys without a vote stay, with nulls."""
    means = [F.avg(F.when(F.col("pred").isNotNull(), F.col(p))).alias(f"mean {k}") for k, p in enumerate(probs)]
    v = long.groupBy(*by).agg(F.count("pred").alias("votes_total"), F.mode("pred", True).alias("hard"), *means)
    mean = F.array(*[F.col(f"`mean {k}`") for k in range(len(probs))])
    return v.select(*by, "votes_total", "hard", (F.array_position(mean, F.array_max(mean)) - 1).cast("int").alias("soft"), (F.col("`mean 1`") - F.col("`mean 0`")).alias("margin"))


def redundancy(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(pairs, mean_abs_rho): the mean absolute Spearman correlation of all pairs of columns; ``key`` tells rows apart.

    Ranks come from counts of distinct values by cells (``ranks``), so no window spans a column.
    """
    long = df.select(key, *columns).unpivot([key], columns, "feature", "x").where("x is not null")
    counts = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("t"))
    ranked = long.join(below(counts, ["feature"], "x", ["t"]).select("feature", "x", (F.col("`below t`") + (F.col("t") + 1) / 2.0).alias("r")), ["feature", "x"])
    ranks = ranked.groupBy(key).agg(*[F.max(F.when(F.col("feature") == c, F.col("r"))).alias(c) for c in columns])
    return pair_products(ranks, columns).agg(F.count("r").alias("pairs"), F.avg(F.abs("r")).alias("mean_abs_rho"))


def regression_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p", huber: float = 1.0) -> DataFrame:
    """Mean squared, root, absolute and Huber loss (of width ``huber``) and both correlations."""
    e = F.col(y) - F.col(p)
    known = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    loss = F.when(F.abs(e) <= huber, e * e / 2).otherwise(huber * (F.abs(e) - huber / 2))
    found = known.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(loss).alias("huber"), correlation(y, p).alias("pearson"))
    return join_on(found, rank_correlation(known, by, y, p), by, "left")


def recent_objective(df: DataFrame, by: list[str], on: str, y: str = "y", p: str = "p", decay: float = 0.9, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(by, ema_mse, pearson, objective): squared errors with weights that fade by ``decay`` a row from the last one back, and alpha * ema_mse + beta * (1 - pearson).

    Rows are counted from the end by cells (``ranks``)."""
    rows = numbered(df.select(*by, on, y, p), by, on)
    rows = join_on(rows, rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows of series")), by)
    w = F.pow(F.lit(decay), F.col("`rows of series`") - 1 - F.col("i"))
    e = F.col(p) - F.col(y)
    out = rows.groupBy(*by).agg((F.sum(w * e * e) / F.sum(w)).alias("ema_mse"), correlation(y, p).alias("pearson"))
    return out.withColumn("objective", alpha * F.col("ema_mse") + beta * (1 - F.coalesce("pearson", F.lit(0.0))))


def three_way(x: Column, band: Column | float) -> Column:
    """2 above the band, 0 below it, 1 within; null for null."""
    band = F.lit(band) if isinstance(band, float) else band
    return F.when(x > band, 2).when(x < -band, 0).when(x.isNotNull(), 1)


def class_bands(df: DataFrame, y: str = "y", p: str = "p", flat: float = 0.4, beta: float = 0.5, steps: int = 201) -> DataFrame:
    """(true_band, pred_band, score): bands that turn a regression into three classes.

    The band of the truth holds the share ``flat`` of all rows. The one of the prediction is, of the quantiles 0.05 to 0.95 of its size in ``steps`` steps, the first with the best
    macro F-beta: rows are counted by the step they fall into and their class, once, and all bands follow from sums of those counts.
    """
    shares = [0.05 + 0.9 * k / (steps - 1) for k in range(steps)]
    sizes = df.select(F.abs(y).alias("y"), F.abs(p).alias("p"))
    found = exact_quantiles(sizes, {"y": [flat], "p": shares})
    held = F.broadcast(df.sparkSession.createDataFrame([((found["y"] or [None])[0], found["p"] or None)], "true_band double, bands array<double>"))  # one row
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).crossJoin(held)
    # a band k calls a row flat if the row's size is at most the band: from step ``at`` on
    at = F.size(F.filter("bands", lambda b: b < F.abs(p)))
    counts = rows.select(three_way(F.col(y), F.col("true_band")).alias("y"), F.when(F.col(p) > 0, 2).otherwise(0).alias("side"), at.alias("at")).groupBy("y", "side", "at").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(steps).select(F.col("id").cast("int").alias("k"))
    said = grid.crossJoin(F.broadcast(counts)).select("k", "y", F.when(F.col("at") > F.col("k"), F.col("side")).otherwise(1).alias("c"), "n")  # steps times six counts a step
    parts = []
    for c in (0, 1, 2):
        hit = F.sum(F.when((F.col("y") == c) & (F.col("c") == c), F.col("n")).otherwise(0))
        is_y, is_c = F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)), F.sum(F.when(F.col("c") == c, F.col("n")).otherwise(0))
        parts.append((hit, is_y, is_c))
    scored = said.groupBy("k").agg(*[x.alias(f"v{c}_{j}") for c, part in enumerate(parts) for j, x in enumerate(part)])
    f = lambda c: F.coalesce(ratio((1 + beta**2) * F.col(f"v{c}_0"), beta**2 * F.col(f"v{c}_1") + F.col(f"v{c}_2")), F.lit(0.0))
    seen = sum((F.col(f"v{c}_1") + F.col(f"v{c}_2") > 0).cast("int") for c in range(3))
    best = scored.select("k", ((f(0) + f(1) + f(2)) / seen).alias("score")).orderBy(F.desc(F.round("score", 12)), "k").limit(1)
    return best.crossJoin(held).select("true_band", F.get("bands", F.col("k")).alias("pred_band"), "score")


def confusion(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Per class precision, recall, F1, F0.5 and support, from the confusion matrix."""
    c = confusion(df, y, p)
    one = c.select(F.col("y").alias("class"), F.col("n").alias("actual"), F.lit(0).alias("said"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    two = c.select(F.col("p").alias("class"), F.lit(0).alias("actual"), F.col("n").alias("said"), F.lit(0).alias("hit"))
    s = one.union(two).groupBy("class").agg(F.sum("actual").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    prec, rec = F.coalesce(ratio(F.col("hit") * 1.0, F.col("said")), F.lit(0.0)), F.coalesce(ratio(F.col("hit") * 1.0, F.col("support")), F.lit(0.0))
    fb = lambda b: F.coalesce(ratio((1 + b * b) * prec * rec, b * b * prec + rec), F.lit(0.0))
    return s.select("class", "support", prec.alias("precision"), rec.alias("recall"), fb(1.0).alias("f1"), fb(0.5).alias("f05"))


def summary_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Accuracy, macro scores, weighted F1 and the Matthews correlation, all from the confusion matrix."""
    per = class_metrics(df, y, p)
    c = confusion(df, y, p)
    total = c.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).cast("double").alias("c"))
    sides = per.join(c.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("said")), "class", "left").fillna(0, ["said"])
    s = sides.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.avg("f05").alias("macro_f05"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
                  F.sum(F.col("support") * F.col("said").cast("double")).alias("tp"), F.sum(F.col("support") * F.col("support").cast("double")).alias("tt"), F.sum(F.col("said") * F.col("said").cast("double")).alias("pp"))
    both = s.crossJoin(F.broadcast(total))
    mcc = F.coalesce(ratio(F.col("c") * F.col("n") - F.col("tp"), F.sqrt((F.col("n") ** 2 - F.col("pp")) * (F.col("n") ** 2 - F.col("tt")))), F.lit(0.0))
    return both.select((F.col("c") / F.col("n")).alias("accuracy"), "macro_precision", "macro_recall", "macro_f1", "macro_f05", "weighted_f1", mcc.alias("mcc"))


def best_threshold(scores: DataFrame, steps: int = 101, beta: float = 1.0) -> DataFrame:
    """(threshold, fbeta) with the best F-beta on an even grid, the first of equals: scores are binned once, then cumulated."""
    binned = scores.select(F.least(F.floor(F.col("score") * (steps - 1) + 1e-9), F.lit(steps - 1)).cast("int").alias("b"), F.col("y").cast("long").alias("y")).groupBy("b").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    grid = scores.sparkSession.range(steps).select(F.col("id").cast("int").alias("b")).join(F.broadcast(binned), "b", "left").fillna(0)
    above = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, 0)  # a row for each step
    g = grid.withColumns({"tp": F.sum("pos").over(above), "said": F.sum("n").over(above), "pos_all": F.sum("pos").over(W.partitionBy(F.lit(0)))})
    f = F.coalesce(ratio((1 + beta**2) * F.col("tp"), beta**2 * F.col("pos_all") + F.col("said")), F.lit(0.0))
    return g.select((F.col("b") / (steps - 1.0)).alias("threshold"), f.alias("fbeta")).orderBy(F.desc("fbeta"), "threshold").limit(1)


def quantile_grid(scores: DataFrame, steps: int = 201, score: str = "score") -> list[float]:
    """Distinct quantiles of the scores at an even grid of levels, between neighbours by position."""
    return sorted(set(exact_quantiles(scores.select(F.col(score).alias("score")), {"score": [k / (steps - 1) for k in range(steps)]})["score"]))


def threshold_scores(scores: DataFrame, thresholds: list[float], beta: float = 0.5) -> DataFrame:
    """(threshold, fbeta, macro) of (score, y) for each of some hundred ascending thresholds: F-beta of the rows at or above it, and the mean over both classes.

    Rows are counted by the thresholds they reach, then cumulated; unknown scores or labels are left out.
    """
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = F.size(F.filter(grid, lambda t: t <= F.col("score")))
    known = scores.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("y").isNotNull())
    counts = known.select(reached.alias("b"), F.col("y").cast("long").alias("y")).groupBy("b").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    steps = scores.sparkSession.createDataFrame([(k, float(thresholds[k - 1]) if k else None) for k in range(len(thresholds) + 1)], "b int, threshold double")
    above, one = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(F.lit(0))  # a row for each threshold
    g = steps.join(F.broadcast(counts), "b", "left").fillna(0, ["pos", "n"])
    g = g.withColumns({"tp": F.sum("pos").over(above), "said": F.sum("n").over(above), "all_pos": F.sum("pos").over(one), "all": F.sum("n").over(one)}).where("threshold is not null")
    score = lambda tp, said, real: F.coalesce(ratio((1 + beta**2) * tp, beta**2 * real + said), F.lit(0.0))
    tp, said, pos, n = F.col("tp"), F.col("said"), F.col("all_pos"), F.col("all")
    one_class, other = score(tp, said, pos), score((n - said) - (pos - tp), n - said, n - pos)
    return g.select("threshold", one_class.alias("fbeta"), ((one_class + other) / 2).alias("macro"))


def sharpe(df: DataFrame, by: list[str], on: str, signal: str, ret: str, per_year: float = 252.0, population: bool = False) -> DataFrame:
    """Yearly Sharpe ratio of the sign of yesterday's signal times today's return; with ``population`` over the population's deviation plus 1e-9."""
    w = W.partitionBy(*by).orderBy(on)
    pnl = F.signum(F.lag(signal).over(w)) * F.col(ret)
    one = F.avg("pnl") / (F.stddev_pop("pnl") + 1e-9) if population else ratio(F.avg("pnl"), F.stddev_samp("pnl"))
    return df.withColumn("pnl", pnl).groupBy(*by).agg((one * per_year**0.5).alias("sharpe"))


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Prior (sums to 1) and inverse-frequency weight (mean 1) of each class."""
    c = df.groupBy(F.col(y).alias("class")).agg(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double").alias("n"))
    one = W.partitionBy(F.lit(0))
    return c.withColumns({"prior": F.col("n") / F.sum("n").over(one), "w": 1 / F.col("n")}).withColumn("weight", F.col("w") / F.avg("w").over(one)).drop("w")


def zero_variance(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns to keep: those whose variance is positive. One aggregate row comes to the driver."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > 0]
