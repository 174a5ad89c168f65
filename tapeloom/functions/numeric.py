"""Guarded arithmetic and statistics as columns. Missing numbers are null, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EPS = 1e-12


def clean(x: Column) -> Column:
    """Null for NaN and the infinities."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column, eps: float = 0.0) -> Column:
    """a / b, null where b is not above eps in size."""
    return F.when(F.abs(b) > eps, a / F.when(F.abs(b) > eps, b))


def gated(value: Column, counted: Column, w: WindowSpec, least: int) -> Column:
    """``value`` where the frame holds at least ``least`` numbers."""
    return F.when(F.count(counted).over(w) >= least, value)


def sample_skew(n: Column, skewness: Column) -> Column:
    """The sample-corrected skew from the population one; 0 without variance, null below 3 rows."""
    g = F.when(F.isnan(skewness) | skewness.isNull(), 0.0).otherwise(skewness)
    return F.when(n >= 3, g * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def sample_kurtosis(n: Column, kurtosis: Column) -> Column:
    """The sample-corrected excess kurtosis from the population one; 0 without variance, null below 4 rows."""
    flat = F.isnan(kurtosis) | kurtosis.isNull()
    g = (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * kurtosis + 6)
    return F.when(n >= 4, F.when(flat, 0.0).otherwise(g))


def average_rank(x: Column, *by: str | Column) -> Column:
    """Rank among the rows of a group, ties sharing their mean; null values have none."""
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    has = x.isNotNull()
    first = F.rank().over(W.partitionBy(*keys, has).orderBy(x))
    ties = F.count(F.lit(1)).over(W.partitionBy(*keys, x))
    return F.when(has, first + (ties - 1) / 2.0)


def correlation(x: Column | str, y: Column | str, w: WindowSpec | None = None) -> Column:
    """Pearson correlation as an aggregate or over a window; null without spread (where ``corr`` divides by zero)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    x, y = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    c, a, b = [p.over(w) for p in parts] if w is not None else parts
    return F.when(a * b > 0, c / F.when(a * b > 0, a * b))


def normal_cdf(z: Column) -> Column:
    """Distribution function of the normal law: the error function by its series near zero, by its continued fraction beyond. Both run as loops over a
    short array, so the expression stays small."""
    x = F.abs(z) / 2**0.5
    start = F.struct(x.alias("term"), x.alias("total"))

    def further(s: Column, k: Column) -> Column:
        term = -s["term"] * x * x / k
        return F.struct(term.alias("term"), (s["total"] + term / (2 * k + 1)).alias("total"))

    near = F.aggregate(F.sequence(F.lit(1), F.lit(39)), start, further, lambda s: s["total"]) * (2 / 3.141592653589793**0.5)
    frac = F.aggregate(F.sequence(F.lit(40), F.lit(1)), F.lit(0.0), lambda f, k: k / 2 / (x + f))
    far = 1 - F.exp(-x * x) / (3.141592653589793**0.5) / (x + frac)
    erf = F.when(x < 2.0, near).otherwise(far)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def all_finite(*columns: str) -> Column:
    """True where every column holds a finite number."""
    return reduce(lambda a, b: a & b, [clean(F.col(c)).isNotNull() for c in columns], F.lit(True))
