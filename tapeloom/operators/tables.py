"""Small operators over tables and their column names: selections, recodes, samples, validated merges, reports and slow series."""

from __future__ import annotations

import re
from collections.abc import Iterable
from fnmatch import fnmatchcase
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import NumericType

from ..functions.numeric import correlation
from .ranks import in_chunks

DAY = 86_400_000


# ---------------------------------------------------------------- names of columns


def pick_columns(columns: Iterable[str], patterns: Iterable[str] = (), prefixes: Iterable[str] = (), exact: Iterable[str] = ()) -> list[str]:
    """The columns, in their order, that match a glob pattern, begin with a prefix or are named."""
    globs, heads, names = list(patterns), tuple(prefixes), set(exact)
    return [c for c in columns if c in names or (heads and c.startswith(heads)) or any(fnmatchcase(c, g) for g in globs)]


def feature_columns(df: DataFrame, time: str, exclude: Iterable[str] = (), prefixes: Iterable[str] = (), labels: bool = False) -> list[str]:
    """The numeric columns of df, in their order, that may serve as features: neither the time nor, unless ``labels``, those named y_*, nor any that matches a glob pattern of ``exclude``.
    With ``prefixes`` only columns that begin with one of them. Flags (boolean) are no numbers."""
    heads, globs = tuple(prefixes), [*exclude, *([] if labels else ["y_*"])]
    wanted = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and (f.name.startswith(heads) if heads else f.name != time)]
    return [c for c in wanted if not any(fnmatchcase(c, g) for g in globs)]


def numbered_columns(columns: Iterable[str], prefix: str = "PC") -> list[str]:
    """The columns named prefix and a whole number, in order of the numbers."""
    found = [(int(c[len(prefix) :]), c) for c in columns if re.fullmatch(re.escape(prefix) + r"[+-]?\d+", c)]
    return [c for _, c in sorted(found, key=lambda f: f[0])]


def split_columns(columns: Iterable[str], prefixes: tuple[str, ...] = ("m_",)) -> tuple[list[str], list[str]]:
    """(minute columns, base columns): those that begin with a prefix or with m, digits and an underscore, and the others."""
    columns = list(columns)
    minute = [c for c in columns if c.startswith(prefixes) or re.match(r"m\d+_", c)]
    return minute, [c for c in columns if c not in set(minute)]


# ---------------------------------------------------------------- values and rows


def recode(x: Column, mapping: dict) -> Column:
    """Values by the mapping; a null stays, any other value raises an error when the row is read."""
    known = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    bad = F.raise_error(F.concat(F.lit("no code for the value "), x.cast("string")))
    return F.when(x.isNull(), None).when(F.map_contains_key(known, x), F.try_element_at(known, x)).otherwise(bad)


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows with the smallest hashes of their keys: the same ones however the table is split."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def at_times(df: DataFrame, times: DataFrame, on: str | list[str]) -> DataFrame:
    """The rows whose time (or key and time) is among ``times``."""
    return df.join(times, on, "left_semi")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself; rows that repeat a key raise an error when they are read."""
    others = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows of a key"), *[F.first(c).alias(c) for c in others])
    key = F.when(F.col("`rows of a key`") == 1, F.col(keys[0])).otherwise(F.raise_error(F.lit(f"{keys} is not unique")).cast(df.schema[keys[0]].dataType))
    return one.select(*[key.alias(c) if c == keys[0] else F.col(c) for c in df.columns])


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join whose keys must be unique on both sides."""
    return unique(left, keys).join(unique(right, keys), keys, how)


def merge_predictions(base: DataFrame, parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """``base`` with a column for each model's ``pred``, each merged one to one; rows that a model has not judged hold null."""
    out = unique(base, keys)
    for name, part in parts.items():
        out = out.join(unique(part.select(*keys, F.col("pred").alias(name)), keys), keys, "left")
    return out


def clipped(df: DataFrame, on: str, trigger: Column) -> DataFrame:
    """Rows up to the trigger's time: what came later is cut off."""
    return df.where(F.col(on) <= trigger)


def due_bars(last: DataFrame, step: int, target: Column, by: list[str]) -> DataFrame:
    """(by, close): every closed bar after the last processed one (by, last) up to the target, in order; none if it has been reached."""
    first = F.col("last") + step
    return last.where(first <= target).select(*by, F.explode(F.sequence(first, target, F.lit(step).cast("long"))).alias("close"))


# ---------------------------------------------------------------- reports


def label_counts(df: DataFrame, label: str, domain: Iterable[int]) -> DataFrame:
    """(label, n) for each label of the domain, 0 where there is none."""
    wanted = df.sparkSession.createDataFrame([(d,) for d in domain], "label int")
    n = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(n, "label", "left").fillna(0, ["n"])


def fold_summary(df: DataFrame, by: list[str], fold: str, value: str) -> DataFrame:
    """(by, mean, std) of the folds' means; the deviation is of the population."""
    return df.groupBy(*by, fold).agg(F.avg(value).alias("x")).groupBy(*by).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def grid_pivot(df: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """The mean of ``value`` with a row for each ``row`` and a column for each of ``values``."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(value))


def grid_report(df: DataFrame, where: Column, order: list[Column], digits: int = 3) -> DataFrame:
    """The rows of a parameter grid that meet the condition, sorted, with numbers rounded."""
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    return df.where(where).orderBy(*order).select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """(a, b): the k nearest of each item, of pairs (a, b, d) given once; ties by name."""
    both = pairs.select("a", "b", "d").union(pairs.select("b", "a", "d"))
    return both.withColumn("k", F.row_number().over(W.partitionBy("a").orderBy("d", "b"))).where(F.col("k") <= k).select("a", "b")


def mean_correlation(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(n, mean_abs_r, mean_r) over the pairs (a, b, r) of which both are among ``items``."""
    own = pairs.join(F.broadcast(items.select(F.col("item").alias("a"))), "a", "left_semi").join(F.broadcast(items.select(F.col("item").alias("b"))), "b", "left_semi")
    return own.agg(F.count("r").alias("n"), F.avg(F.abs("r")).alias("mean_abs_r"), F.avg("r").alias("mean_r"))


def autocorrelation(df: DataFrame, by: list[str], on: str, x: str, lag: int = 1) -> DataFrame:
    """(by, r): the correlation of a series with itself ``lag`` rows before."""
    work = lambda rows, keys: rows.withColumn("value before", F.lag(x, lag).over(W.partitionBy(*keys).orderBy("i")))
    return in_chunks(df.select(*dict.fromkeys([*by, on, x])), by, on, lag, 0, work).groupBy(*by).agg(correlation(x, "value before").alias("r"))


def set_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """(op, n): the rows of each named table."""
    return reduce(DataFrame.union, [df.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n")) for op, df in parts.items()])


# ---------------------------------------------------------------- slow series


def spread_slow(rows: DataFrame, slow: DataFrame, on: str, value: str, step: int = DAY) -> DataFrame:
    """``rows`` with the value of a slow series (``on``, value), which holds from its time until the next one. Times of the slow series are multiples of ``step``.

    The spine has a row for each step between the first value and the last row; the join is by equal steps.
    """
    w = W.orderBy(on)  # a row for each value of the slow series
    last = rows.agg((F.floor(F.max(on) / step) * step).alias("last"))  # one row
    span = slow.select(on, value).withColumn("until", F.lead(on).over(w) - step).crossJoin(F.broadcast(last)).where(F.col(on) <= F.col("last"))
    span = span.withColumn("until", F.least(F.coalesce("until", "last"), "last")).where(F.col("until") >= F.col(on))
    spine = span.select(value, F.explode(F.sequence(F.col(on), F.col("until"), F.lit(step).cast("long"))).alias("step"))
    return rows.withColumn("step", (F.floor(F.col(on) / step) * step).cast("long")).join(spine, "step", "left").drop("step")
