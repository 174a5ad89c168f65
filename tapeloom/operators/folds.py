"""Cross-validation folds over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .windows import positions

DAY = 86_400_000


def months(times: DataFrame, on: str) -> DataFrame:
    """(month, i, start, next): distinct months in order; a small dimension, one row for each month."""
    m = times.select(F.date_trunc("MONTH", F.timestamp_millis(on)).alias("month")).distinct()
    rows = m.withColumn("i", F.row_number().over(W.orderBy("month")) - 1)
    return rows.withColumns({"start": F.unix_millis("month"), "next": F.unix_millis(F.add_months("month", 1).cast("timestamp"))})


def rolling_folds(times: DataFrame, on: str, train_months: int, embargo: int = 0) -> DataFrame:
    """(fold, test_start, test_end, train_start, train_end): each test month is preceded by ``train_months`` months less the embargo. The last month is never tested."""
    m = months(times, on)
    n = m.agg((F.max("i") + 1).alias("n"))
    first = m.select((F.col("i") + train_months).alias("i"), F.col("start").alias("train_start"))
    return m.crossJoin(F.broadcast(n)).where((F.col("i") >= train_months) & (F.col("i") + 1 < F.col("n"))).join(first, "i").select(
        F.col("i").alias("fold"), F.col("start").alias("test_start"), F.col("next").alias("test_end"), "train_start", (F.col("start") - embargo).alias("train_end"))


def blocks(times: DataFrame, on: str, k: int) -> DataFrame:
    """(fold, lo, hi): k contiguous blocks of the distinct times, the first ones a row longer. Rows are numbered without one global sort: counts by day first."""
    distinct = times.select(F.col(on)).distinct().withColumn("day", F.floor(F.col(on) / DAY))
    daily = distinct.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    base = daily.withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each day
    total = F.broadcast(daily.agg(F.sum("n").alias("total")))
    rows = distinct.join(base.select("day", "base"), "day").withColumn("i", F.col("base") + F.row_number().over(W.partitionBy("day").orderBy(on)) - 1).crossJoin(total)
    size, extra = F.floor(F.col("total") / k), F.col("total") % k
    fold = F.when(F.col("i") < extra * (size + 1), F.floor(F.col("i") / (size + 1))).otherwise(extra + F.floor((F.col("i") - extra * (size + 1)) / F.greatest(size, F.lit(1))))
    return rows.withColumn("fold", fold.cast("int")).groupBy("fold").agg(F.min(on).alias("lo"), F.max(on).alias("hi"))


def assign(rows: DataFrame, folds: DataFrame, on: str, embargo: int = 0) -> DataFrame:
    """(fold, role, *): rows tested in a fold and rows trained on, those within the embargo of the test block left out. ``folds`` has a row for each fold."""
    joined = rows.crossJoin(F.broadcast(folds))
    role = F.when(F.col(on).between(F.col("lo"), F.col("hi")), "test").when((F.col(on) < F.col("lo") - embargo) | (F.col(on) > F.col("hi") + embargo), "train")
    return joined.withColumn("role", role).where("role is not null").drop("lo", "hi")


def test_months(times: DataFrame, on: str, every: int = 3, first: int = 1) -> DataFrame:
    """Months whose number is ``first`` plus a multiple of ``every``."""
    return months(times, on).where((F.month("month") - first) % every == 0)


def split_by_position(df: DataFrame, on: str, ratio: float, cell: int = DAY) -> DataFrame:
    """Add part: the first int(n * ratio) distinct times are ``train``, the rest ``val``. Times are numbered by cells."""
    numbered = positions(df.select(on).distinct(), [], on, cell)
    n = numbered.agg(F.count(F.lit(1)).alias("n"))
    cut = numbered.crossJoin(F.broadcast(n)).where(F.col("i") < F.floor(F.col("n") * ratio)).agg(F.max(on).alias("cut"))  # one row
    return df.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.col(on) <= F.col("cut"), "train").otherwise("val")).drop("cut")
