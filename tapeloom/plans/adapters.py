"""Views of the test tables as market data: a tape, bars, books, diffs and events; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.bartime import ms_of
from ..operators import bars as B

HOUR = 3_600_000
DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: the type is the symbol, the value the price, k + 1 the quantity."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), ms_of(F.col("ts")).alias("ts_ms"), (ms_of(F.col("ts")) + 5).alias("recv_ms"), F.lit(None).cast("long").alias("fallback_ms"),
        F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("double") + 1).alias("qty"), (F.col("event_id") % 2 == 1).alias("is_buyer_maker"), "user_id")


def shuffled_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape in another order of arrival, so that some trades are late, and some without a time."""
    return tape(spark, sf_dir).withColumns({"seq": F.col("seq") * 10 + F.when(F.col("seq") % 7 == 3, 401).otherwise(0), "ts_ms": F.when(F.col("seq") % 50 == 9, F.lit(0)).otherwise(F.col("ts_ms")), "fallback_ms": F.when(F.col("seq") % 100 == 9, F.col("ts_ms"))})


def bars(spark: SparkSession, sf_dir: str, interval: str = "1h") -> DataFrame:
    return B.ohlcv(tape(spark, sf_dir), interval)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-book snapshots: in each hour the values below 50 as bids, the others as asks, by symbol."""
    t = tape(spark, sf_dir).withColumn("bar", F.floor(F.col("ts_ms") / HOUR) * HOUR)
    level = F.struct(F.col("price"), F.col("qty"))
    mid = F.avg("price").over(W.partitionBy("symbol", "bar"))
    t = t.withColumn("mid", mid)
    g = t.groupBy("symbol", "bar").agg(F.collect_list(F.when(F.col("price") < F.col("mid"), level)).alias("b"), F.collect_list(F.when(F.col("price") >= F.col("mid"), level)).alias("a"))
    # ties of price in order of quantity
    return g.select("symbol", "bar", F.reverse(F.array_sort("b")).alias("bids"), F.array_sort("a").alias("asks"), (F.size("a") + F.size("b")).alias("depth"))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to a fixed number of digits, so that another order of summation gives the same values."""
    return df.select(*[(F.round(F.col(f"`{c}`"), DIGITS) + 0.0).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


TAPE_SQL = """tape AS (
  SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) // 1000 + 5 AS recv_ms, value AS price,
         regexp_extract(props, '[0-9]+')::DOUBLE + 1 AS qty, event_id % 2 = 1 AS is_buyer_maker, user_id FROM events)"""
BARS_SQL = TAPE_SQL + """,
bars AS (
  SELECT symbol, ts_ms // 3600000 * 3600000 AS bar, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, sum(qty) AS volume, count(*) AS trades FROM tape GROUP BY ALL)"""
BOOKS_SQL = TAPE_SQL + """,
mids AS (SELECT *, ts_ms // 3600000 * 3600000 AS bar, avg(price) OVER (PARTITION BY symbol, ts_ms // 3600000) AS m FROM tape),
sides AS (SELECT symbol, bar, list(struct_pack(price := price, qty := qty)) FILTER (price < m) AS b,
          list(struct_pack(price := price, qty := qty)) FILTER (price >= m) AS a FROM mids GROUP BY ALL),
books AS (SELECT symbol, bar, list_reverse_sort(b) AS bids, list_sort(a) AS asks FROM sides WHERE len(b) > 0 AND len(a) > 0)"""


def sql(ctes: str, body: str, plain: str, doubles: str) -> str:
    """A query that rounds its doubles as ``rounded`` does. ``plain`` and ``doubles`` name the result's columns."""
    columns = [c for c in plain.split()] + [f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in doubles.split()]
    return f"WITH {ctes}\nSELECT {', '.join(columns)} FROM (\n{body}\n) AS result"
