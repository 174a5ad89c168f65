"""Readers of raw JSON lines, zipped CSV and feature tables, and writers of results. Schemas are fixed; bad lines fail or go to quarantine."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bartime import ms_of, to_ms

TRADE = "type string, symbol string, recv_ts double, msg struct<data: struct<s: string, E: long, T: long, p: string, q: string, nq: string, a: long, m: boolean>>, _corrupt_record string"
BOOK = "type string, symbol string, snapshot_ts double, recv_ts double, last_update_id long, depth int, bids array<array<double>>, asks array<array<double>>, _corrupt_record string"


def _lines(spark: SparkSession, path: str, schema: str, glob: str) -> DataFrame:
    return spark.read.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def trade_lines(spark: SparkSession, path: str, symbol: str | None = None, glob: str = "trades_*.jsonl") -> DataFrame:
    """Trades as a tape; lines that are no JSON or lack a receive time are left out (see ``bad_lines``). A trade without a time of its own falls back on that of
    the event, then on that of receipt. ``file`` and ``line`` tell the order of lines (``line`` only within this read): see ``in_order``."""
    rows = _lines(spark, path, TRADE, glob).withColumns({"file": F.col("_metadata.file_path"), "line": F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))})
    rows = rows.where("_corrupt_record is null and recv_ts is not null")
    d = F.col("msg.data")
    recv = to_ms(F.col("recv_ts"))
    out = rows.select(
        F.coalesce(d.s, F.col("symbol")).alias("symbol"), F.coalesce(to_ms(d.T), F.lit(0)).alias("ts_ms"), F.coalesce(to_ms(d.T), to_ms(d.E), recv).alias("fallback_ms"), recv.alias("recv_ms"), F.coalesce(d.a, F.lit(0)).alias("agg_trade_id"),
        F.coalesce(d.p.cast("double"), F.lit(0.0)).alias("price"), F.coalesce(d.q, d.nq, F.lit("0")).cast("double").alias("qty"), F.coalesce(d.m, F.lit(False)).alias("is_buyer_maker"), "file", "line")
    return out if symbol is None else out.where(F.col("symbol") == symbol)


def in_order(trades: DataFrame, cell: int = 86_400_000) -> DataFrame:
    """``trade_lines`` with seq, the number of a trade of its symbol by time, file and line: what ``trade_bars`` takes. Rows are numbered by cells of
    time, so no task sorts a whole symbol."""
    from ..operators.windows import positions

    time = F.when(F.col("ts_ms") > 0, F.col("ts_ms")).otherwise(F.coalesce("fallback_ms", F.lit(0)))
    rows = positions(trades.withColumn("time", time), ["symbol"], "time", cell, ("file", "line"))
    return rows.withColumnRenamed("i", "seq").drop("time", "file", "line")


def book_lines(spark: SparkSession, path: str, symbol: str | None = None, glob: str = "*snapshot*.jsonl") -> DataFrame:
    """Snapshots with bids and asks as arrays of (price, qty); a missing depth is the smaller side's length."""
    rows = _lines(spark, path, BOOK, glob).where("_corrupt_record is null")
    levels = lambda c: F.transform(c, lambda x: F.struct(x[0].alias("price"), x[1].alias("qty")))
    out = rows.select(
        F.col("symbol"), to_ms(F.col("snapshot_ts")).alias("event_ms"), to_ms(F.coalesce("recv_ts", "snapshot_ts")).alias("recv_ms"), "last_update_id",
        F.coalesce("depth", F.least(F.size("bids"), F.size("asks"))).alias("depth"), levels(F.col("bids")).alias("bids"), levels(F.col("asks")).alias("asks"))
    return out if symbol is None else out.where(F.col("symbol") == symbol)


def bad_lines(spark: SparkSession, path: str, schema: str, glob: str) -> DataFrame:
    """(file, line) of lines that could not be parsed."""
    text = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return text.where((F.trim("value") != "") & parsed["_corrupt_record"].isNotNull()).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def zipped_csv(spark: SparkSession, path: str, schema: str = "price double, qty double, quote_qty double, time string, is_buyer_maker string", rows_each: int = 50_000) -> DataFrame:
    """Rows of every CSV (plain or gzip) in the zip files under ``path``. Spark reads the archives; each is unpacked as a stream in its task."""
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in sorted(archive.namelist()):
                        if not member.endswith((".csv", ".csv.gz")):
                            continue
                        with archive.open(member) as raw:
                            stream = gzip.open(raw) if member.endswith(".gz") else raw
                            for part in pd.read_csv(stream, chunksize=rows_each, dtype=str):
                                part.columns = [c.strip().lower() for c in part.columns]
                                yield part.reindex(columns=names).assign(file=file)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    raw = files.mapInPandas(unpack, ", ".join(f"`{n}` string" for n in names) + ", file string")
    kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema.fields}
    return raw.select(*[F.expr(f"try_cast(`{n}` as {k})").alias(n) for n, k in kinds.items()], "file")


def clean_trades(rows: DataFrame) -> DataFrame:
    """Trades with numeric times (scientific notation allowed) and boolean sides; rows without a time, price or quantity above zero go."""
    time = F.expr("cast(try_cast(time as double) as bigint)")
    maker = F.coalesce(F.lower(F.trim(F.col("is_buyer_maker").cast("string"))).isin("true", "1"), F.lit(False))
    return rows.withColumns({"ts_ms": time, "is_buyer_maker": maker}).where("ts_ms is not null and price > 0 and qty > 0")


def dated(df: DataFrame, file: Column, start: str, end: str, pattern: str = r"(\d{4}-\d{2}-\d{2})") -> DataFrame:
    """Rows of files whose names hold a date from start to end; as text, so ISO dates compare right."""
    day = F.regexp_extract(file, pattern, 1)
    return df.where((day >= start) & (day <= end))


def feature_table(spark: SparkSession, path: str, drop: tuple[str, ...] = (), one_per_time: bool = False) -> DataFrame:
    """A CSV or Parquet table with lower-case names and ``ts`` in milliseconds from its datetime, date or timestamp column; with ``one_per_time`` the
    last row of each time only."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    source = next((c for c in ("datetime", "date", "timestamp") if c in df.columns), None)
    if source is None:
        raise KeyError("no datetime, date or timestamp column")
    number = F.expr(f"try_cast({source} as double)")
    kind = df.schema[source].dataType.simpleString()
    ts = ms_of(F.col(source)) if kind.startswith("timestamp") else F.coalesce(to_ms(number), F.unix_millis(F.try_to_timestamp(F.col(source).cast("string"))))
    others = [c for c in df.columns if c != source and c not in drop]
    if one_per_time:
        line = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        df = df.withColumns({"row ts": ts, "row line": line}).groupBy("row ts").agg(F.max_by(F.struct(*df.columns), "row line").alias("r")).select("r.*")
    return df.select(ts.alias("ts"), *[F.expr(f"try_cast(`{c}` as double)").alias(c) if df.schema[c].dataType.simpleString() == "string" else F.col(c) for c in others]).where("ts is not null")


def event_labels(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """Labelled events of a CSV or Parquet file with t0 and t1 (if there) as milliseconds, side as 1 or -1 and the label as a number; rows without t0 go.
    Times without an offset are of ``zone``."""
    from ..operators.selection import side_of

    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    require(df, "t0")

    def ms(c: str) -> Column:
        kind = df.schema[c].dataType.simpleString()
        if kind in ("bigint", "int", "double"):
            return to_ms(F.col(c))
        text = F.col(c).cast("string")
        stamped = text.rlike("([+-]\\d\\d:?\\d\\d|Z)$")
        moment = F.try_to_timestamp(text)
        return F.unix_millis(moment) if kind == "timestamp" else F.unix_millis(F.when(stamped, moment).otherwise(F.to_utc_timestamp(moment, zone)))

    columns = {c: ms(c) for c in ("t0", "t1") if c in df.columns} | {c: F.expr(f"try_cast({c} as double)") for c in ("label", "entry_price", "pt", "sl", "vol") if c in df.columns}
    if "side" in df.columns:
        columns["side"] = side_of(F.col("side").cast("string"))
    return df.withColumns(columns).where("t0 is not null")


def numbers(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the columns, all of which it must have, as doubles; text that is no number becomes null."""
    return require(df, *columns).withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns})


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` itself, if it has the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"missing columns: {missing}")
    return df


def closed_only(bars: DataFrame, on: str, step: int, now_ms: Column) -> DataFrame:
    """Bars that are complete: they open before the current one."""
    return bars.where(F.col(on) < F.floor(now_ms / step) * step)


def append_bars(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new bars, the new one where both have a key."""
    from ..operators.windows import keep_last

    return keep_last(old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1))), keys, ["age"]).drop("age")


def write_days(df: DataFrame, path: str, ts: str, zone: str = "Asia/Taipei") -> None:
    """Parquet partitioned by local day; days in ``df`` replace those on disk, others stay."""
    day = F.date_format(F.from_utc_timestamp(F.timestamp_millis(ts), zone), "yyyy-MM-dd")
    df.withColumn("dt", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def missing_days(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Days of ``wanted`` (dt) that the table at ``path`` does not hold; only partition names are read."""
    present = spark.read.parquet(path).select(F.col("dt").cast("string").alias("dt")).distinct()
    return wanted.join(present, "dt", "left_anti")


def write_both(df: DataFrame, path: str) -> None:
    """The table as Parquet and as CSV with a header, below ``path``."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_json(df: DataFrame, path: str) -> None:
    """The rows as JSON lines; nulls are kept as fields."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_predictions(df: DataFrame, path: str, columns: tuple[str, ...] = ("t0", "side", "label", "pred")) -> None:
    """Predictions as CSV with a header: the stated columns first, the others after them."""
    first = [c for c in columns if c in require(df, "t0", "pred").columns]
    df.select(*first, *[c for c in df.columns if c not in first]).write.mode("overwrite").option("header", True).csv(path)


def iso_time(ms: Column) -> Column:
    """Text with the offset, as in 2024-01-01 00:00:00+00:00."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ssxxx")
