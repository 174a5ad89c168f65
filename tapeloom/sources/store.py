"""A table of feature rows by key and time that grows by appends: the last write of a row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.ranks import join_on, numbered


class FeatureTable:
    """Rows (by, on, ...) in a folder. Each append is a version of its own, a folder of parts by key; ``compact`` writes a base of all versions so far. A version counts
    once its ``_SUCCESS`` is there, so readers never see half of one, and an append that is repeated under its number replaces itself. One writer at a time.

    Of rows with equal (by, on) the last append counts, and in one append the last row. With ``most`` only so many newest rows of each key are given out.
    ``rows``, ``window`` and ``latest`` read the newest base and the versions after it; those of one key read that key's folders only.
    """

    def __init__(self, spark: SparkSession, path: str, by: str = "symbol", on: str = "bar_open_ms", most: int = 0):
        self.spark, self.path, self.by, self.on, self.most = spark, path.rstrip("/"), by, on, most

    def _versions(self, kind: str) -> list[int]:
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top)]
        return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def version(self) -> int:
        """The newest version, -1 for none."""
        return max([-1, *self._versions("part"), *self._versions("base")])

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        folder = F.coalesce(F.col(self.by).cast("string"), F.lit("")).alias("key_folder")
        rows.select("*", folder).repartition("key_folder", F.pmod(F.xxhash64(self.on), F.lit(8))).write.mode("overwrite").partitionBy("key_folder").parquet(f"{self.path}/{kind}/{version}")

    def append(self, rows: DataFrame, version: int | None = None) -> int:
        """Add rows; gives the version. A stream passes its batch number, so that a repeated batch changes nothing."""
        number = self.version() + 1 if version is None else version
        self._write(rows.withColumns({"append_version": F.lit(number).cast("long"), "append_row": F.monotonically_increasing_id()}), "part", number)
        return number

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        self.append(batch, batch_id)

    def compact(self) -> int:
        """Write all rows as a base; gives its version. With ``most``, older rows are left out of it."""
        number = self.version()
        if number >= 0:
            self._write(self._newest(self._last(self._read(number, None))), "base", number)
        return number

    def _read(self, version: int, key: str | None) -> DataFrame:
        bases = [v for v in self._versions("base") if v <= version]
        parts = [v for v in self._versions("part") if v <= version and (not bases or v > bases[-1])]
        folders = [f"{self.path}/base/{v}" for v in bases[-1:]] + [f"{self.path}/part/{v}" for v in parts]
        out = None
        for folder in folders:
            found = self.spark.read.parquet(folder).schema
            as_text = StructType([StructField(f.name, StringType()) if f.name == "key_folder" else f for f in found])  # folders like 001 would be read as numbers
            one = self.spark.read.schema(as_text).parquet(folder)
            one = one if key is None else one.where(F.col("key_folder") == key)
            one = one.drop("key_folder")
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            raise ValueError(f"no version of {self.path} yet")
        return out

    def _last(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (self.by, self.on)]
        kept = rows.groupBy(self.by, self.on).agg(F.max_by(F.struct(*others), F.struct("append_version", "append_row")).alias("kept row"))
        return kept.select(self.by, self.on, "`kept row`.*")

    def _newest(self, rows: DataFrame) -> DataFrame:
        if not self.most:
            return rows
        placed = numbered(rows, [self.by], self.on)
        sizes = placed.groupBy(self.by).agg(F.count(F.lit(1)).alias("rows of key"))
        return join_on(placed, sizes, [self.by]).where(F.col("i") >= F.col("rows of key") - self.most).drop("i", "rows of key")

    def rows(self, key: str | None = None, version: int | None = None) -> DataFrame:
        """All rows of a key or of all, as of a version (default: the newest), in no order."""
        found = self._last(self._read(self.version() if version is None else version, key))
        return self._newest(found).drop("append_version", "append_row")

    def window(self, key: str, n: int, version: int | None = None) -> DataFrame:
        """The last n rows of a key, oldest first."""
        n = min(n, self.most) if self.most else n
        found = self._last(self._read(self.version() if version is None else version, key)).drop("append_version", "append_row")
        return found.orderBy(F.desc(self.on)).limit(max(n, 0)).orderBy(self.on)

    def latest(self, key: str | None = None, version: int | None = None) -> DataFrame:
        """The newest row of a key, or of each: one aggregate that combines before the shuffle."""
        rows = self._read(self.version() if version is None else version, key)
        others = [c for c in rows.columns if c != self.by]
        newest: Column = F.struct(self.on, "append_version", "append_row")
        found = rows.groupBy(self.by).agg(F.max_by(F.struct(*others), newest).alias("kept row")).select(self.by, "`kept row`.*")
        return found.drop("append_version", "append_row")
