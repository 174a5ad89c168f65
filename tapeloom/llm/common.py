"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that an Arrow function handles at once.
SLICE_ROWS = 256
#: Rows and bytes of a batch that Spark hands over.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tapeloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tapeloom/{label}-{uuid.uuid4().hex}"


#: Folders of the tables written since ``scratch`` was entered, in this thread.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut and survives lost executors."""
    path = new_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    if (made := _SCRATCH.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[], str]]:
    """Tables that ``materialise`` writes inside are deleted at the end. The function that is yielded keeps the last one and returns its path.

    For callers that write their result before they leave; a DataFrame that still reads a deleted table is of no use afterwards.
    """
    made: list[str] = []
    kept: list[str] = []
    outer = _SCRATCH.get()

    def keep_last() -> str:
        kept.append(made.pop())
        return kept[-1]

    token = _SCRATCH.set(made)
    try:
        yield keep_last
    finally:
        _SCRATCH.reset(token)
        if outer is not None:
            outer += kept
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder; nothing happens if it is gone."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def positional(docs: DataFrame, own: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``docs`` with its columns named by their places (x0, x1, ...), but for those of ``own``. So columns may have any names, with dots, back-ticks or those of
    helpers in any case; ``.toDF(*docs.columns)`` gives the names back. Of names that differ in case only, the one as written in ``own`` counts."""
    names = [f"x{i}" for i in range(len(docs.columns))]
    for c in own:
        alike = [i for i, name in enumerate(docs.columns) if name.lower() == c]
        if alike:
            names[next((i for i in alike if docs.columns[i] == c), alike[0])] = c
    return docs.toDF(*names)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` for rows that hold texts: batches are kept small, as a batch of Spark's usual 10,000 rows of long
    texts would be held several times over by the JVM and by Python. These are settings of the session."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"\D", "", conf.get(name)) or 0)
        if not 0 < now <= most:
            conf.set(name, most)
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's strings in UTF-8, without a detour through str; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def held_out(doc_id) -> "F.Column":
    """True for rows that no model may learn from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows that are not held out (doc_id, text, label, fold 0-9).

    The rows with the smallest hashes of doc_id are taken, so the sample is the same wherever the tables
    lie and however they are split. Rows without doc_id, text or label are left out; of repeated
    labels the largest counts, of rows that repeat a doc_id the one with the smallest text.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("double").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return (
        docs.select("doc_id", "text").where(F.col("text").isNotNull())
        .join(F.broadcast(chosen), "doc_id")  # at most ``limit`` rows of 16 bytes
        .groupBy("doc_id", "label").agg(F.min("text").alias("text"))
        .select("doc_id", "text", "label", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(10)).cast("int").alias("fold"))
    )


class WordCache(dict):
    """Values computed once for each key, in two generations, so that memory stays bounded."""

    def __init__(self, compute: Callable[[list], list], size: int = 250_000):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def ensure(self, keys: set) -> None:
        """Make every one of ``keys`` present."""
        missing = keys - self.keys()
        if len(self) + len(missing) > self.size and len(self) > len(keys):
            self.old = {k: v for k, v in self.items()}
            self.clear()
            missing = keys
        old, fresh = self.old, []
        for k in missing:
            if (v := old.get(k)) is None:
                fresh.append(k)
            else:
                self[k] = v
        self.update(zip(fresh, self.compute(fresh)))
