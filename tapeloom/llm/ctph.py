"""Operator 7: document fingerprints by context-triggered piecewise hashing.

A rolling sum over the last 7 bytes (plain and position-weighted, mixed) cuts the text wherever it hits a multiple of the
block size; each chunk's CRC gives one of 64 letters. The block size is 3 * 2**k, the least for which about 64 chunks are
expected, halved while fewer than 32 come out. The fingerprint is ``size:letters:letters at twice the size``, so texts
whose sizes differ by a factor of two can still be compared. After 63 letters the rest of the text is one chunk.

Likeness: of the letter strings at an equal block size, 1 - edit distance / longer length, the best of the comparable
pairs; 0 where no size is common or no run of 4 letters is (or of the whole, if shorter). Equal fingerprints have 1.

Likeness is computed by Spark's own string functions. The next document is found by ranges: rows are dealt by
doc_id into ranges (bounds from approximate quantiles of the ids), and every range also gets the first row of the next one, so no task holds
more than its range and nothing passes through the driver but the bounds. A doc_id that fills several ranges is dealt into them by the
hash of its texts.

Cases: doc_ids are whole numbers, as the next document is found by ranges of them; null and empty texts have the fingerprint of the empty text, "3::"; a single row is its own next one; rows
that repeat a doc_id follow one another in the order of their texts (within each range of their hashes, if there are very many); rows without
doc_id come first; an empty table gives an empty result; texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, shuffle_partitions, slices

WINDOW, LEAST_SIZE, LETTERS, COMMON = 7, 3, 64, 4
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolling(data: bytes) -> np.ndarray:
    """A hash of the 7 bytes that end at each position."""
    x = np.frombuffer(bytes(WINDOW - 1) + data, np.uint8).astype(np.uint32)
    n = len(data)
    h = np.zeros(n, np.uint32)
    for k in range(WINDOW):
        h *= np.uint32(0x01000193)
        h += x[k : k + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def letters(data: bytes, h: np.ndarray, size: int) -> str:
    cuts = (np.flatnonzero(h % np.uint32(size) == size - 1) + 1)[: LETTERS - 1].tolist()
    if not cuts or cuts[-1] != len(data):
        cuts.append(len(data))
    crc, start, out = zlib.crc32, 0, []
    view = memoryview(data)
    for end in cuts:
        out.append(ALPHABET[crc(view[start:end]) * 2654435761 >> 20 & 63])
        start = end
    return "".join(out)


def fingerprint(text: str) -> str:
    data = text.encode()
    if not data:
        return f"{LEAST_SIZE}::"
    h = rolling(data)
    size = LEAST_SIZE
    while size * LETTERS < len(data):
        size *= 2
    first = letters(data, h, size)
    while len(first) < LETTERS // 2 and size > LEAST_SIZE:
        size //= 2
        first = letters(data, h, size)
    return f"{size}:{first}:{letters(data, h, 2 * size)}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; both fingerprints as strings."""
    pa_, pb = F.split(a, ":"), F.split(b, ":")
    size_a, size_b = pa_[0].cast("long"), pb[0].cast("long")

    def alike(x: Column, y: Column) -> Column:
        runs = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - COMMON + 1, F.lit(1))), lambda i: F.substring(s, i, COMMON))
        score = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)).cast("double")
        return F.when((F.length(x) > 0) & (F.length(y) > 0) & F.arrays_overlap(runs(x), runs(y)), score).otherwise(F.lit(0.0))

    return (
        F.when(a == b, F.lit(1.0))
        .when(size_a == size_b, F.greatest(alike(pa_[1], pb[1]), alike(pa_[2], pb[2])))
        .when(size_a == 2 * size_b, alike(pa_[1], pb[2]))
        .when(size_b == 2 * size_a, alike(pa_[2], pb[1]))
        .otherwise(F.lit(0.0))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def id_ranges(docs: DataFrame, ranges: int) -> list[tuple[int | None, int]]:
    """(first doc_id, ranges) in ascending order: the ids from each one to the next fill that many ranges with about as many rows each.

    Ids that fill several ranges by themselves are followed by an entry for the ids after them. Null ids are the entry (None, n), if there are any.
    """
    found = docs.agg(F.count_if(F.col("doc_id").isNull()), F.count("doc_id"), F.percentile_approx("doc_id", [k / ranges for k in range(ranges)], max(10_000, 20 * ranges))).first()
    nulls, rows, marks = found
    out: list[tuple[int | None, int]] = [(None, max(1, round(ranges * nulls / (nulls + rows))))] if nulls else []
    for k in sorted(set(marks or [])):
        n = marks.count(k)
        out += [(k, n), (k + 1, 1)] if n > 1 else [(k, 1)]
    return out


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(bucket, ahead, doc_id, h, text): rows dealt into ranges of doc_id, each range followed by the first row of the next.

    Sorted by (bucket, ahead, doc_id, h, text) in its partitions; ``ahead`` marks the row that only follows.
    """
    spark = docs.sparkSession
    ranges = ranges or 2 * shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = id_ranges(rows, ranges)
    starts = [k for k, _ in known if k is not None]
    width = max(1, math.isqrt(len(starts)))
    # the number of bounds not above an id, found among every width-th of them first
    below = lambda bounds, c: F.size(F.filter(bounds, lambda b: b <= c))
    if starts:
        coarse = F.greatest(below(F.array(*map(F.lit, starts[::width])), F.col("doc_id")), F.lit(1)) - 1
        fine = below(F.slice(F.array(*map(F.lit, starts)), coarse * width + 1, F.lit(width)), F.col("doc_id"))
        place = F.greatest(coarse * width + fine, F.lit(1)) + (len(known) - len(starts)) - 1
    else:
        place = F.lit(0)
    place = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place)
    bases = [0, *itertools.accumulate(n for _, n in known)]
    hot = {p: n for p, (_, n) in enumerate(known) if n > 1}
    dealt = rows.withColumn("place", place.cast("int"))
    if hot:
        is_hot = F.col("place").isin(list(hot))
        sizes = F.array(*[F.lit(n) for _, n in known])
        dealt = dealt.withColumn("h", F.when(is_hot, F.xxhash64("text")).otherwise(F.lit(0)))
        part = F.when(is_hot, F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.get(sizes, F.col("place")))).otherwise(F.lit(0))
        base = F.get(F.array(*map(F.lit, bases)), F.col("place"))
        dealt = dealt.withColumn("bucket", (base + F.least(part, F.get(sizes, F.col("place")) - 1)).cast("int"))
    else:
        dealt = dealt.withColumn("h", F.lit(0).cast("long")).withColumn("bucket", F.col("place"))
    dealt = dealt.select("bucket", F.lit(False).alias("ahead"), "doc_id", "h", "text")
    heads = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("head")).orderBy("bucket").collect()  # a row for each range
    if not heads:
        return dealt
    # the first row of a range goes to the range before it, that of the first range to the last one
    to = {h.bucket: heads[k - 1].bucket for k, h in enumerate(heads)}
    wanted = [(h.bucket, h.head.doc_id, h.head.h, to[h.bucket]) for h in heads]
    want = F.broadcast(spark.createDataFrame(wanted, "b int, head long, head_h long, target int"))  # a row for each range
    firsts = dealt.join(want, (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")))
    firsts = firsts.groupBy("target").agg(F.min(F.struct("doc_id", "h", "text")).alias("r")).select(F.col("target").alias("bucket"), F.lit(True).alias("ahead"), "r.*")
    n = shuffle_partitions(spark)
    return dealt.unionByName(firsts).repartitionById(n, F.pmod("bucket", F.lit(n))).sortWithinPartitions("bucket", "ahead", "doc_id", "h", "text")


def edited_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited form and of the next text, with their likeness.

    Edited: the last floor(n/4) code points are replaced by the first as many (or all) of the next document's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text, fingerprint) of the row before

        for batch in slices(batches):
            out = []
            for bucket, ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id", "text"))):
                own = fingerprint(text)
                if held and held[0] == bucket:
                    out.append((*row(held[1], held[2], held[3], text), own))
                held = None if ahead else (bucket, doc_id, text, own)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

    def row(doc_id, text: str, own: str, following: str) -> tuple:
        n = len(text)
        edited = text[: n - n // 4] + following[: n // 4]
        return doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), own, own if edited == text else fingerprint(edited)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    found = map_texts(with_next(docs, ranges).select("bucket", "ahead", "doc_id", "text"), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    return found.select(
        *names[:5], likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
