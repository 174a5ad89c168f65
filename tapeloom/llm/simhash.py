"""Operator 2: SimHash near-dedup.

Fingerprint: of the words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, 3-word shingles joined by one space,
repeats included (fewer words: the whole sequence; none: zero); each shingle's XXH64 (seed 42); a bit is 1 if it is set in over
half of them.

Linking: covering locality-sensitive hashing. Bits 0-63 get the numbers 1-15 in turn as vectors of r + 1 bits; the mask of
a nonzero vector v keeps the bits whose vector has an odd inner product with v. The vectors of at most r differing
bits span at most r dimensions, so some v is orthogonal to all of them and that mask keeps none of
the differing bits: every pair within radius r agrees under one of the 2**(r+1) - 1 masks.

Work is on distinct fingerprints. Buckets with one fingerprint are dropped by a count. A crowded bucket (more than HOT
fingerprints) is dealt into buckets of a second set of masks, over other numbers of the bits, by the same rule: its pairs within the radius agree under one of those
too. A bucket with more than a block is cut into blocks, every two of which meet in a group of bounded size. A group yields a spanning forest
of its links, not all its pairs.

Cases: null and empty texts have fingerprint zero and link like any other; rows that repeat a doc_id keep
their own fingerprint each, component_id is the smallest doc_id of the component; rows without doc_id are kept and
never name a component unless it has no other row (then component_id is null). Columns beyond doc_id and text are ignored. Texts of any
length are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bytes_of, map_texts, materialise, positional, shuffle_partitions, slices
from .components import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of a block; a group holds two blocks at most.
BLOCK = 1024
#: Fingerprints of a bucket beyond which it is dealt out once more.
HOT = 16 * BLOCK
#: Ids that may be broadcast (8 bytes each) when a filter is by id; beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    words = data.lower().split()  # of bytes: lower() changes A-Z only, split() cuts at 20, 09-0D
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_digest
    joined = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends)])
    bits = np.unpackbits(np.frombuffer(joined, np.uint8).reshape(n, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(x) for x in bytes_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS, number: Callable[[int], int] = lambda i: i) -> list[int]:
    """The masks, as signed longs; bit i has the vector 1 + number(i) mod (2**(radius + 1) - 1). Any numbers give masks that cover."""
    size = 1 << (radius + 1)
    out = []
    for v in range(1, size):
        mask = sum(1 << i for i in range(bits) if (v & (1 + number(i) % (size - 1))).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join exactly the fingerprints linked directly or through others of the group."""
    labels, edges = np.arange(len(fps)), []
    for i in range(len(fps) - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= radius) + i + 1
        if len(near):
            joined = np.unique(labels[np.append(near, i)])
            if len(joined) > 1:
                labels[np.isin(labels, joined)] = joined[0]
                edges += [(int(joined[0]), int(k)) for k in joined[1:]]
    return edges


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): a graph on the distinct fingerprints ``fp`` whose components are those of all pairs within the radius."""
    first, second = covering_masks(radius), covering_masks(radius, number=lambda i: 2 * i + i // ((2 << radius) - 1))
    masked = lambda masks: F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = lambda rows: rows.select("fp", "t", "k", "l", blocks.alias("m"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("s"))
    count = lambda rows: rows.groupBy("t", "k", "l").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = distinct.select("fp").select("fp", masked(first).alias("t", "k")).withColumn("l", F.lit(0).cast("long"))
    full = materialise(count(buckets), "simhash-counts")
    joined = materialise(buckets.join(full, ["t", "k", "l"]), "simhash-buckets")
    rows = dealt(joined.where(F.col("n") <= HOT))
    if full.where(F.col("n") > HOT).limit(1).count():
        # t tells the pair of masks, k and l the bits under each
        again = joined.where(F.col("n") > HOT).select("fp", F.col("t").alias("t1"), "k", masked(second).alias("t2", "l"))
        again = again.select("fp", (F.col("t1") + len(first) * (F.col("t2") + 1)).alias("t"), "k", "l")
        rows = rows.union(materialise(dealt(again.join(count(again), ["t", "k", "l"])), "simhash-again"))
    groups = rows.select("fp", "t", "k", "l", "s", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
    groups = groups.select("fp", "t", "k", "l", F.least("s", "j").alias("a"), F.greatest("s", "j").alias("b"))
    keys = ["t", "k", "l", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def close(pieces: list[np.ndarray]) -> list[tuple[int, int]]:
            own = np.concatenate(pieces)
            return [(int(own[a]), int(own[b])) for a, b in forest(own.view(np.uint64), radius)]

        for batch in batches:
            if not batch.num_rows:
                continue
            fps = batch.column("fp").to_numpy()
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            out: list[tuple[int, int]] = []
            for a, b in zip(cuts, cuts[1:]):
                now = tuple(key[:, a].tolist())
                if now != last and held:
                    out += close(held)
                    held = []
                last = now
                held.append(fps[a:b])
            yield _edges(out)
        if held:
            yield _edges(close(held))

    def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    parts = groups.repartition(shuffle_partitions(distinct.sparkSession), *keys).sortWithinPartitions(*keys)
    return parts.mapInArrow(run, "u long, v long")


def rooted_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row; root is a fingerprint that only rows of its component have."""
    own = materialise(fingerprints(docs), "simhash")
    classes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    stars = connected_components(links(classes, radius), "simhash-links")
    linked = classes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialise(linked.join(roots, "root").select("fp", "root", "component_id"), "simhash-labels")
    return own.join(labels, "fp").select("doc_id", "fp", "root", "component_id")


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    return rooted_groups(docs, radius).select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each group the row with the smallest doc_id.

    Rows without doc_id stay. Rows that repeat a doc_id are judged by their own texts: one goes only if its own group has a
    smaller doc_id. Of those of one doc_id and one group that would stay, one does (that with the smallest text, of equal texts that whose row as JSON has the smallest digest).
    Columns may have any names and types.
    """
    names, docs = docs.columns, positional(docs)
    groups = rooted_groups(docs, radius)
    gone = materialise(groups.where("doc_id <> component_id").select("doc_id").distinct(), "simhash-gone")
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    again = materialise(again, "simhash-repeats")
    repeats = again.count()
    again = F.broadcast(again) if repeats <= BROADCAST_IDS else again
    small = gone.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)
    if not repeats:
        return left.toDF(*names)
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(x) for x in bytes_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, "fp"])

    rows = docs.join(again, "doc_id", "left_semi").select(*kept)
    rows = map_texts(rows, run, StructType([*rows.schema.fields, StructField("fp", LongType())]))
    own = groups.join(again, "doc_id", "left_semi").where("doc_id = component_id").select("doc_id", "fp", "root").distinct()
    row = F.struct(*[c for c in kept if c != "doc_id"])
    one = rows.join(own, ["doc_id", "fp"]).groupBy("doc_id", "root").agg(F.min_by(row, F.struct("text", F.sha2(F.to_json(row), 256))).alias("row")).select("doc_id", "row.*")
    return left.join(again, "doc_id", "left_anti").select(*kept).union(one.select(*kept)).toDF(*names)
