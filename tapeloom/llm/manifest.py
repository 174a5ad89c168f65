"""Operator 13: Merkle manifest of a table.

Every row is a leaf: the SHA-256 of its values. The leaves of a group ascend by their id; every ``fanout`` consecutive nodes (the last ones of a level:
fewer, even one) become the SHA-256 of their digests, until one is left, the group's root. The roots of the groups, in the order of the groups,
make the table's root in the same way. Digests are lowercase hex, and inputs are joined as text without padding.

Method: a mountain-range stack for each indexed partition. Rows are dealt by range of (group, id) and sorted, so partitions of any size hold
consecutive leaves; their first places come from the row counts of the partitions (one row for each partition and group). Each task then pushes its leaves
on a stack of peaks: when a run of ``fanout`` is full, it carries into the next level, as in counting to the base ``fanout``, and a node record
is emitted. A run that began before the partition, or ends behind it, stays behind as peaks, a few for each level. Peaks are merged by the same
stack, SPAN levels at a time, in groups of one aligned block each: a group holds at most fanout**SPAN nodes, whatever the size of the table, and a
table of n leaves needs log(n) / SPAN rounds.

Proofs go the other way: the block of SPAN levels under a node gives its lowest nodes their siblings, which are put before the path of the
node that stands above the block. So every task holds one block, and no level is joined with the leaves.

Cases: a null id sorts first; rows that repeat an id follow in the order of their leaves; null groups are a group, the first one; an empty table
gives an empty result; texts of any length are hashed whole, by Spark's own functions; columns beyond those hashed are ignored. Ids may be of any type
that sorts; groups are strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialise, shuffle_partitions

#: Levels that one group of a round holds, for a fanout of 2 (fewer for more).
SPAN = 9
#: The columns that a row's hash covers.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "g string, n long, level int, idx long, digest string"
NODE_COLUMNS = ["g", "n", "level", "idx", "digest"]


def node_hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def span_of(fanout: int) -> int:
    span = 1
    while fanout ** (span + 1) <= 2**SPAN:
        span += 1
    return span


def height(n: int, fanout: int) -> int:
    """Levels above n leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def row_hash(values: list[Column]) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its bytes in UTF-8, ``:`` and the value (numbers in decimals)."""

    def one(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(one, values)), 256)


def indexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a column g, never null) and their places ``idx`` in the group g by ``order``, nulls first, with the group's size ``n``."""
    spark = rows.sparkSession
    by = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    # partition and place in it as one number
    dealt = materialise(dealt.withColumn("at", F.monotonically_increasing_id()), "manifest-sorted").withColumn("part", F.shiftright("at", 33))
    pieces = dealt.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    group = Window.partitionBy("g")
    before = F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    pieces = materialise(pieces.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n")), "manifest-pieces")
    return dealt.join(pieces, ["g", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


class Range:
    """Peaks of consecutive nodes of one group. ``out`` gets (level, idx, digest, peak): nodes made here, and as peaks those that must be merged with others."""

    def __init__(self, fanout: int, n: int, most: int | None, out: list):
        self.fanout, self.most, self.out = fanout, most, out
        self.sizes = [n]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // fanout))
        self.peaks: list[list[tuple[int, str]]] = [[] for _ in self.sizes]

    def push(self, level: int, idx: int, digest: str, made: bool = False) -> None:
        while True:
            root = self.sizes[level] == 1
            if made:
                self.out.append((level, idx, digest, False))
            if root or level == self.most:
                if not root:
                    self.out.append((level, idx, digest, True))
                return
            waiting, place = self.peaks[level], idx % self.fanout
            waiting.append((idx, digest))
            if place < self.fanout - 1 and idx < self.sizes[level] - 1:
                return
            if len(waiting) <= place:  # the run began before
                self.close(level)
                return
            digest = node_hash([d for _, d in waiting])
            waiting.clear()
            level, idx, made = level + 1, idx // self.fanout, True

    def close(self, level: int) -> None:
        self.out += [(level, idx, digest, True) for idx, digest in self.peaks[level]]
        self.peaks[level].clear()

    def end(self) -> None:
        for level in range(len(self.peaks)):
            self.close(level)


def climb(nodes: DataFrame, fanout: int, most: int | None) -> DataFrame:
    """Push nodes that are sorted by (g, first leaf) within their partitions; nodes of the level ``most`` become peaks at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, after, stack = None, 0, None  # group, leaf behind the last node
        out: list[tuple[int, int, str, bool]] = []
        tags: list[tuple[str, int]] = []

        def end() -> None:
            if stack is not None:
                stack.end()
                tags.extend([now] * (len(out) - len(tags)))

        def batch_of() -> pa.RecordBatch:
            columns = [[t[0] for t in tags], [t[1] for t in tags], *([o[k] for o in out] for k in range(4))]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["g", "n", "level", "idx", "digest", "peak"])
            out.clear()
            tags.clear()
            return made

        for batch in batches:
            for g, n, level, idx, digest in zip(*(batch.column(c).to_pylist() for c in ("g", "n", "level", "idx", "digest"))):
                width = fanout**level
                if (g, n) != now or idx * width != after:
                    end()
                    now, stack = (g, n), Range(fanout, n, most, out)
                after = min((idx + 1) * width, n)
                stack.push(level, idx, digest)
            tags.extend([now] * (len(out) - len(tags)))
            yield batch_of()
        end()
        yield batch_of()

    return nodes.select("g", "n", "level", "idx", "digest").mapInArrow(run, NODE + ", peak boolean")


def inner_nodes(leaves: DataFrame, fanout: int = 2) -> DataFrame:
    """(g, n, level, idx, digest) of every node above the leaves (g, n, idx, digest), the roots among them, written to the shared folder."""
    span, P = span_of(fanout), shuffle_partitions(leaves.sparkSession)
    rows = leaves.select("g", "n", F.lit(0).alias("level"), "idx", "digest").sortWithinPartitions("g", "idx")
    made = materialise(climb(rows, fanout, None), "manifest-nodes")
    nodes, peaks = made.where("not peak"), made.where("peak")
    most = leaves.agg(F.max("n")).first()[0] or 0
    for top in range(span, height(most, fanout) + span, span):
        here = peaks.where(F.col("level") < top)
        width = F.pow(F.lit(float(fanout)), F.col("level")).cast("long")
        here = here.select(*NODE_COLUMNS, (F.col("idx") * width).alias("first")).withColumn("block", F.floor(F.col("first") / F.lit(fanout**top)))
        merged = materialise(climb(here.repartition(P, "g", "block").sortWithinPartitions("g", "first"), fanout, top), "manifest-merged")
        nodes = nodes.union(merged.where("not peak"))
        peaks = peaks.where(F.col("level") >= top).union(merged.where("peak"))
    return nodes.select(*NODE_COLUMNS)


def siblings(level_nodes: list[str], place: int, fanout: int) -> str:
    """``left|right`` of one node among the nodes of its level in a block that is aligned to runs."""
    first = place - place % fanout
    return "".join(level_nodes[first:place]) + "|" + "".join(level_nodes[place + 1 : first + fanout])


def lowest_paths(block: dict[int, list[str]], base: int, top: int, fanout: int) -> Iterator[list[str]]:
    """Of each node of the level ``base``, in order: its siblings at the levels from base to below top."""
    for i in range(len(block[base])):
        out = []
        for level in range(base, top):
            out.append(siblings(block[level], i, fanout))
            i //= fanout
        yield out


def descend(nodes: DataFrame, above: DataFrame, base: int, top: int, fanout: int, emit: str, finish) -> DataFrame:
    """Paths of the nodes of level ``base``. nodes: those of the levels from base to below top, with a column ``extra``; above: (g, n, block, path, subroot, root) of
    what stands on top of each block. ``finish(n, idx, digest, path, extra, subroot, root)`` gives the rows, of schema ``emit``."""
    P = shuffle_partitions(nodes.sparkSession)
    width = F.pow(F.lit(float(fanout)), F.lit(top) - F.col("level")).cast("long")
    rows = nodes.select(*NODE_COLUMNS, "extra", F.floor(F.col("idx") / width).alias("block"), F.lit("").alias("path"), F.lit("").alias("subroot"), F.lit("").alias("root"))
    paths = above.select("g", "n", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit("").alias("digest"), F.lit(None).cast(nodes.schema["extra"].dataType).alias("extra"), "block", "path", "subroot", "root")
    dealt = rows.unionByName(paths).repartition(P, "g", "block").sortWithinPartitions("g", "block", "level", "idx")
    schema = nodes.sparkSession.createDataFrame([], emit).schema
    names = ["g", "block", "level", "n", "idx", "digest", "extra", "path", "subroot", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, block, lowest, out = None, None, {}, [], []

        def close() -> None:
            if not lowest:
                return
            g, n, path, subroot, root = head
            rest = path.split("\n") if path else []
            upto = min(top, height(n, fanout))
            for (idx, digest, extra), own in zip(lowest, lowest_paths(block, base, upto, fanout)):
                out.append((g, *finish(n, idx, digest, own + rest, extra, subroot, root)))

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(kinds)], schema=kinds)
            out.clear()
            return made

        for batch in batches:
            for g, at, level, n, idx, digest, extra, path, subroot, root in zip(*(batch.column(c).to_pylist() for c in names)):
                if (g, at) != now:
                    close()
                    now, head, block, lowest = (g, at), None, {}, []
                if level < 0:
                    head = (g, n, path, subroot, root)
                    continue
                block.setdefault(level, []).append(digest)
                if level == base:
                    lowest.append((idx, digest, extra))
            yield batch_of()
        close()
        yield batch_of()

    kinds = to_arrow_schema(schema)
    return dealt.select(*names).mapInArrow(run, schema)


PATHS = "g string, n long, block long, path string, subroot string, root string"


def proofs(leaves: DataFrame, nodes: DataFrame, above: DataFrame, fanout: int, emit: str, finish) -> DataFrame:
    """Rows of ``finish`` (``descend``) for every leaf (g, n, idx, digest, extra). above: (g, n, path, subroot, root) of the root of every group."""
    span = span_of(fanout)
    most = leaves.agg(F.max("n")).first()[0] or 0
    rounds = max(1, -(-height(most, fanout) // span))
    # the round at which a group's root is the top of its only block
    grown = [fanout ** (span * r) for r in range(1, rounds)]
    starts = above.withColumn("round", sum((F.when(F.col("n") > most_leaves, 1).otherwise(0) for most_leaves in grown), F.lit(1)))
    extra = leaves.schema["extra"].dataType
    paths = None
    for r in range(rounds, 0, -1):
        base, top = (r - 1) * span, r * span
        own = starts.where(F.col("round") == r).select("g", "n", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        paths = own if paths is None else own.union(paths)
        here = nodes.where((F.col("level") >= max(base, 1)) & (F.col("level") < top) & (F.col("n") > fanout**base)).withColumn("extra", F.lit(None).cast(extra))
        if r == 1:
            return descend(leaves.select("g", "n", F.lit(0).alias("level"), "idx", "digest", "extra").unionByName(here.select(*NODE_COLUMNS, "extra")), paths, base, top, fanout, emit, finish)
        keep = lambda n, idx, digest, path, extra, subroot, root: (n, idx, "\n".join(path), subroot, root)
        paths = materialise(descend(here, paths, base, top, fanout, PATHS, keep), "manifest-paths")


def fold(digest: str, path: list[str]) -> str:
    """The root that a leaf and its siblings, level by level, give."""
    for level in path:
        left, _, right = level.partition("|")
        digest = node_hash([left, digest, right])
    return digest


def proof_hash(path: list[str]) -> str:
    """SHA-256 of all siblings, level by level, left to right."""
    return hashlib.sha256("".join(path).replace("|", "").encode()).hexdigest()


def root_rows(leaves: DataFrame, nodes: DataFrame, fanout: int) -> DataFrame:
    """(g, n, digest) of the root of each group."""
    all_ = nodes.where("idx = 0").union(leaves.where("n = 1").select("g", "n", F.lit(0).alias("level"), "idx", "digest"))
    wide = lambda level: F.pow(F.lit(float(fanout)), level)
    return all_.where((wide(F.col("level")) >= F.col("n")) & ((F.col("level") == 0) | (wide(F.col("level") - 1) < F.col("n")))).select("g", "n", "digest")


class Manifest(NamedTuple):
    """leaves: (g, key, digest, extra, n, idx); nodes: (g, n, level, idx, digest) above them; groups: (g, n, path, subroot, root), path being the siblings from the
    group's root to the table's. g is "" for a null group, else "1" and its name."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    fanout: int


def build(leaves: DataFrame, fanout: int = 2) -> Manifest:
    """The manifest of rows (group, key, digest, extra); all its tables lie in the shared folder."""
    rows = leaves.select(F.coalesce(F.concat(F.lit("1"), F.col("group").cast("string")), F.lit("")).alias("g"), "key", "digest", "extra")
    own = materialise(indexed(rows, ["key", "digest"]), "manifest-leaves")
    nodes = inner_nodes(own, fanout)
    roots = materialise(root_rows(own, nodes, fanout), "manifest-roots")
    upper = roots.select(F.lit("").alias("g"), F.col("g").alias("key"), "digest", F.struct("g", "n").alias("extra"))
    upper = materialise(indexed(upper, ["key"]), "manifest-groups")
    inner = inner_nodes(upper, fanout)
    whole = root_rows(upper, inner, fanout).select("g", "n", F.lit("").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    keep = lambda n, idx, digest, path, extra, subroot, root: (extra["g"], extra["n"], "\n".join(path), digest, root)
    groups = proofs(upper, inner, whole, fanout, "all string, g string, n long, path string, subroot string, root string", keep).drop("all")
    return Manifest(own, nodes, materialise(groups, "manifest-tops"), fanout)


def merkle_report(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", key: str = "doc_id", altered: dict[str, Column] | None = None, where: Column | None = None, fanout: int = 2) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row: its proof, and the root that the proof gives for the row as it is, or,
    where the condition holds, with the values of ``altered`` in place of its own."""
    other = [altered[c] if altered and c in altered else F.col(c) for c in columns]
    bad = F.when(where, row_hash(other)) if altered and where is not None else F.lit(None).cast("string")
    made = build(docs.select(F.col(group).alias("group"), F.col(key).alias("key"), row_hash([F.col(c) for c in columns]).alias("digest"), F.struct(F.col(key).alias("key"), bad.alias("other")).alias("extra")), fanout)
    finish = lambda n, idx, digest, path, extra, subroot, root: (extra["key"], digest, subroot, root, proof_hash(path), fold(extra["other"] or digest, path))
    kind = docs.schema[key].dataType.simpleString()
    out = proofs(made.leaves, made.nodes, made.groups, fanout, f"g string, key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string", finish)
    return out.select(F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
