"""Ranks, places, sums below a value and expanding order statistics, of groups of any size.

Distinct values are counted first, then dealt by range of (group, value) into cells: Spark samples the bounds, so a hot group gets as many cells as its share of
all values, and outliers cost nothing. What lies below a value is what the group's cells before its own hold (a row for each cell and group), and what its cell holds below it. No
window spans more than a cell. The dealt table is written to the shared folder once, as its cells are used twice.

Expanding ranks and quantiles count in two dimensions: rows are dealt into time cells and value cells of equal numbers of rows. What a row has before and below it are whole
cells, by sums over the grid, and the rest of its own time cell and of its own value cell, which are counted there exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.numeric import clean
from ..sources.scratch import written
from .windows import halo, own_rows

#: Rows of a time cell or a value cell at least, and such cells of a series at most.
CELL, GRID = 4096, 1024


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys of which null is one; the columns of left, then those that right has besides."""
    if not keys:
        return left.crossJoin(F.broadcast(right)) if how == "inner" else left.join(F.broadcast(right), F.lit(True), how)  # right is one row
    renamed = right.select(*[F.col(f"`{k}`").alias(f"key {k}") for k in keys], *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`key {k}`"))
    return left.join(renamed, same, how).drop(*[f"key {k}" for k in keys])


def dealt(rows: DataFrame, by: list[str], on: str | list[str]) -> DataFrame:
    """rows with (part, at): sorted by (by, on), dealt into parts by range. at is the place in all parts, with gaps between them."""
    spark = rows.sparkSession
    order = [F.col(f"`{c}`").asc_nulls_first() for c in (*by, *([on] if isinstance(on, str) else on))]
    parts = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return written(parts.withColumn("at", F.monotonically_increasing_id()), "dealt").withColumn("part", F.shiftright("at", 33))


def below(counts: DataFrame, by: list[str], x: str, sums: list[str]) -> DataFrame:
    """Add ``below <name>`` for each of sums: the sum of that column over the rows of the group with a smaller x. One row for each (by, x)."""
    rows = dealt(counts, by, x)
    keys = [F.col(f"`{k}`") for k in by]
    totals = rows.groupBy(*keys, "part").agg(*[F.sum(f"`{n}`").alias(n) for n in sums])
    before = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part
    bases = totals.select(*keys, "part", *[F.coalesce(F.sum(f"`{n}`").over(before), F.lit(0)).alias(f"base {n}") for n in sums])
    inside = W.partitionBy(*keys, "part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    found = [(F.col(f"`base {n}`") + F.coalesce(F.sum(f"`{n}`").over(inside), F.lit(0))).alias(f"below {n}") for n in sums]
    return join_on(rows, bases, [*by, "part"]).select(*[F.col(f"`{c}`") for c in counts.columns], *found)


def value_ranks(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, x, ties, rank) of every distinct value of each group, null left out: equal values share their mean rank."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("ties"))
    return below(counts, by, x, ["ties"]).select(*by, x, "ties", (F.col("`below ties`") + (F.col("ties") + 1) / 2.0).alias("rank"))


def with_rank(df: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """Add the average rank of x among the group's values; null for null."""
    return join_on(df, value_ranks(df, by, x).select(*by, x, F.col("rank").alias(name)), [*by, x], "left")


def with_pct_rank(df: DataFrame, by: list[str], x: str, name: str = "pct_rank") -> DataFrame:
    """Add the average rank of x as a share of the group's values; looks ahead by definition."""
    ranks = value_ranks(df, by, x)
    sizes = ranks.groupBy(*by).agg(F.sum("ties").alias("values of x"))
    shares = join_on(ranks, sizes, by).select(*by, x, (F.col("rank") / F.col("`values of x`")).alias(name))
    return join_on(df, shares, [*by, x], "left")


def rank_correlation(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, spearman) of the rows with both values. Equal pairs are counted together before ranks are joined to them."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = written(known.groupBy(*by, F.col(x).cast("double").alias("x of pair"), F.col(y).cast("double").alias("y of pair")).agg(F.count(F.lit(1)).alias("pair n")), "pairs")
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s} of pair").alias("value")) for s in ("x", "y")]))
    counts = pairs.select(*by, "pair n", sides.alias("one side")).groupBy(*by, F.col("`one side`.side"), F.col("`one side`.value")).agg(F.sum("pair n").alias("ties"))
    own = below(counts, [*by, "side"], "value", ["ties"]).withColumn("rank", F.col("`below ties`") + (F.col("ties") + 1) / 2.0)
    ranked = pairs
    for s in ("x", "y"):
        ranked = join_on(ranked, own.where(F.col("side") == s).select(*by, F.col("value").alias(f"{s} of pair"), F.col("rank").alias(f"rank {s}")), [*by, f"{s} of pair"])
    # the mean of n ranks is (n + 1) / 2, so deviations are known without a pass of their own
    sizes = pairs.groupBy(*by).agg((F.sum("pair n") / 2.0 + 0.5).alias("middle"))
    n, rx, ry = F.col("`pair n`"), F.col("`rank x`") - F.col("middle"), F.col("`rank y`") - F.col("middle")
    out = join_on(ranked, sizes, by).groupBy(*by).agg(F.sum(n * rx * ry).alias("xy"), F.sum(n * rx * rx).alias("xx"), F.sum(n * ry * ry).alias("yy"))
    spread = F.sqrt("xx") * F.sqrt("yy")
    return out.select(*by, F.when(spread > 0, F.col("xy") / F.when(spread > 0, spread)).alias("spearman"))


def numbered(df: DataFrame, by: list[str], on: str | list[str], name: str = "i") -> DataFrame:
    """df, written, with the place of a row in its group by ``on`` (one column or several), from 0; rows of equal ``on`` are in no order."""
    rows = dealt(df, by, on)
    keys = [F.col(f"`{k}`") for k in by]
    parts = rows.groupBy(*keys, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part
    shift = parts.select(*keys, "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return join_on(rows, shift, [*by, "part"]).withColumn(name, F.col("at") + F.col("shift")).drop("part", "at", "shift")


def in_chunks(df: DataFrame, by: list[str], on: str, before: int, after: int, work: Callable[[DataFrame, list[str]], DataFrame], chunk: int = CELL) -> DataFrame:
    """``work(rows, keys)`` on chunks of a series instead of the series: rows have their place ``i`` in it, keys are those of a chunk, and each chunk has the ``before`` rows before it and
    the ``after`` rows behind it too. Windows over keys whose frames reach no further give the values of the whole series. ``work`` keeps the columns chunk and own."""
    rows = halo(numbered(df, by, on), "i", max(chunk, 4 * (before + after)), before, after)
    return own_rows(work(rows, [*by, "chunk"]))


def every_nth(df: DataFrame, by: list[str], on: str, n: int) -> DataFrame:
    """The first row of each series and every n-th after it."""
    return numbered(df, by, on).where(F.col("i") % n == 0).drop("i")


def sequences(df: DataFrame, by: list[str], on: str, columns: list[str], length: int, stride: int = 1, include: bool = True) -> DataFrame:
    """Windows of ``length`` rows as arrays, ending at the row itself or at the one before it."""
    first = length - 1 if include else length

    def work(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = W.partitionBy(*keys).orderBy("i")
        return rows.withColumn("window", F.collect_list(F.struct(*columns)).over(w.rowsBetween(-first, 0 if include else -1)))

    rows = in_chunks(df.select(*dict.fromkeys([*by, on, *columns])), by, on, length, 0, work)
    return rows.where((F.size("window") == length) & ((F.col("i") - first) % stride == 0)).select(*by, on, "window")


def exact_quantiles(df: DataFrame, levels: dict[str, list[float]]) -> dict[str, list[float]]:
    """The quantiles of each named column at its levels, between neighbours by position; none for a column without values (null and NaN are none).

    All columns are dealt together, and only the rows beside a level come to the driver: two for each."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), clean(F.col(c).cast("double")).alias("value")) for c in levels]))
    long = df.select(values.alias("one value")).select(F.col("`one value`.name"), F.col("`one value`.value")).where("value is not null")
    rows = numbered(long, ["name"], "value")
    sizes = {r["name"]: r["n"] for r in rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each column
    at = {c: [q * (sizes[c] - 1) for q in qs] for c, qs in levels.items() if c in sizes}
    needed = sorted({(c, i) for c, xs in at.items() for x in xs for i in (math.floor(x), math.ceil(x))})
    if not needed:
        return {c: [] for c in levels}
    near = F.broadcast(df.sparkSession.createDataFrame(needed, "name string, i long"))
    found = {(r["name"], r["i"]): r["value"] for r in rows.join(near, ["name", "i"]).collect()}

    def between(c: str, x: float) -> float:
        low, high = found[c, math.floor(x)], found[c, math.ceil(x)]
        return low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high

    return {c: [between(c, x) for x in at.get(c, [])] for c in levels}


# --- expanding order statistics ---


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place: how many earlier places hold a smaller value. Halves are merged level by level, all blocks of a level at once."""
    n = len(values)
    out, place = np.zeros(n, np.int64), np.arange(n)
    order = np.argsort(values, kind="stable")  # by value, then place
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.append(0, np.diff(values[order]) != 0)) if n else 0
    width = 1
    while width < n:
        block = place // (2 * width)
        left = (place // width) % 2 == 0
        # within a block by value, right halves before left ones of equal value, as only smaller values count
        by_value = np.lexsort((left, rank, block))
        lefts = np.cumsum(left[by_value])
        start = np.searchsorted(block[by_value], block[by_value])  # the block's first place
        before = lefts - np.where(start > 0, lefts[start - 1], 0)
        right = ~left[by_value]
        out[by_value[right]] += before[right]
        width *= 2
    return out


def streamed(df: DataFrame, keys: list[str], order: list[str], schema: str, compute: Callable[[pa.Table], list]) -> DataFrame:
    """The columns that ``compute(rows)`` gives for each group of rows, which are sorted by ``order`` and held at once: for groups of bounded size."""
    dealt = df.repartition(*[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{k}`") for k in (*keys, *order)])
    kinds = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from pa.table(compute(table), schema=kinds).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            codes = [table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() for k in keys]
            edges = [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1).tolist()]
            for a, b in zip(edges, edges[1:]):
                yield from closed(table.slice(a, b - a))
            held = table.slice(edges[-1]).to_batches()
        if held:
            yield from closed(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)


def _added(df: DataFrame, keys: list[str], order: list[str], name: str, count: Callable[[np.ndarray], np.ndarray], of: str) -> DataFrame:
    """Add ``count(values of a column)`` of each group, as a long."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` long"
    return streamed(df, keys, order, schema, lambda table: [*table.columns, pa.array(count(table.column(of).to_numpy()), pa.int64())])


def _grid_rows(df: DataFrame, by: list[str], on: str, value: str, cell: int, most: int) -> DataFrame:
    """(by, on, v, i, tc, vc, first, ties, size): the place of each row in its series and its time cell and, where it has a value, its value cell.

    Value cells are even: those of values with more than a cell's rows, which hold only such a value, are odd and follow the even one of the same place."""
    v = clean(F.col(value).cast("double"))
    rows = numbered(df.select(*by, on, v.alias("v")), by, on)
    sizes = rows.groupBy(*by).agg(F.greatest(F.lit(cell), F.ceil(F.count(F.lit(1)) / F.lit(most))).cast("long").alias("size"))
    counts = rows.where("v is not null").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("ties"))
    counts = below(counts, by, "v", ["ties"]).withColumnRenamed("below ties", "first")
    rows = join_on(join_on(rows, counts, [*by, "v"], "left"), sizes, by)
    vc = 2 * F.floor(F.col("first") / F.col("size")) + (F.col("ties") > F.col("size")).cast("long")
    rows = rows.withColumns({"tc": F.floor(F.col("i") / F.col("size")).cast("long"), "vc": F.when(F.col("v").isNotNull(), vc).cast("long")})
    return written(rows, "grid")


def _grid_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, tc, vc, before, corner): of every time cell and value cell of a series, how many rows of the value cell lie in earlier time cells, and how many of
    smaller value cells do."""
    counts = rows.where("vc is not null").groupBy(*by, "tc", "vc").agg(F.count(F.lit(1)).alias("n"))
    ends = rows.groupBy(*by).agg(F.max("tc").alias("last tc"), F.coalesce(F.max("vc"), F.lit(0)).alias("last vc"))
    grid = ends.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), "last tc")).alias("tc"), "last vc").select(*by, "tc", F.explode(F.sequence(F.lit(0).cast("long"), "last vc")).alias("vc"))
    full = join_on(grid, counts, [*by, "tc", "vc"], "left").fillna(0, ["n"])
    earlier = F.coalesce(F.sum("n").over(W.partitionBy(*by, "vc").orderBy("tc").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # GRID rows at most
    full = full.withColumn("before", earlier)
    return full.withColumn("corner", F.coalesce(F.sum("before").over(W.partitionBy(*by, "tc").orderBy("vc").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")


def expanding_pct_rank(df: DataFrame, by: list[str], on: str, value: str, least: int = 200, cell: int = CELL, most: int = GRID) -> DataFrame:
    """Add pct_rank: the average rank of a row's value among the values of its series up to that row, as a share; null before ``least`` values and where it has none.

    ``on`` is a number and unique in a series. Smaller earlier values are those of smaller value cells in earlier time cells, those of smaller value cells in its own
    time cell, and those of its own value cell; equal ones are counted by time cells."""
    rows = _grid_rows(df.where(clean(F.col(value).cast("double")).isNotNull()), by, on, value, cell, most)
    corner = _grid_counts(rows, by).select(*by, "tc", "vc", "corner")
    same = rows.groupBy(*by, "v", "tc").agg(F.count(F.lit(1)).alias("n"))
    equal = same.select(*by, "v", "tc", F.coalesce(F.sum("n").over(W.partitionBy(*by, "v").orderBy("tc").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("equal"))
    rows = join_on(join_on(rows, corner, [*by, "tc", "vc"]), equal, [*by, "v", "tc"])
    here = F.row_number().over(W.partitionBy(*by, "v", "tc").orderBy("i"))
    rows = rows.withColumn("equal", F.col("equal") + here)
    rows = _added(rows, [*by, "tc"], ["i"], "in time", smaller_before, "vc")
    odd = F.col("vc") % 2 == 1
    crowded = rows.where(odd).withColumn("in value", F.lit(0).cast("long"))  # nothing of such a cell is smaller
    rows = _added(rows.where(~odd), [*by, "vc"], ["i"], "in value", smaller_before, "v").unionByName(crowded)
    smaller, n = F.col("corner") + F.col("`in time`") + F.col("`in value`"), F.col("i") + 1
    found = rows.select(*by, on, F.when(n >= least, (smaller + (F.col("equal") + 1) / 2.0) / n).alias("pct_rank"))
    return join_on(df, found, [*by, on], "left")


def _cells_of_quantiles(base: np.ndarray, vc: np.ndarray, known: np.ndarray, q: float, least: int) -> list[np.ndarray]:
    """For the rows of a time cell, in order: the two value cells of the quantile of all known rows before each, the place in them, and what of the upper counts.

    base: known rows of each value cell before the time cell; vc: value cells of the rows (any, where not known)."""
    n = len(vc)
    out = [np.full(n, -1, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n)]
    held = base.astype(np.int64).copy()
    for a in range(0, n, 256):
        b = min(a + 256, n)
        steps = np.zeros((b - a, len(held)), np.int64)
        inner = np.flatnonzero(known[a : b - 1])
        steps[inner + 1, vc[a : b - 1][inner]] = 1
        upto = np.cumsum(np.cumsum(steps, axis=0) + held, axis=1)  # known rows before the row in the cells up to each
        m = upto[:, -1] if upto.shape[1] else np.zeros(b - a, np.int64)
        at = q * np.maximum(m - 1, 0)
        low, high = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
        good = np.flatnonzero(m >= max(least, 1))
        for k, want in ((0, low), (2, high)):
            cell = (upto[good] <= want[good, None]).sum(axis=1)
            out[k][a + good] = cell
            out[k + 1][a + good] = want[good] - np.where(cell > 0, upto[good, np.maximum(cell - 1, 0)], 0)
        out[4][a:b] = at - low
        np.add.at(held, vc[a:b][known[a:b]], 1)
    return out


def select_before(times: np.ndarray, until: np.ndarray, place: np.ndarray) -> np.ndarray:
    """times: of elements in the order of their values. For each query the number of the element that has ``place`` smaller ones among those before the time ``until``.
    All queries descend a tree of halves at once."""
    size = 1 << max(len(times) - 1, 0).bit_length()
    big = np.int64(max(int(times.max(initial=0)), int(until.max(initial=0))) + 2)
    full = np.full(size, big - 1, np.int64)
    full[: len(times)] = times
    node, rest = np.zeros(len(until), np.int64), place.astype(np.int64).copy()
    while size > 1:
        size //= 2
        halves = np.sort(full.reshape(-1, size), axis=1)
        keys = (halves + np.arange(len(halves))[:, None] * big).ravel()
        lefts = np.searchsorted(keys, 2 * node * big + until) - 2 * node * size
        right = rest >= lefts
        rest = np.where(right, rest - lefts, rest)
        node = 2 * node + right
    return node


def expanding_quantile(df: DataFrame, by: list[str], on: str, value: str, qs: dict[str, float], least: int, cell: int = CELL, most: int = GRID) -> DataFrame:
    """Add for each name the exact quantile (between neighbours by position) of the values of the rows before a row in its series; null before ``least`` values.

    ``on`` is a number and unique in a series. Counts by time cell and value cell tell for every row in which value cells its quantile lies, and the exact element is selected there,
    by groups of one value cell and the queries of one time cell."""
    rows = _grid_rows(df, by, on, value, cell, most)
    base = _grid_counts(rows, by).groupBy(*by, "tc").agg(F.transform(F.array_sort(F.collect_list(F.struct("vc", "before"))), lambda s: s["before"]).alias("base"))  # 2 * GRID numbers
    elements = rows.where("vc % 2 = 0").select(*by, "vc", F.col("tc").alias("element tc"), "i", "v")
    crowded = rows.where("vc % 2 = 1").groupBy(*by, "vc").agg(F.max("v").alias("only v"))
    asked = written(_queries(rows, base, by, qs, least), "quantiles")
    both = [F.struct(F.concat_ws(" ", "name", F.lit(s)).alias("side"), F.col(f"{s} vc").alias("vc"), F.col(f"{s} place").alias("place")) for s in ("low", "high")]
    sides = asked.select(*by, "tc", "i", F.explode(F.array(*both)).alias("asked for")).select(*by, "tc", "i", *[F.col(f"`asked for`.{c}") for c in ("side", "vc", "place")])
    wanted = sides.where("vc % 2 = 0").select(*by, "vc", "tc").distinct()
    near = join_on(wanted, elements, [*by, "vc"]).where(F.col("`element tc`") <= F.col("tc"))
    found = _selected(near, sides.where("vc % 2 = 0"), by)
    alone = join_on(sides.where("vc % 2 = 1"), crowded, [*by, "vc"]).select(*by, "i", "side", F.col("only v").alias("v"))
    ends = found.unionByName(alone).groupBy(*by, "i").agg(*[F.max(F.when(F.col("side") == f"{n} {s}", F.col("v"))).alias(f"{n} {s}") for n in qs for s in ("low", "high")])
    parts = asked.groupBy(*by, on, "i").agg(*[F.max(F.when(F.col("name") == n, F.col("part"))).alias(f"{n} part") for n in qs])
    between = lambda n: F.col(f"`{n} low`") + (F.col(f"`{n} high`") - F.col(f"`{n} low`")) * F.col(f"`{n} part`")
    return join_on(df, join_on(parts, ends, [*by, "i"]).select(*by, on, *[between(n).alias(n) for n in qs]), [*by, on], "left")


def _queries(rows: DataFrame, base: DataFrame, by: list[str], qs: dict[str, float], least: int) -> DataFrame:
    """(by, on, tc, i, name, low vc, low place, high vc, high place, part) of the rows with enough values before them."""
    heads = base.select(*by, "tc", "base").withColumn("i", F.lit(-1).cast("long"))
    every = rows.drop("v", "first", "ties", "size").withColumn("base", F.lit(None).cast("array<bigint>")).unionByName(heads, allowMissingColumns=True)
    names = [c for c in rows.columns if c not in ("v", "first", "ties", "size", "vc")]
    added = ["low vc", "low place", "high vc", "high place"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", name string" + "".join(f", `{c}` long" for c in added) + ", part double"

    def compute(table: pa.Table) -> list[pa.Array]:
        head, own = table.column("base")[0], table.slice(1)
        vc = own.column("vc")
        known = vc.is_valid().to_numpy()
        made = []
        for name, q in qs.items():
            found = _cells_of_quantiles(np.asarray(head.values), vc.fill_null(0).to_numpy(), known, q, least)
            keep = pa.array(found[0] >= 0)
            made.append(own.select(names).append_column("name", pa.array([name] * own.num_rows, pa.string())))
            for c, f in zip([*added, "part"], found):
                made[-1] = made[-1].append_column(c, pa.array(f))
            made[-1] = made[-1].filter(keep)
        return pa.concat_tables(made).columns

    return streamed(every, [*by, "tc"], ["i"], schema, compute)


def _selected(elements: DataFrame, sides: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, side, v): the element of each query. Groups are of one value cell and one time cell."""
    a = elements.select(*by, "vc", "tc", F.lit(0).alias("kind"), "v", "i", F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("side"))
    b = sides.select(*by, "vc", "tc", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("v"), "i", "place", "side")
    schema = ", ".join(f"`{c}` {elements.schema[c].dataType.simpleString()}" for c in by) + (", " if by else "") + "i long, side string, v double"

    def compute(table: pa.Table) -> list[pa.Array]:
        n = table.num_rows - int(np.count_nonzero(table.column("kind").to_numpy()))
        values, asked = table.slice(0, n), table.slice(n)
        at = select_before(values.column("i").to_numpy(), asked.column("i").to_numpy(), asked.column("place").to_numpy())
        return [*(asked.column(c) for c in by), asked.column("i"), asked.column("side"), values.column("v").take(pa.array(at))]

    return streamed(a.unionByName(b), [*by, "vc", "tc"], ["kind", "v", "i"], schema, compute)
