"""Operator 3: benchmark decontamination.

Method: SimHash of item-sized windows; multi-index Hamming blocks, which retrieve every item fingerprint within the
radius; exact weighted-shingle similarity of the retrieved pairs.

For an item of n shingles (five words; a shorter item is one shingle of all its words) every run of n shingles of a document
is a window (a document with fewer is one window). The similarity is the weighted Jaccard index of the two bags of shingles. Of
bags of n and m, at least 0.8 / 1.8 * (n + m) shingles must be shared for 0.8, so a window in which fewer positions hold any shingle of the
benchmark can match no item: only the other windows are fingerprinted. This loses no match.

Fingerprints are cut into four blocks of 16 bits. Within 15 differing bits some block differs in at most three, so
looking up all values within three bits of each of the window's blocks finds every such item. Windows just over the threshold may differ in more bits,
so a second lookup, by shingles, finds what the first misses: a window that matches an item of n shingles shares at least 0.8 of
them, hence one at least of any n - 0.8 * n + 1 of them; the ones that the fewest items have are indexed. Both together lose no match.

The benchmark is the small side: it is broadcast in parts of at most ``PART_WORDS`` words, and each part is one pass over the
documents, so a benchmark of any size works with bounded memory.

Cases: null and empty texts match nothing, nor do items without words; items with equal texts each report; repeated
rows repeat their matches, rows that repeat a doc_id report each its own; a null doc_id is kept; an empty benchmark leaves every document clean,
an empty table gives an empty result. Texts of any length are searched whole. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, map_texts, materialise, positional, slices
from .shingles import SIMILARITY, WORDS, WordHashes, normal_words, positions_of, shingle_hashes

BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 3
#: All fingerprints within this distance are retrieved; matches beyond it are found by their rare shingles.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Words of the benchmark that are indexed at once, some 0.1 KB each.
PART_WORDS = 2_000_000
BROADCAST_IDS = 1_000_000

NEAR = np.array([sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r)], np.int64)


def simhash(h: np.ndarray) -> int:
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h)).tobytes(), "big")


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard index of two bags of hashes."""
    values, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(inverse[: len(a)], minlength=len(values))
    y = np.bincount(inverse[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / max(np.maximum(x, y).sum(), 1))


def by_place(pairs: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """(where the values of each place begin, the values) of distinct pairs (place, value): some bytes a pair, where sets would take hundreds."""
    place, value = np.unique(pairs, axis=1)
    return np.searchsorted(place, np.arange(places + 1)), value


def values_at(held: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The values of the given places, distinct and ascending."""
    starts, values = held
    sizes = starts[at + 1] - starts[at]
    return np.unique(values[np.repeat(starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())])


class Benchmark:
    """Items with their shingles, fingerprints and block index."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS, threshold: float = SIMILARITY):
        self.threshold, self.words, self.hashes = threshold, words, WordHashes()
        self.items = []
        for item_id, text in items:
            w = self.hashes.of(normal_words((text or "").encode()))
            if len(w):
                self.items.append((item_id, min(words, len(w)), shingle_hashes(w, words)))
        #: By (words of a shingle, shingles): items of one window size.
        self.kinds: dict[tuple[int, int], list[int]] = {}
        for k, (_, size, h) in enumerate(self.items):
            self.kinds.setdefault((size, len(h)), []).append(k)
        self.known = {size: np.unique(np.concatenate([h for _, s, h in self.items if s == size])) for size in {s for _, s, _ in self.items}}
        #: By words of a shingle, of each known shingle: the lengths of the items that have it, and the items that cannot reach the threshold without one of their such shingles.
        self.owners: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.rare: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, known in self.known.items():
            own = [k for k, item in enumerate(self.items) if item[1] == size]
            places = [np.searchsorted(known, self.items[k][2]) for k in own]
            distinct = [np.unique(p) for p in places]
            lengths = np.repeat([len(p) for p in places], [len(d) for d in distinct])
            self.owners[size] = by_place(np.stack([np.concatenate(distinct), lengths]), len(known))
            spread = np.bincount(np.concatenate(distinct), minlength=len(known))
            needed = []
            for p in places:
                order = np.lexsort((p, spread[p]))
                # a match shares at least threshold * n positions of the item, so of any n - threshold * n + 1 one at least
                needed.append(np.unique(p[order[: len(p) - int(np.ceil(threshold * len(p) - 1e-9)) + 1]]))
            self.rare[size] = by_place(np.stack([np.concatenate(needed), np.repeat(own, [len(x) for x in needed])]), len(known))
        self.prints = np.array([simhash(h) for _, _, h in self.items], np.uint64)
        self.index = []
        for b in range(BLOCKS):
            value = (self.prints >> np.uint64(BLOCK_BITS * b)).astype(np.int64) & 0xFFFF
            order = np.argsort(value, kind="stable")
            self.index.append((order, np.searchsorted(value[order], np.arange(65537))))

    def retrieve(self, fingerprint: int) -> np.ndarray:
        """Items whose fingerprints differ in at most RADIUS bits."""
        found = []
        for b, (order, starts) in enumerate(self.index):
            values = (fingerprint >> (BLOCK_BITS * b) & 0xFFFF) ^ NEAR
            low, high = starts[values], starts[values + 1]
            found += [order[x:y] for x, y in zip(low[low < high].tolist(), high[low < high].tolist())]
        near = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return near[np.bitwise_count(self.prints[near] ^ np.uint64(fingerprint)) <= RADIUS]

    def matches(self, data: bytes) -> list[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity) of the best window for each matched item."""
        w = self.hashes.of(normal_words(data))
        best: dict[int, tuple[float, int, int]] = {}
        for size, known in self.known.items():
            if len(w) < size:
                continue
            h = shingle_hashes(w, size)
            at, which = positions_of(known, h)
            if not len(at):
                continue
            hits = np.zeros(len(h) + 1, np.int64)
            hits[at + 1] = 1
            hits = np.cumsum(hits)
            for n in values_at(self.owners[size], np.unique(which)).tolist():
                m = min(n, len(h))
                least = self.threshold / (1 + self.threshold) * (n + m) - 1e-9
                for start in np.flatnonzero(hits[m:] - hits[:-m] >= least).tolist():
                    window = h[start : start + m]
                    low, high = np.searchsorted(at, (start, start + m))
                    near = np.union1d(self.retrieve(simhash(window)), values_at(self.rare[size], np.unique(which[low:high])))
                    for k in near.tolist():
                        if self.items[k][1] == size and len(self.items[k][2]) == n:
                            score = weighted_similarity(window, self.items[k][2])
                            if score >= self.threshold and (k not in best or score > best[k][0]):
                                best[k] = (score, start, m + size - 1)
        return [(self.items[k][0], start, words, score) for k, (score, start, words) in sorted(best.items())]


_BUILT: dict[tuple[str, float], Benchmark] = {}


def built(part: tuple[str, list[tuple[int, str]]], threshold: float) -> Benchmark:
    """The index of a broadcast part (its name, its items), made once for each Python worker; the last one is remembered."""
    key = part[0], threshold
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Benchmark(part[1], threshold=threshold)
    return _BUILT[key]


def benchmark_parts(benchmark: DataFrame, part_words: int = PART_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of bounded size."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text") / 2), F.lit(0.0))).first()[0]  # a word has two characters at least
    parts = max(1, -(-int(total) // part_words))
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, part_words: int = PART_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): every document and item that match, with the best window."""
    spark, doc_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id long, first_word long, n_words long, similarity double"
    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    out = None
    for items in benchmark_parts(benchmark, part_words):
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, items))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bench = built(held.value, threshold)
            for batch in slices(batches):
                found = [(i, *m) for i, data in enumerate(bytes_of(batch)) for m in bench.matches(data)]
                ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                rest = [pa.array([f[k + 1] for f in found], t) for k, t in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        part = map_texts(docs.select("doc_id", "text"), run, schema)
        out = part if out is None else out.union(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, part_words: int = PART_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found. The test runs where the row lies: no join.
    Columns may have any names."""
    spark, names, docs = docs.sparkSession, docs.columns, positional(docs)
    for items in benchmark_parts(benchmark, part_words):
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, items))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bench = built(held.value, threshold)
            for batch in slices(batches):
                yield batch.filter(pa.array([not bench.matches(x) for x in bytes_of(batch)], pa.bool_()))

        docs = map_texts(docs, run, docs.schema)
    return docs.toDF(*names)
