"""Operator 12: passages that occur more than once, across documents or within one.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is WINDOW consecutive words of a text; it is repeated if its words also start anywhere else, in
another text, in a copy of this one, or at another word of it. Words of repeated windows are removed; windows are judged on the input.

Method: seed and extend. Seeds are runs of SEED words; of the seeds of each window the least by hash (the first of equals) is its anchor. Windows
of equal words have the same anchor at the same place, so repeated windows are found among texts that share an anchor, about 7 % of their words.

1. Each text yields its anchors once: the seed's hash, and the hash of its full extension, which are all words of the windows that it
   is the anchor of. Anchors are counted. One that occurs once goes. If all occurrences of one have the same extension, its windows are repeated
   from end to end, and nothing else is to be compared: this settles the inside of repeats and copies.
2. Other repeated anchors, those near the ends of repeats, are extended both ways word by word: of each window around one, the words to the left and to the right are hashed
   into one value, and equal values are counted. A window of a count above one is repeated.
3. Neighbouring windows join to maximal repeats, which are cut out of the texts.

An extension by values that are counted stands for one by pairs of texts: a passage that a million texts share is a million rows that are summed up
before they are shuffled, not their pairs. Texts move only where they have repeated anchors. Values are compared as 128 bits (two hashes of 64), the text
itself as 96 bits.

Cases: null and empty texts have no words; texts below WINDOW words keep all; copies of a text, by the same doc_id or another, lose all words if they have at least
WINDOW; a null doc_id is kept; columns beyond doc_id and text are ignored; an empty table gives an empty result; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, map_texts, materialise, slices
from .shingles import mix

#: Words of a window, and of a seed.
WINDOW, SEED = 35, 10
#: Texts that may be named by a broadcast (16 bytes each) to leave the others where they are; beyond it all are shuffled.
BROADCAST_TEXTS = 1_000_000
WORDS_AT_ONCE = 1 << 16
_FACTORS, _SIZES = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64), np.uint64(0x8CB92BA72F3D8DD7)


def hashes_of(words: list[bytes]) -> np.ndarray:
    """A hash for each word: the sum of a value for each of its bytes and their places, the blank behind it included."""
    out = [np.empty(0, np.uint64)]
    for a in range(0, len(words), WORDS_AT_ONCE):
        some = words[a : a + WORDS_AT_ONCE]
        sizes = np.fromiter(map(len, some), np.int64, len(some)) + 1
        starts = np.cumsum(sizes) - sizes
        own = np.frombuffer(b" ".join(some) + b" ", np.uint8).astype(np.uint64)
        place = (np.arange(len(own)) - np.repeat(starts, sizes)).astype(np.uint64)
        own += place << np.uint64(8)
        own *= _SIZES
        out.append(np.add.reduceat(mix(own), starts))
    return np.concatenate(out)


def join_hashes(a: np.ndarray, b: np.ndarray, size, lane: int) -> np.ndarray:
    """The hash of a stretch of ``size`` words, made of the hashes of two stretches that cover it."""
    return mix(a * _FACTORS[lane] + b + np.asarray(size, np.uint64) * _SIZES)


class Stretches:
    """Hashes of stretches of words, by those of all stretches of 2**k words."""

    def __init__(self, words: np.ndarray, lane: int):
        self.lane, self.powers = lane, [words]

    def of(self, first: np.ndarray | slice, size: int) -> np.ndarray:
        """Hashes of the stretches of ``size`` words from the words ``first`` (slice(None): from every word)."""
        power = size.bit_length() - 1
        while len(self.powers) <= power:
            last, half = self.powers[-1], 1 << (len(self.powers) - 1)
            self.powers.append(join_hashes(last[:-half], last[half:], 2 * half, self.lane))
        level, back = self.powers[power], size - (1 << power)
        if isinstance(first, slice):
            return join_hashes(level[: len(level) - back], level[back:], size, self.lane)
        return join_hashes(level[first], level[first + back], size, self.lane)


class Anchors:
    """The anchors of texts whose word hashes follow one another: text, place, first and last window, seed hash. Numbers of words are of all texts together;
    ``starts`` has the first word of each text."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, window: int, seed: int):
        self.window, self.words = window, Stretches(words, 1)
        self.starts = np.cumsum(sizes) - sizes
        inside = np.maximum(sizes - window + 1, 0)  # windows of each text
        self.text = self.place = self.first = self.last = self.seed = np.empty(0, np.int64)
        if not inside.any():
            return
        at = np.repeat(self.starts - (np.cumsum(inside) - inside), inside) + np.arange(inside.sum())
        seeds = Stretches(words, 0).of(slice(None), seed)
        chosen = at + np.lib.stride_tricks.sliding_window_view(seeds, window - seed + 1).argmin(axis=1)[at]
        new = np.flatnonzero(np.diff(chosen, prepend=-1))
        self.first, self.last, self.place = at[new], at[np.append(new[1:], len(at)) - 1], chosen[new]
        self.seed = seeds[self.place].view(np.int64)
        self.text = np.searchsorted(self.starts, self.first, "right") - 1  # empty texts before a text start where it does

    def extension(self) -> np.ndarray:
        """The hash of all words of each anchor's windows."""
        if not len(self.first):
            return self.first
        power = 1 << (self.window.bit_length() - 1)
        # stretches of a power of two at both ends and in the middle cover up to three times the power
        first, last = self.first, self.last + self.window - power
        ends = join_hashes(self.words.of(first, power), self.words.of(last, power), last - first, 1)
        return join_hashes(ends, self.words.of((first + last) // 2, power), self.place - first, 1).view(np.int64)

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first word, hash) of the windows of the anchors whose numbers are given."""
        if not len(of):
            return self.first[:0], self.first[:0], self.first[:0]
        sizes = self.last[of] - self.first[of] + 1
        anchor = np.repeat(of, sizes)
        at = self.first[anchor] + np.arange(len(anchor)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return anchor, at, self.words.of(at, self.window).view(np.int64)

    def lists(self, text: np.ndarray, fields: dict[str, np.ndarray]) -> pa.Array:
        """A list of structs for each text, of rows in the order of their texts."""
        cuts = np.append(0, np.cumsum(np.bincount(text, minlength=len(self.starts)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields)))


def text_key(text: str = "text") -> list:
    """Columns that stand for a text: its XXH64 (seed 42) and its CRC."""
    own = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(own).alias("key"), F.crc32(own.cast("binary")).alias("crc")]


def anchor_table(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(doc_id, key, crc, n_words, whole, anchors): anchors as (h, s), seed hash and extension hash; whole is the SHA-256 of all words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = bytes_of(batch)
            words = [data.split() for data in texts]
            own = Anchors(hashes_of(list(itertools.chain.from_iterable(words))), np.array([len(w) for w in words], np.int64), window, seed)
            columns = [
                pa.array(np.array([xxhash.xxh64_intdigest(data, 42) for data in texts], np.uint64).view(np.int64)),
                pa.array([zlib.crc32(data) for data in texts], pa.int64()),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string()),
                own.lists(own.text, {"h": own.seed, "s": own.extension()}),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "key", "crc", "n_words", "whole", "anchors"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, key long, crc long, n_words long, whole string, anchors array<struct<h:bigint,s:bigint>>")


def extended(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """(key, crc, spans, windows) of texts with their repeated anchors ``settled`` and ``mixed``: spans (first, last) of repeated windows, and
    windows (h, w, at) that are to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [data.split() for data in bytes_of(batch)]
            own = Anchors(hashes_of(list(itertools.chain.from_iterable(words))), np.array([len(w) for w in words], np.int64), window, seed)
            # what a seed is, it is in all texts
            settled, mixed = (np.flatnonzero(np.isin(own.seed, batch.column(c).flatten().to_numpy(zero_copy_only=False))) for c in ("settled", "mixed"))
            anchor, at, w = own.windows(mixed)
            start = own.starts[own.text]
            spans = own.lists(own.text[settled], {"first": (own.first - start)[settled], "last": (own.last - start)[settled]})
            windows = own.lists(own.text[anchor], {"h": own.seed[anchor], "w": w, "at": at - start[anchor]})
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("crc"), spans, windows], names=["key", "crc", "spans", "windows"])

    return map_texts(texts, run, "key long, crc long, spans array<struct<first:bigint,last:bigint>>, windows array<struct<h:bigint,w:bigint,at:bigint>>")


def named(docs: DataFrame, rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The texts that ``rows`` names by ``keys``, with the columns of rows. A text that is not named stays where it is, unless very many are."""
    texts = docs.select(*columns, F.coalesce("text", F.lit("")).alias("text"), *text_key())
    if rows.count() <= BROADCAST_TEXTS:
        texts = texts.join(F.broadcast(rows.select("key").distinct()), "key", "left_semi")
    return texts.join(rows, keys)


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(anchors, spans): the table of ``anchor_table`` and, for each text with repeated windows, (key, crc, spans): first words (first, last) of
    windows that are repeated; not in order, and they may touch or overlap."""
    table = materialise(anchor_table(docs, window, seed), "repeats-anchors")
    anchors = table.select("key", F.explode("anchors").alias("a")).select("key", "a.h", "a.s")
    counts = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).where("n > 1")
    counts = materialise(counts.select("h", (F.col("low") == F.col("high")).alias("settled")), "repeats-seeds")
    marks = anchors.select("key", "h").join(counts, "h").groupBy("key").agg(F.collect_set(F.when(F.col("settled"), F.col("h"))).alias("settled"), F.collect_set(F.when(~F.col("settled"), F.col("h"))).alias("mixed"))
    marks = materialise(marks, "repeats-marks")
    found = materialise(extended(named(docs, marks, ["key"], []).select("key", "crc", "text", "settled", "mixed"), window, seed), "repeats-windows")
    windows = found.select("key", "crc", F.explode("windows").alias("x")).select("key", "crc", "x.h", "x.w", "x.at")
    again = materialise(windows.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "w"), "repeats-again")
    spans = found.select("key", "crc", F.explode("spans").alias("x")).select("key", "crc", "x.first", "x.last")
    spans = spans.union(windows.join(again, ["h", "w"], "left_semi").select("key", "crc", "at", "at"))
    return table, materialise(spans.groupBy("key", "crc").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "repeats-spans")


def _cut(docs: DataFrame, spans: DataFrame, window: int, columns: list[str], schema: str, row) -> DataFrame:
    """Rows of ``row(words, keep)`` after the columns, for each text with repeated windows; keep marks the words that stay."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for own, data in zip(batch.column("spans"), bytes_of(batch)):
                words = data.split()
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, np.asarray(own.values.field("first")), 1)
                np.add.at(edges, np.asarray(own.values.field("last")) + window, -1)
                out.append(row(words, np.cumsum(edges[:-1]) == 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array([o[k] for o in out]) for k in range(len(names)))], names=[*columns, *names])

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in columns)
    return map_texts(named(docs, spans, ["key", "crc"], columns).select(*columns, "text", "spans"), run, kinds + schema)


def repeat_report(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, repeats) of every row: repeats are the maximal stretches (first_word, n_words) of removed words, and the
    digest is that of the kept words joined by one space."""
    table, spans = repeated_spans(docs, window, seed)

    def row(words: list[bytes], keep: np.ndarray) -> tuple:
        edges = np.flatnonzero(np.diff(~keep, prepend=False, append=False))
        stretches = [{"first_word": int(a), "n_words": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]
        kept = b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])
        return len(words), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), stretches

    cut = _cut(docs, spans, window, ["doc_id"], "n_words long, n_removed long, kept_sha256 string, repeats array<struct<first_word:bigint,n_words:bigint>>", row)
    whole = table.join(spans.select("key", "crc"), ["key", "crc"], "left_anti")
    return cut.unionByName(whole.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole").alias("kept_sha256"), F.array().cast(cut.schema["repeats"].dataType).alias("repeats")))


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, text) of every row, repeated words removed; a text without any is left as it is, in others words are joined by one space."""
    _, spans = repeated_spans(docs, window, seed)
    row = lambda words, keep: (b" ".join([words[i] for i in np.flatnonzero(keep).tolist()]).decode(),)
    cut = _cut(docs, spans, window, ["doc_id"], "text string", row)
    keyed = docs.select("doc_id", "text", *text_key()).join(spans.select("key", "crc"), ["key", "crc"], "left_anti")
    return cut.union(keyed.select("doc_id", "text"))
