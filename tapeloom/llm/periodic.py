"""Operator 11: runs of periodic words, and texts without their repetitions.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least max(LEAST, 2 * q) words that no neighbouring
word extends. Words are ``[^\\x20\\x09-\\x0D]+``.

Method: heavy/light lag counting. For each lag, the equal pairs of words at that distance are counted: frequent words by the exact autocorrelation of
their positions (FFT, all of them summed before one inverse transform, rounded to whole numbers), rare ones by the differences of their
positions. A run of period q has max(q, LEAST - q) pairs in a row at lag q, so only lags with as many get a scan for islands of
consecutive pairs. What a run explains at the multiples of its period is taken off their counts, so that a periodic text does not scan each multiple; a scan
first looks at every eighth part of the least island, as an island covers at least eight such spots in a row, so that all scans of a text of n
words cost O(n log n) unless they find something. Both only skip scans that would find nothing new.

A stretch found at several lags has the smallest of them as its period: by Fine and Wilf a stretch of two periods q and a smaller period p has
their common divisor as a period too, over the same words, and lags are scanned in ascending order.

Every text is worked on by itself where it lies; there is no shuffle. Memory is a few arrays of a text's words.

Cases: null and empty texts have no words and no runs; texts below LEAST words have none; a null doc_id is kept, its text unchanged by
``edited``; repeated rows give repeated results; columns beyond doc_id and text are ignored; an empty table gives an empty result; texts of any length are
taken whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bytes_of, map_texts, slices

#: The least words of a run.
LEAST = 12
#: Pairs of positions held at once.
PAIRS = 1 << 20


def lag_matches(ids: np.ndarray, most: int) -> np.ndarray:
    """For lags 0..most: the number of positions i with ids[i] == ids[i + lag] (exact; lag 0 is not counted)."""
    n = len(ids)
    counts = np.bincount(ids)
    size = 1 << (n + most - 1).bit_length()
    # a word of c positions costs about c**2 / 2 differences, or a transform of this size
    heavy = counts > max(48, math.isqrt(int(0.15 * size * size.bit_length())))
    out = np.zeros(most + 1, np.int64)
    if heavy.any():
        power = np.zeros(size // 2 + 1)
        for w in np.flatnonzero(heavy).tolist():
            spectrum = np.fft.rfft((ids == w).astype(np.float64), size)
            power += spectrum.real**2 + spectrum.imag**2
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    order = order[((counts > 1) & ~heavy)[ids[order]]]
    if len(order):
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        earlier = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))  # positions of the same word before each
        upto = np.cumsum(earlier)
        a = 0
        while a < len(order):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            times = earlier[a:b]
            later = np.repeat(np.arange(a, b), times)
            back = np.arange(len(later)) - np.repeat(np.cumsum(times) - times, times) + 1
            lags = order[later] - order[later - back]
            out += np.bincount(lags[lags <= most], minlength=most + 1)
            a = b
    out[0] = 0
    return out


def islands(ids: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, words) of the stretches of at least ``least`` positions in a row that equal the one ``lag`` later, with the words they reach."""
    step = least // 8
    if step > 1:
        gaps = np.flatnonzero(ids[: len(ids) - lag : step] != ids[lag::step])
        spots = (len(ids) - lag + step - 1) // step
        if np.diff(gaps, prepend=-1, append=spots).max() - 1 < least // step:
            return []
    gaps = np.concatenate(([-1], np.flatnonzero(ids[:-lag] != ids[lag:]), [len(ids) - lag]))
    found = np.flatnonzero(np.diff(gaps) > least)
    return [(int(gaps[k]) + 1, int(gaps[k + 1] - gaps[k]) - 1 + lag) for k in found.tolist()]


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of small whole numbers, by start, then period."""
    n = len(ids)
    if n < max(least, 2):
        return []
    lags = np.arange(n // 2 + 1)
    need = np.maximum(np.maximum(lags, least - lags), 1)
    left = lag_matches(ids, n // 2)
    found: dict[tuple[int, int], int] = {}
    for lag in (np.flatnonzero(left[1:] >= need[1:]) + 1).tolist():
        if left[lag] < need[lag]:
            continue
        for start, length in islands(ids, lag, int(need[lag])):
            if (start, length) not in found:
                found[start, length] = lag
                multiples = np.arange(2 * lag, length // 2 + 1, lag)
                left[multiples] -= length - multiples
    return sorted((start, length, period) for (start, length), period in found.items())


def numbered(words: list[bytes]) -> np.ndarray:
    """A small whole number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def edited(words: list[bytes], doc_id) -> list[bytes]:
    """A tenth of the documents, chosen by the CRC of the doc_id, get a periodic tail: every word from a on repeats those from a to a + p."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def run_table(docs: DataFrame, edit: bool = False, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs by start, then period, and its text without their repetitions, words joined
    by one space. ``edit`` plants periodic tails first (``edited``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, runs, texts = [], [], []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), bytes_of(batch)):
                words = data.split()
                words = edited(words, doc_id) if edit else words
                own = find_runs(numbered(words), least)
                sizes.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
                texts.append(b" ".join(collapsed(words, own)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return map_texts(docs.select("doc_id", "text"), run, schema)
