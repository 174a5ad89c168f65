"""Operator 5: BPE encoding and decoding.

Method: a segment tree over the ranks of adjacent pairs. A leaf holds ``rank * width + position``, so the
root is the lowest rank and among equals the leftmost pair; a merge changes three leaves and their paths to the root, and
the work ends when no leaf holds a pair of the merge list. Short pieces are worked on side by side, the trees of a batch
as rows of one matrix; long pieces have a tree of their own, so that a piece of n symbols costs O(n log n).

Every distinct piece of a batch is encoded once, and the last pieces are remembered (bounded).

Cases: a null or empty text has no ids, and the hash of the empty string twice; repeated rows give repeated
results, rows that repeat a doc_id each its own; nulls of doc_id are kept; other columns are ignored; an empty table gives an empty
result. Texts and pieces of any length work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordCache, map_texts, slices, texts_of
from .wordpieces import PieceSplitter, tokenizer_text

#: Widths of the matrices; longer pieces are encoded one by one.
WIDTHS = (4, 8, 16, 32, 64)
ROWS = 8192
NONE = np.int64(1) << 60


class Merges:
    """Ranks of pairs of ids: one sorted array of keys, searched for many pairs at once."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        last = {k: rank for rank, k in enumerate(keys.tolist())}  # of a pair listed twice the later rank holds
        self.rank_of = last
        self.keys = np.array(sorted(last), np.int64)
        self.ranks = np.array([last[k] for k in self.keys.tolist()], np.int64)
        self.end = end

    def ranks_for(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge_rows(symbols: np.ndarray, counts: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merge every row of ``symbols`` (n, width), of which the first ``counts`` hold; returns ids and which are left."""
    n, width = symbols.shape
    rows = np.arange(n)
    place = np.arange(width)
    alive = place < counts[:, None]
    after = np.where(place + 1 < counts[:, None], place + 1, width)
    before = np.broadcast_to(place - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), NONE)
    rank = merges.ranks_for(symbols[:, :-1], symbols[:, 1:])
    has = (rank >= 0) & alive[:, 1:]
    tree[:, width : 2 * width - 1] = np.where(has, rank * width + place[:-1], NONE)
    for at in range(width - 1, 0, -1):
        tree[:, at] = np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1])
    levels = width.bit_length() - 1

    def put(r: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        at = at + width
        tree[r, at] = value
        for _ in range(levels):
            at = at >> 1
            tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

    live = rows[tree[:, 1] < NONE]
    while len(live):
        root = tree[live, 1]
        at, new = root % width, merges.merged[root // width]
        gone = after[live, at]
        nxt = after[live, gone]
        symbols[live, at] = new
        alive[live, gone] = False
        after[live, at] = nxt
        put(live, gone, np.full(len(live), NONE))
        inside = nxt < width
        right = np.full(len(live), np.int64(-1))
        r, a = live[inside], at[inside]
        before[r, nxt[inside]] = a
        right[inside] = merges.ranks_for(new[inside], symbols[r, nxt[inside]])
        put(live, at, np.where(right >= 0, right * width + at, NONE))
        prev = before[live, at]
        inside = prev >= 0
        r, p = live[inside], prev[inside]
        left = merges.ranks_for(symbols[r, p], new[inside])
        put(r, p, np.where(left >= 0, left * width + p, NONE))
        live = live[tree[live, 1] < NONE]
    return symbols, alive


def merge_long(symbols: list[int], merges: Merges) -> list[int]:
    """The same for one long piece."""
    n, size, rank_of, merged = len(symbols), merges.size, merges.rank_of, merges.merged
    width = 1 << (n - 1).bit_length()
    none = int(NONE)
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = rank_of.get(symbols[i] * size + symbols[i + 1])
        if rank is not None:
            tree[width + i] = rank * width + i
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def put(i: int, j: int) -> None:
        rank = rank_of.get(symbols[i] * size + symbols[j]) if j < n else None
        set_leaf(i, none if rank is None else rank * width + i)

    def set_leaf(i: int, value: int) -> None:
        at = width + i
        tree[at] = value
        while at > 1:
            at >>= 1
            value = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == value:
                break
            tree[at] = value

    while (root := tree[1]) < none:
        rank, i = divmod(root, width)
        gone = after[i]
        symbols[i], alive[gone] = int(merged[rank]), False
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        set_leaf(gone, none)
        put(i, after[i])
        if before[i] >= 0:
            put(before[i], i)
    return [s for s, a in zip(symbols, alive) if a]


class Encoder:
    def __init__(self, text: str):
        self.splitter = PieceSplitter(text)
        spec = self.splitter.spec
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or spec["decoder"]:
            raise ValueError("only byte-level word BPE without a decoder is supported")
        vocab = model["vocab"]
        self.merges = Merges(spec)
        alphabet = self.splitter.alphabet
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.final = np.array([vocab[c + self.merges.end] for c in alphabet], np.int64)
        self.names = [""] * (max([*vocab.values(), *self.splitter.specials.values()]) + 1)
        for text, i in [*vocab.items(), *self.splitter.specials.items()]:
            self.names[i] = text
        self.numbers = list(range(len(self.names)))  # one object for each id, shared by all that is remembered
        self.cache = WordCache(self.encode_pieces)

    def encode_pieces(self, pieces: list[str]) -> list:
        out: list = [None] * len(pieces)
        raw = [p.encode(errors="surrogateescape") for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for i, p in enumerate(pieces):
            if p in self.splitter.specials:
                out[i], sizes[i] = [self.splitter.specials[p]], 0
        low = 0
        for width in WIDTHS:
            chosen = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for k in range(0, len(chosen), ROWS):
                part = chosen[k : k + ROWS]
                for i, ids in zip(part.tolist(), self._matrix([raw[i] for i in part.tolist()], sizes[part], width)):
                    out[i] = tuple(map(self.numbers.__getitem__, ids))  # the garbage collector does not follow tuples of numbers
        for i in np.flatnonzero(sizes > low).tolist():
            symbols = self.inner[np.frombuffer(raw[i], np.uint8)]
            symbols[-1] = self.final[raw[i][-1]]
            out[i] = tuple(merge_long(symbols.tolist(), self.merges))
        return out

    def _matrix(self, raw: list[bytes], sizes: np.ndarray, width: int) -> Iterator[list[int]]:
        data = np.frombuffer(b"".join(raw), np.uint8)
        held = np.arange(width) < sizes[:, None]
        symbols = np.zeros(held.shape, np.int64)
        symbols[held] = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[np.arange(len(raw)), sizes - 1] = self.final[data[ends]]
        symbols, alive = merge_rows(symbols, sizes, self.merges)
        flat = symbols[alive].tolist()
        ends = np.cumsum(alive.sum(1)).tolist()
        return (flat[a:b] for a, b in zip([0, *ends], ends))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        pieces = [self.splitter.split(t) for t in texts]
        self.cache.ensure(set().union(*pieces))
        get = self.cache.__getitem__
        for p in pieces:
            ids: list[int] = []
            for piece in map(get, p):
                ids += piece
            yield ids

    def decode(self, ids: list[int]) -> str:
        """What a tokenizer file without a decoder gives: the tokens' own strings, joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(text: str) -> Encoder:
    """The encoder of a tokenizer file's text, made once for each Python worker."""
    return Encoder(text)


def encode_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(held.value)
        for batch in slices(batches):
            ids = list(own.encode(texts_of(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_texts(docs.select("doc_id", "text"), encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    held = encoded.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(held.value)
        for batch in slices(batches):
            texts = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_texts(encoded.select("doc_id", "ids"), decode, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode every whole text; digests of both, computed where the row lies."""
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(held.value)
        decimal = [str(i) for i in range(len(own.names))]
        for batch in slices(batches):
            n, ids_hash, text_hash = [], [], []
            for ids in own.encode(texts_of(batch)):
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
