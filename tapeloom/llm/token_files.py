"""Operator 1: token ids in Huffman-coded binary files.

Method: canonical length-limited Huffman coding of ids from global counts; table-driven decoding in
independent blocks with bit-offset checkpoints.

Plan: (1) encode the texts, every partition by itself, and write (doc_id, ids) once; (2) count ids (each task sends at
most one row for each id of the vocabulary); (3) build the code from the counts on the driver (its size is
the vocabulary's); (4) range-partition the encoded rows by doc_id, sort them, and let each task
write one file; (5) read the files back, a task for each. Files of failed or repeated attempts have names
of their own, and only files that the committed manifest names are read.

File format, little-endian, one file for each range of doc_id::

    8 bytes  b"HUFTOK01"
    blocks   of at most BLOCK_TOKENS tokens, independent of one another:
             uint32 tokens, uint32 checkpoints, uint32 payload bytes,
             uint32 bit offset of every CHECK_TOKENS-th token, payload (most significant bit first)
    index    for each block: uint64 file offset; for each document: int64 doc_id, uint8 1 if it is null,
             uint32 tokens
    footer   uint32 blocks, uint32 documents, uint64 offset of the index, 8 bytes b"HUFTOK01"

``codebook.bin`` beside them: uint32 longest code, uint32 symbols, then uint32 id and uint8 length of each.

Cases: a null or empty text holds the end id alone; doc_id is a long, and a null one sorts first; rows that repeat a doc_id are
kept, in the order of the hashes of their ids; an empty table gives an empty result. Columns beyond doc_id and
text are ignored. Texts of any length are taken whole. At most 2**MAX_BITS different ids may occur (a code of MAX_BITS bits tells no more
apart; the vocabulary here has 49,408), more raise an error.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialise, new_dir, shuffle_partitions, slices, texts_of
from .wordpieces import PieceSplitter, tokenizer_text

MAGIC = b"HUFTOK01"
#: Longest code; 2**MAX_BITS is the size of the decoding table.
MAX_BITS = 16
BLOCK_TOKENS = 1 << 20
CHECK_TOKENS = 256
RUN_TOKENS = 1 << 14


# ---------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, longest: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths under the limit (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols do not fit codes of {longest} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    row, leaf_rows = weights, [np.ones(len(weights), bool)]
    for _ in range(longest - 1):
        even = len(row) // 2 * 2
        merged = np.concatenate([weights, row[0:even:2] + row[1:even:2]])
        by = np.argsort(merged, kind="stable")
        row = merged[by]
        leaf_rows.append(by < len(weights))
    need = 2 * len(weights) - 2
    for leaf in reversed(leaf_rows):
        leaves = int(leaf[:need].sum())
        lengths[order[:leaves]] += 1
        need = 2 * (need - leaves)
    return lengths


class Code:
    """Canonical codes for given lengths, with the table that decodes them."""

    def __init__(self, lengths: np.ndarray, bits: int = MAX_BITS):
        self.lengths, self.bits = lengths, bits
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        sizes = lengths[order].astype(np.int64)
        span = np.left_shift(1, bits - sizes)
        first = np.cumsum(span) - span
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = first >> (bits - sizes)
        self.table = np.zeros(1 << bits, np.uint32)
        filled = np.repeat((order.astype(np.uint32) << 5) | sizes.astype(np.uint32), span)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offsets of the checkpoints, and the payload. Works in short runs, whose arrays fit the CPU's cache."""
        out = np.zeros(len(ids) * self.bits // 64 + 2, np.uint64)
        checks, begin = [], 0
        for k in range(0, len(ids), RUN_TOKENS):
            run = ids[k : k + RUN_TOKENS]
            size = self.lengths[run].astype(np.int64)
            code = self.codes[run]
            end = np.cumsum(size) + begin
            at = end - size
            checks.append(at[::CHECK_TOKENS])
            word, free = at >> 6, 64 - ((at & 63) + size)  # free < 0: the code goes on in the next word
            part = np.where(free < 0, code >> np.maximum(-free, 0).astype(np.uint64), code << np.maximum(free, 0).astype(np.uint64))
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[heads]] |= np.bitwise_or.reduceat(part, heads)
            spill = np.flatnonzero(free < 0)
            out[word[spill] + 1] |= code[spill] << (64 + free[spill]).astype(np.uint64)
            begin = int(end[-1])
        return np.concatenate(checks).astype("<u4"), out.astype(">u8").tobytes()[: (begin + 7) // 8]

    def decode(self, tokens: int, checks: np.ndarray, payload: bytes) -> np.ndarray:
        """All runs between checkpoints at once, a token of each run at every step."""
        raw = np.frombuffer(payload + bytes(CHECK_TOKENS * self.bits // 8 + 8), np.uint8).astype(np.uint32)
        wide = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        at, steps = checks.astype(np.int64), min(CHECK_TOKENS, tokens)
        out = np.empty((steps, len(at)), np.uint32)
        shift, mask = 24 - self.bits, (1 << self.bits) - 1
        for k in range(steps):
            entry = self.table[(wide[at >> 3] >> (shift - (at & 7)).astype(np.uint32)) & mask]
            out[k] = entry >> 5
            at += entry & 31
        return out.T.ravel()[:tokens]


# ---------------------------------------------------------------- encoding of texts


class _PieceIds(dict):
    """Packed ids of each piece, by the library's model; emptied when full."""

    def __init__(self, splitter: PieceSplitter, size: int = 600_000):
        self.splitter, self.size, self.tokenize = splitter, size, splitter.library.model.tokenize
        self.kind = "H" if splitter.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"  # little-endian machines

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.size:
            self.clear()
        own = self.splitter.specials.get(piece)
        ids = [own] if own is not None else [t.id for t in self.tokenize(self.splitter.printable(piece))]
        value = self[piece] = array(self.kind, ids).tobytes()
        return value


@lru_cache(maxsize=2)
def _encoder(text: str) -> _PieceIds:
    return _PieceIds(PieceSplitter(text))


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, kind: str) -> DataFrame:
    """(doc_id, ids): the library's ids of every whole text and the end id, packed as ``kind``; ``tokenizer`` is the file's text."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], kind).tobytes()
    held = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _encoder(held.value)
        get, split = ids.__getitem__, ids.splitter.split
        for batch in slices(batches):
            out = [b"".join([*map(get, split(t)), end]) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return map_texts(docs.select("doc_id", "text"), encode, f"doc_id {doc_type}, ids binary")


def token_counts(encoded: DataFrame, vocabulary: int, kind: str) -> np.ndarray:
    """Occurrences of every id over all rows; tasks send sums, one row for each id at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in slices(batches):
            packed = b"".join(x for x in batch.column("ids").to_pylist() if x)
            total += np.bincount(np.frombuffer(packed, kind), minlength=vocabulary)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


# ---------------------------------------------------------------- files


def _write_part(rows: Iterator[tuple[int | None, np.ndarray]], code: Code, out) -> tuple[int, int]:
    """Write the documents to the stream; return how many documents and tokens."""
    out.write(MAGIC)
    at, offsets, docs, waiting, held, total = len(MAGIC), [], [], [], 0, 0

    def flush(all_of_it: bool) -> None:
        nonlocal at, waiting, held
        if not held:
            return
        ids = np.concatenate(waiting)
        full = len(ids) if all_of_it else len(ids) // BLOCK_TOKENS * BLOCK_TOKENS
        for k in range(0, full, BLOCK_TOKENS):
            block = ids[k : min(k + BLOCK_TOKENS, full)]
            checks, payload = code.encode(block)
            data = struct.pack("<III", len(block), len(checks), len(payload)) + checks.tobytes() + payload
            out.write(data)
            offsets.append(at)
            at += len(data)
        waiting, held = [ids[full:]], len(ids) - full

    for doc_id, ids in rows:
        docs.append((doc_id or 0, doc_id is None, len(ids)))
        waiting.append(ids)
        held, total = held + len(ids), total + len(ids)
        if held >= BLOCK_TOKENS:
            flush(False)
    flush(True)
    index = np.array(offsets, "<u8").tobytes() + np.array(docs, [("id", "<i8"), ("null", "u1"), ("n", "<u4")]).tobytes()
    out.write(index + struct.pack("<IIQ", len(offsets), len(docs), at) + MAGIC)
    return len(docs), total


def _read_part(file, code: Code) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """Documents of a part in order; a document that spans blocks comes as several arrays."""
    end = file.size()
    file.seek(end - 24)
    blocks, docs, at = struct.unpack("<IIQ", (tail := file.read(24))[:16])
    assert tail[16:] == MAGIC, "not a token file"
    file.seek(at)
    offsets = np.frombuffer(file.read(8 * blocks), "<u8")
    index = np.frombuffer(file.read(13 * docs), [("id", "<i8"), ("null", "u1"), ("n", "<u4")])

    def block(offset: int) -> np.ndarray:
        file.seek(offset)
        tokens, checks, size = struct.unpack("<III", file.read(12))
        return code.decode(tokens, np.frombuffer(file.read(4 * checks), "<u4"), file.read(size))

    left, k = np.empty(0, np.uint32), 0
    for doc_id, null, n in index.tolist():
        parts = []
        while n > len(left):
            parts.append(left)
            n -= len(left)
            left, k = block(int(offsets[k])), k + 1
        parts.append(left[:n])
        left = left[n:]
        yield (None if null else doc_id), parts


def write_token_files(encoded: DataFrame, folder: str, counts: np.ndarray, kind: str) -> list[dict]:
    """Write the rows in ascending doc_id order; return the manifest, a dict for each part in that order."""
    spark = encoded.sparkSession
    lengths = code_lengths(counts)
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    used = np.flatnonzero(lengths)
    with store.open_output_stream(f"{root}/codebook.bin") as f:
        f.write(struct.pack("<II", MAX_BITS, len(used)) + used.astype("<u4").tobytes() + lengths[used].tobytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = Code(lengths), TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.huftok"
        rows = ((d, np.frombuffer(x, kind)) for b in slices(batches) for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()))
        with fs.open_output_stream(f"{base}/{name}") as out:
            docs, tokens = _write_part(rows, code, out)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "docs": pa.array([docs], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    # the hash cuts the rows of a doc_id (or of none) that very many rows have
    keyed = encoded.withColumn("h", F.xxhash64("ids"))
    ranges = keyed.repartitionByRange(shuffle_partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids").select("doc_id", "ids")
    manifest = materialise(ranges.mapInArrow(write, "part int, name string, docs long, tokens long"), "token-manifest")
    return [r.asDict() for r in manifest.orderBy("part").collect()]  # a row for each part


def read_codebook(folder: str) -> np.ndarray:
    store, root = pafs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/codebook.bin") as f:
        data = f.read()
    _, n = struct.unpack("<II", data[:8])
    ids = np.frombuffer(data[8 : 8 + 4 * n], "<u4")
    lengths = np.zeros(int(ids.max()) + 1 if n else 1, np.uint8)
    lengths[ids] = np.frombuffer(data[8 + 4 * n :], np.uint8)
    return lengths


def read_token_files(spark, folder: str, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    names, before, at = [], [], 0
    for r in manifest:
        names.append(r["name"])
        before.append(at)
        at += r["tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not names:
        return spark.createDataFrame([], schema)
    lengths = read_codebook(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                start, rows = before[k], []
                with fs.open_input_file(f"{base}/{names[k]}") as file:
                    for doc_id, parts in _read_part(file, code):
                        crc = 0
                        for p in parts:
                            crc = zlib.crc32(p.astype("<u4", copy=False), crc)
                        n = sum(map(len, parts))
                        rows.append((doc_id, start, n, crc, *([np.concatenate(parts)] if with_ids else [])))
                        start += n
                        if len(rows) == 4096:
                            yield _batch(rows, with_ids)
                            rows = []
                if rows:
                    yield _batch(rows, with_ids)

    def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]]
        if with_ids:
            columns.append(pa.array([r[4] for r in rows], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return spark.range(0, len(names), 1, len(names)).mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode ``docs``, write the files, read them back; a row for each document."""
    spark, tokenizer = docs.sparkSession, tokenizer_text(tokenizer)
    spec = json.loads(tokenizer)
    vocabulary = max(end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])) + 1
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    encoded = materialise(encode_documents(docs, tokenizer, end_id, kind), "token-ids")
    folder = folder or new_dir(spark, "token-files")
    manifest = write_token_files(encoded, folder, token_counts(encoded, vocabulary, kind), kind)
    return read_token_files(spark, folder, manifest, with_ids)
