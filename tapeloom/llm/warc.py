"""Operator 10: WARC archives.

Method: a chunked record table. A payload is held as rows of record identifier and chunk number, each with at most ``CHUNK``
bytes. Spark cuts the cells of the pages table into chunk rows; the Python writer and reader pass chunks on one by one with a running digest, so neither
builds a whole record (the JVM holds the cell that it cuts). Every record is a gzip member of its own, as the format recommends.

Plan: (1) digest of every payload, by Spark's sha1 (a light table); (2) of equal digests and lengths the smallest page_id is kept as
response, with partial aggregation; (3) the pages that repeat another one's payload are a table of ids and digests, joined to the pages by id and payload;
(4) every partition writes one archive, whose name is of that attempt alone and is valid only if the committed manifest
holds it; (5) every archive is read back by a task.

Cases: a null html is an empty payload; payloads below ``least_bytes`` are never revisits; a page without page_id is always a
response and never referred to; rows that repeat a page_id and payload are responses alike if it is the smallest; rows that repeat a page_id with another payload
are judged by their own payload; a null
url is written as an empty target; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialise, new_dir, slices

CHUNK = 1 << 20
#: Revisits that may be broadcast (two ids, a length and 40 hex digits each); beyond it the join is shuffled.
BROADCAST_ROWS = 500_000
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column, by SQL functions: five hex digits give four letters."""
    hexed = F.sha1(payload)
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(0, 40, 5):
        v = F.conv(F.substring(hexed, k + 1, 5), 16, 10).cast("int")
        out += [F.substring(letters, F.shiftright(v, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*out)


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest), without the payloads."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("sha1"))


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, payload_bytes, refers_to) of the pages that repeat the payload of a page with a smaller page_id."""
    light = materialise(digests(pages).where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()), "warc-digests")
    firsts = light.groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return materialise(light.join(firsts, ["sha1", "payload_bytes"]).where("page_id <> refers_to").select("page_id", "sha1", "payload_bytes", "refers_to").distinct(), "warc-revisits")


def payload_chunks(payload: Column, size: int = CHUNK) -> Column:
    """The struct (number, data) of every chunk of a binary column, in order; an empty payload has one empty chunk."""
    last = F.greatest(F.ceil(F.octet_length(payload) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("number"), F.substring(payload, k * size + 1, F.lit(size)).alias("data")))


def bare(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record_urn(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record_head(page_id: int | None, url: str | None, payload_bytes: int, digest: bytes, refers_to: int | None) -> bytes:
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_urn(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", DATE), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"), ("Content-Type", "text/html; charset=utf-8"),
        ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(payload_bytes)),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_urn(refers_to)), ("X-Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return header([*fields, ("Content-Length", str(payload_bytes if refers_to is None else 0))])


def write_records(out, batches: Iterator[pa.RecordBatch]) -> int:
    """Write chunk rows (those of a record in order, one after another), a gzip member a record; return the records.

    The header's digest and length come with every row; the running digest of the chunks must end at that digest.
    """
    n, press, running = 0, None, None
    for batch in slices(batches, 64):
        page_id, url, size, digest, refers_to, number, last = (batch.column(c).to_pylist() for c in ("id", "url", "payload_bytes", "sha1", "refers_to", "number", "last"))
        data = batch.column("data")
        for k in range(batch.num_rows):
            if not number[k]:
                press, running = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                out.write(press.compress(record_head(page_id[k], url[k], size[k], bytes.fromhex(digest[k]), refers_to[k])))
            part = data[k].as_buffer()
            running.update(part)
            out.write(press.compress(part))
            if last[k]:
                if refers_to[k] is None and running.hexdigest() != digest[k]:
                    raise ValueError("the chunks of a record do not make up its payload")
                out.write(press.compress(b"\r\n\r\n") + press.flush())
                n += 1
    return n


class MemberStream:
    """Bytes of concatenated gzip members, unpacked as they are asked for."""

    def __init__(self, stream, size: int = 1 << 18):
        self.stream, self.size, self.raw, self.ready, self.press = stream, size, b"", bytearray(), zlib.decompressobj(31)

    def fill(self) -> bool:
        if self.press.eof:
            self.raw, self.press = self.press.unused_data, zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.stream.read(self.size)
            if not self.raw:
                return False
        got = self.press.decompress(self.raw, 4 * self.size)
        self.raw = self.press.unconsumed_tail
        self.ready += got
        return True

    def read(self, n: int) -> bytes:
        while len(self.ready) < n and self.fill():
            pass
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def head(self) -> bytes | None:
        """Up to the empty line, without it; None at the end."""
        while (at := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.fill():
                return None
        out = bytes(self.ready[:at])
        del self.ready[: at + 4]
        return out


def read_records(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of every record; the last one of a record has ``last``."""
    data = MemberStream(stream)
    number = 0
    while (head := data.head()) is not None:
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        left, kind = int(fields["Content-Length"]), fields["WARC-Type"]
        base = {"record": number, "page_id": int(fields["X-Page-ID"]) if fields.get("X-Page-ID") else None, "record_type": kind, "refers_to": int(fields["X-Refers-To-Page-ID"]) if kind == "revisit" else None}
        digest, done, k = hashlib.sha1(), 0, 0
        while True:
            part = data.read(min(chunk, left))
            if len(part) < min(chunk, left):
                raise ValueError("the archive ends within a record")
            digest.update(part)
            left, done = left - len(part), done + len(part)
            yield base | {"chunk": k, "data": part, "last": not left, "payload_bytes": done if kind == "response" else int(fields["X-Payload-Length"]), "payload_digest": bare(digest) if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha1:")}
            k += 1
            if not left:
                break
        if data.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        number += 1


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write the archives; return the manifest (name, records)."""
    again = revisits(pages, least_bytes)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").alias("id"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("sha1"))
    # rows that repeat a page_id need not repeat its payload
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    rows = rows.join(again.withColumnRenamed("page_id", "id"), ["id", "sha1", "payload_bytes"], "left")
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    rows = rows.select("id", "url", "payload_bytes", "sha1", "refers_to", F.explode(payload_chunks(body)).alias("c"))
    whole = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(F.lit(0))
    rows = rows.select("id", "url", "payload_bytes", "sha1", "refers_to", "c.*", ((F.col("c.number") + 1) * F.lit(CHUNK).cast("long") >= whole).alias("last"))
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        with fs.open_output_stream(f"{base}/{name}") as out:
            n = write_records(out, batches)
        yield pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([n], pa.int64())})

    return materialise(map_texts(rows, write, "name string, records long"), "warc-manifest")


def read_archives(spark, folder: str, names: list[str], with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives: a row for each chunk (``data`` left out on request)."""
    schema = "archive string, record long, page_id long, record_type string, refers_to long, chunk int, last boolean, payload_bytes long, payload_digest string" + ", data binary" * with_data
    if not names:
        return spark.createDataFrame([], schema)
    kinds = {"record": pa.int64(), "page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "chunk": pa.int32(), "last": pa.bool_(), "payload_bytes": pa.int64(), "payload_digest": pa.string()} | ({"data": pa.binary()} if with_data else {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                with fs.open_input_stream(f"{base}/{names[k]}") as stream:
                    rows, held = [], 0
                    for r in read_records(stream, chunk):
                        part = r["data"] if with_data else r.pop("data")[:0]  # bytes that are not asked for are not held
                        held += 256 + len(part)
                        rows.append(r)
                        if held >= 8 * CHUNK:
                            yield table(rows, names[k])
                            rows, held = [], 0
                    yield table(rows, names[k])

    def table(rows: list[dict], name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array([r[c] for r in rows], t) for c, t in kinds.items())], names=["archive", *kinds])

    return spark.range(0, len(names), 1, len(names)).mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the pages, read the archives back, and return a row for each record."""
    spark = pages.sparkSession
    folder = folder or new_dir(spark, "warc")
    names = [r.name for r in write_archives(pages, folder, least_bytes).select("name").collect()]  # a row for each archive
    chunks = read_archives(spark, folder, names, with_data=False)
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
