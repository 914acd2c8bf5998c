"""WARC payloads as chunk rows: record identifier and chunk number.

A payload of any size becomes rows of at most chunk_bytes, each with its place, the SHA-256 of the payload up to
and with that chunk (one digest carried from chunk to chunk, never begun anew) and whether it is the last, so that no row and no buffer
has to hold a whole record and a reader can verify as far as it has come. The file reader streams: it
inflates, frames and emits in blocks of chunk_bytes, holding one block at a time.

Defined results: a record with an empty payload has one chunk of length 0; a page with a null html gives none; a record without an ID gets
one from its file and number; repeated records repeat with equal IDs; a truncated last record is emitted with complete false on its last chunk. A length that
is no number, or below 0, gives one empty chunk with complete false, and reading goes on at the next line that begins a record; none at all is 0. Of a header
line above LINE_BYTES the rest is passed over. Zero bytes between compressed members are skipped; at bytes that are no member, or a broken one, the file ends.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 16
SCHEMA = "record_id string, chunk_no int, chunk_offset bigint, chunk_length int, payload binary, digest string, is_last boolean"
#: A batch of chunk rows is handed on at so many payload bytes.
BATCH_BYTES = 8 << 20
#: A header line's bytes, at most; what is longer is no header that WARC knows.
LINE_BYTES = 1 << 20


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], payload: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[payload])
        if size >= BATCH_BYTES or len(held) >= 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def page_chunks(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """page_id, url and SCHEMA: the html of each page as the payload of a resource record.

    The record's ID is a UUID made from the digest of its page_id and url. Only page_id, url and html are read.
    """
    given = pages.where("html IS NOT NULL").select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                ids, urls, texts = batch.column("page_id"), batch.column("url"), batch.column("html").cast(pa.large_binary())
                for i in range(batch.num_rows):
                    page, url = ids[i].as_py(), urls[i].as_py()
                    u = hashlib.sha256(f"{'' if page is None else page} {url or ''}".encode()).hexdigest()
                    record = f"<urn:uuid:{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:32]}>"
                    view = memoryview(texts[i].as_buffer())  # no copy of the page
                    digest = hashlib.sha256()
                    n = len(view)
                    for k, start in enumerate(range(0, max(n, 1), chunk_bytes)):
                        part = view[start : start + chunk_bytes]
                        digest.update(part)
                        yield page, url, record, k, start, len(part), part, digest.copy().hexdigest(), start + chunk_bytes >= n

        types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.bool_()]
        names = ["page_id", "url", "record_id", "chunk_no", "chunk_offset", "chunk_length", "payload", "digest", "is_last"]
        for b in _batches(rows(), names, types, 6):
            yield b

    return given.mapInArrow(run, "page_id bigint, url string, " + SCHEMA)


class _Stream:
    """Bytes of a file, inflated member by member if it is compressed; at most one block is held."""

    def __init__(self, raw: BinaryIO, block: int):
        self.raw, self.block, self.left, self.ended = raw, block, b"", False
        head = raw.read(2)
        self.packed, self.pending = head == b"\x1f\x8b", head
        self.inflate = zlib.decompressobj(31) if self.packed else None

    def _more(self) -> bool:
        if self.ended:
            return False
        if not self.packed:
            data, self.pending = self.pending or self.raw.read(self.block), b""
            self.ended = not data
            self.left += data
            return bool(data)
        while True:
            data = self.pending or self.raw.read(self.block)
            self.pending = b""
            if not data:
                self.ended = True
                return False
            if self.inflate.eof:
                data = data.lstrip(b"\0")  # padding between members
                if not data:
                    continue
                self.inflate = zlib.decompressobj(31)
            try:
                out = self.inflate.decompress(data, self.block)
            except zlib.error:  # no member, or a broken one: what was inflated stands
                self.ended = True
                return False
            self.pending = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                self.left += out
                return True

    def line(self) -> bytes | None:
        """The next line, of a line of more than LINE_BYTES its first LINE_BYTES; the rest of that is passed over, block by block."""
        head, skipped = b"", False
        while (at := self.left.find(b"\n")) < 0:
            if len(self.left) >= LINE_BYTES or skipped:
                head, skipped, self.left = head or self.left[:LINE_BYTES], True, b""
            if not self._more():
                out, self.left = head or self.left, b""
                return out or None
        out, self.left = head or self.left[: at + 1], self.left[at + 1 :]
        return out[:LINE_BYTES]

    def some(self, most: int) -> bytes:
        """Exactly most bytes, fewer only at the end."""
        while len(self.left) < most and self._more():
            pass
        out, self.left = self.left[:most], self.left[most:]
        return out


def records(raw: BinaryIO, name: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(record_id, type, target, chunk_no, offset, length, payload, digest, is_last, complete) of each chunk of a WARC file."""
    stream, number = _Stream(raw, chunk_bytes), 0
    while True:
        line = stream.line()
        while line is not None and not line.startswith(b"WARC/"):
            line = stream.line()
        if line is None:
            return
        head: dict[str, str] = {}
        while (line := stream.line()) is not None and line.strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        given = (head.get("content-length") or "0").strip()
        known = given.isascii() and given.isdigit()
        length = int(given) if known else 0
        record = head.get("warc-record-id") or f"<{name}#{number}>"
        number += 1
        digest, done, k = hashlib.sha256(), 0, 0
        while True:
            part = stream.some(min(chunk_bytes, length - done))
            short = len(part) < min(chunk_bytes, length - done)
            digest.update(part)
            last = short or done + len(part) >= length
            yield record, head.get("warc-type"), head.get("warc-target-uri"), k, done, len(part), part, digest.copy().hexdigest(), last, known and not short
            done, k = done + len(part), k + 1
            if last:
                break


def read_warc(spark: SparkSession, paths: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """file, warc_type, target_uri, SCHEMA and complete for the .warc and .warc.gz files, a task for each file; none is held whole.

    paths: URIs or local paths as pyarrow.fs opens them.
    """
    files = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, len(paths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path in batch.column("file").to_pylist():
                    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                    with system.open_input_stream(inner, compression=None, buffer_size=chunk_bytes) as raw:
                        for r in records(raw, path, chunk_bytes):
                            yield path, r[1], r[2], r[0], *r[3:]

        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.bool_(), pa.bool_()]
        names = ["file", "warc_type", "target_uri", "record_id", "chunk_no", "chunk_offset", "chunk_length", "payload", "digest", "is_last", "complete"]
        yield from _batches(rows(), names, types, 7)

    return files.mapInArrow(run, "file string, warc_type string, target_uri string, " + SCHEMA + ", complete boolean")


def broken_records(chunks: DataFrame) -> DataFrame:
    """record_id, n_chunks, n_bytes of the records whose chunks aren't a whole: one is missing, repeated or out of place, or there is no end."""
    g = chunks.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("chunk_no").alias("_d"), F.max("chunk_no").alias("_m"), F.sum("chunk_length").alias("n_bytes"),
        F.max(F.when(F.col("is_last"), F.col("chunk_offset") + F.col("chunk_length"))).alias("_e"),
    )
    whole = (F.col("n_chunks") == F.col("_d")) & (F.col("_m") + 1 == F.col("n_chunks")) & (F.col("_e") == F.col("n_bytes"))
    return g.where(~F.coalesce(whole, F.lit(False))).select("record_id", "n_chunks", "n_bytes")


ORACLE = f"""
WITH p AS (SELECT page_id, url, hex(encode(html)) AS h, sha256(coalesce(CAST(page_id AS VARCHAR), '') || ' ' || coalesce(url, '')) AS u FROM pages WHERE html IS NOT NULL),
c AS (SELECT *, CAST(length(h) // 2 AS BIGINT) AS n, unnest(generate_series(0, greatest(CAST(length(h) // 2 AS BIGINT) - 1, 0) // {CHUNK_BYTES})) AS k FROM p)
SELECT page_id, url, '<urn:uuid:' || u[1:8] || '-' || u[9:12] || '-' || u[13:16] || '-' || u[17:20] || '-' || u[21:32] || '>' AS record_id,
       CAST(k AS INTEGER) AS chunk_no, CAST(k * {CHUNK_BYTES} AS BIGINT) AS chunk_offset, CAST(least({CHUNK_BYTES}, n - k * {CHUNK_BYTES}) AS INTEGER) AS chunk_length,
       unhex(substr(h, CAST(2 * k * {CHUNK_BYTES} + 1 AS BIGINT), 2 * {CHUNK_BYTES})) AS payload,
       sha256(unhex(substr(h, 1, CAST(2 * least(n, (k + 1) * {CHUNK_BYTES}) AS BIGINT)))) AS digest, (k + 1) * {CHUNK_BYTES} >= n AS is_last
FROM c
"""
