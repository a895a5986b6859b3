"""Media columns: payloads in tar shards, addressed by their content.

Payloads are members named by their digest, and the index has one place for each. Rows carry digest, shard, offset and length, so a
reader fetches the bytes it needs by range: the first 33 bytes of a member fill the columns that describe it, the
payload is read only where it is asked for. Members are 8-bit greyscale PNG images, which are lossless.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, written

WIDTH = 576
#: A shard is closed once it is so large; a larger member has a shard of its own.
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33
_SEND = 8 << 20


def payload(text: Column) -> Column:
    """The text as UTF-8, filled with bytes 255 up to a positive multiple of WIDTH; null counts as empty."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    fill = F.lit(WIDTH) - F.pmod(F.octet_length(raw), F.lit(WIDTH))
    fill = F.when((fill == WIDTH) & (F.octet_length(raw) > 0), 0).otherwise(fill)
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), fill)))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(data: bytes) -> bytes:
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # each row begins with its filter, none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bits, colour type) from a PNG's first HEADER_BYTES."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIBB", head[16:26])


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png wrote."""
    width, height, _, _ = png_header(data)
    at, parts = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


class Store:
    """Files of a folder that all executors share, by its URI; file: without a library, others by pyarrow."""

    def __init__(self, uri: str) -> None:
        where = urlparse(uri)
        self.fs = None
        self.root = where.path if where.scheme in ("", "file") else uri
        if where.scheme not in ("", "file"):
            from pyarrow.fs import FileSystem

            self.fs, self.root = FileSystem.from_uri(uri)

    def create(self, name: str):
        path = f"{self.root}/{name}"
        if self.fs is None:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            return open(path, "wb")
        self.fs.create_dir(os.path.dirname(path), recursive=True)
        return self.fs.open_output_stream(path)

    def open(self, name: str):
        path = f"{self.root}/{name}"
        return open(path, "rb") if self.fs is None else self.fs.open_input_file(path)

    def remove(self, name: str) -> None:
        with contextlib.suppress(OSError):
            os.remove(f"{self.root}/{name}") if self.fs is None else self.fs.delete_file(f"{self.root}/{name}")


def _shards(uri: str):
    """Writes payloads into tar shards; gives (digest, shard, offset, length) of each that this task hasn't met before.

    Shard names are new in every attempt: what a lost attempt wrote is in no index and is removed where it can be.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, names, out, name, at = Store(uri), [], None, "", 0
        seen: set[bytes] = set()
        try:
            for batch in batches:
                rows: list[tuple[str, str, int, int]] = []
                for x in batch.column("payload"):
                    raw = x.as_buffer()
                    key = hashlib.sha256(raw)
                    if key.digest() in seen:
                        continue
                    if len(seen) < 500_000:  # beyond, a copy may be stored again; the index still has one place for it
                        seen.add(key.digest())
                    data = to_png(raw)
                    if out is None or at + len(data) > SHARD_BYTES and at:
                        if out is not None:
                            out.write(b"\0" * 1024)
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.tar", 0
                        names.append(name)
                        out = store.create(name)
                    info = tarfile.TarInfo(f"{key.hexdigest()}.png")
                    info.size = len(data)
                    head = info.tobuf(format=tarfile.GNU_FORMAT)
                    out.write(head)
                    out.write(data)
                    out.write(b"\0" * (-len(data) % 512))
                    rows.append((key.hexdigest(), name, at + len(head), len(data)))
                    at += len(head) + len(data) + -len(data) % 512
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["digest", "shard", "offset", "length"])
            if out is not None:
                out.write(b"\0" * 1024)
                out.close()
        except BaseException:
            for x in names:
                store.remove(x)
            raise

    return run


def write_media(payloads: DataFrame, uri: str | None = None) -> tuple[DataFrame, str]:
    """(index, folder) for rows with a `payload` (binary, a multiple of WIDTH long): digest, shard, offset, length once a payload.

    Payloads go straight from the task that reads them into its shards, once a task; only digests and places are
    shuffled. Where tasks hold copies of one payload the index names one place, the others are left unread.
    """
    spark = payloads.sparkSession
    uri = uri or f"{scratch_dir(spark)}/media-{uuid.uuid4().hex}"
    members = written(payloads.select("payload").mapInArrow(_shards(uri), "digest string, shard string, offset long, length long"), "media-members")
    place = members.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place")).select("digest", "place.*")
    return written(place.repartition("shard").sortWithinPartitions("shard", "offset"), "media-index"), uri


def media_headers(index: DataFrame, uri: str) -> DataFrame:
    """The index with width, height, bits and colour, from a range read of each member's first HEADER_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, spans in _read(batches, uri, lambda offset, length: (offset, min(length, HEADER_BYTES))):
            found = [png_header(x) for x in spans]
            extra = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "width", "height", "bits", "colour"])

    return index.mapInArrow(run, "digest string, shard string, offset long, length long, width long, height long, bits long, colour long")


def media_payloads(index: DataFrame, uri: str) -> DataFrame:
    """(digest, image, payload) of each member, read back whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, spans in _read(batches, uri, lambda offset, length: (offset, length)):
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(spans, pa.binary()), pa.array(map(from_png, spans), pa.binary())], names=["digest", "image", "payload"])

    return index.select("digest", "shard", "offset", "length").mapInArrow(run, "digest string, image binary, payload binary")


def _read(batches: Iterator[pa.RecordBatch], uri: str, span) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    store, name, file = Store(uri), None, None
    try:
        for batch in batches:
            first, parts, held = 0, [], 0
            rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True)
            for k, (shard, offset, length) in enumerate(rows):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, store.open(shard)
                at, n = span(offset, length)
                file.seek(at)
                parts.append(file.read(n))
                held += n
                if held > _SEND // 4:
                    yield batch.slice(first, len(parts)), parts
                    first, parts, held = k + 1, [], 0
            if parts:
                yield batch.slice(first, len(parts)), parts
    finally:
        if file is not None:
            file.close()


def media_columns(docs: DataFrame, uri: str | None = None) -> DataFrame:
    """docs (doc_id, text) with the columns that describe each row's stored payload.

    Digests and sums are of bytes read back from the shards. A null text is an empty one; rows with equal texts
    share a member and have equal values; a null doc_id stays; an empty table gives no rows. More columns of
    docs are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("payload", payload(F.col("text")))
    index, uri = write_media(rows, uri)
    stored = media_payloads(index, uri).select(
        F.col("digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("image").cast("long").alias("media_bytes"),
        F.sha2("image", 256).alias("media_sha256"),
    )
    heads = media_headers(index, uri).select("digest", F.format_string("png %dx%d, %d bits, colour type %d", "width", "height", "bits", "colour").alias("feature"), "shard", "offset", "length")
    described = written(heads.join(stored, "digest"), "media-described")
    named = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("digest"))
    return named.join(described, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length"
    )


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_columns(docs).drop("digest", "shard", "offset", "length")
