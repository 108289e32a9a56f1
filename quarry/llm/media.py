"""Media columns: content-addressed payloads in tar shards.

A payload is stored as 8-bit samples of a grey PNG image, 64 samples wide,
named by the digest of its stored form.  Tasks stream their media into tar
shards of their own in a shared folder; the rows carry digest, shard, offset
and length only.  Width, height and depth are filled from the first bytes of
each member by range reads; features are computed from what is read back.

A digest is stored at most once in a shard.  The manifest keeps one place for
each digest, so a medium that many rows share is read once.  Shards of a task
attempt that failed are never named in the manifest.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, text_bytes, written

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk of a PNG file: all that a header read fetches.
HEADER_BYTES = 33
SHARD_BYTES = 256 << 20


def padded(data: bytes) -> bytes:
    """``data`` with bytes 0 appended up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.pad(rows, ((0, 0), (1, 0)))  # filter type 0 before each line
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(start: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first ``HEADER_BYTES`` bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    return struct.unpack(">IIB", start[16:25])


def from_png(media: bytes) -> bytes:
    """The samples of a grey 8-bit image as ``to_png`` writes it."""
    width, height, depth = png_header(media)
    at, packed = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if depth != 8 or lines[:, 0].any():
        raise ValueError("unexpected image form")
    return lines[:, 1:].tobytes()


def describe(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and which columns are brighter than the mean."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    entropy = -float((share[share > 0] * np.log2(share[share > 0])).sum()) + 0.0
    columns = samples.reshape(-1, WIDTH).sum(axis=0, dtype=np.int64)
    bright = np.packbits(columns * WIDTH > columns.sum()).tobytes().hex()
    return f"mean={samples.mean():.4f};std={samples.std():.4f};entropy={entropy:.4f};bright={bright}"


class _Shard:
    """A tar file that grows until it is full; members are written as they come."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.tar"
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.size, self.members = system.open_output_stream(path), 0, {}

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if name not in self.members:
            info = tarfile.TarInfo(f"{name}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + bytes(-len(data) % 512))
            self.members[name] = self.size + len(head)
            self.size += len(head) + len(data) + -len(data) % 512
        return self.path, self.members[name], len(data)

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def store(docs: DataFrame, text: str = "text", id_column: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Write every payload to a shard; (doc_id, n_bytes, digest, shard, offset, length), a row for each of ``docs``.

    Null texts count as empty.  ``folder`` must be shared by all executors; by
    default it is a new one under spark.checkpoint.dir.  The result is written
    once, so that no shard is made again when it is read twice.
    """
    folder = folder or scratch(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "digest": [], "shard": [], "offset": [], "length": []}
            for data in text_bytes(batch["_text"]):
                if shard is None or shard.size >= SHARD_BYTES:
                    if shard:
                        shard.close()
                    shard = _Shard(folder)
                media = to_png(padded(data))
                digest = hashlib.sha256(media).hexdigest()
                for column, value in zip(out.values(), (len(data), digest, *shard.add(digest, media)), strict=True):
                    column.append(value)
            yield pa.record_batch({"doc_id": batch["_id"], **{c: pa.array(v) for c, v in out.items()}}) if out["digest"] else pa.record_batch({"doc_id": batch["_id"], **{c: pa.array([], pa.string() if c in ("digest", "shard") else pa.int64()) for c in out}})
        if shard:
            shard.close()

    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text"))
    return written(rows.mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"), "manifest")


def entries(manifest: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): one place for each digest, ordered for sequential reads."""
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    places = manifest.groupBy("digest").agg(place).select("digest", "place.*")
    return places.repartitionByRange(F.col("shard"), F.col("offset")).sortWithinPartitions("shard", "offset")


def _read(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[tuple[pa.RecordBatch, Iterator[bytes]]]:
    """Each batch and the (first ``limit``) bytes of its members, by range reads."""
    system = file = opened = None

    def members(batch: pa.RecordBatch) -> Iterator[bytes]:
        nonlocal system, file, opened
        for shard, offset, length in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True):
            if shard != opened:
                if file:
                    file.close()
                system, path = fs.FileSystem.from_uri(shard)
                file, opened = system.open_input_file(path), shard
            yield file.read_at(min(length, limit or length), offset)

    for batch in batches:
        if batch.num_rows:
            yield batch, members(batch)
    if file:
        file.close()


def fill_metadata(places: DataFrame) -> DataFrame:
    """Adds width, height and bit_depth, from the first bytes of each member alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _read(batches, HEADER_BYTES):
            width, height, depth = zip(*map(png_header, starts), strict=True)
            yield pa.record_batch({**dict(zip(batch.schema.names, batch.columns, strict=True)), "width": pa.array(width, pa.int64()), "height": pa.array(height, pa.int64()), "bit_depth": pa.array(depth, pa.int32())})

    return places.mapInArrow(run, "digest string, shard string, offset long, length long, width long, height long, bit_depth int")


def fill_features(places: DataFrame) -> DataFrame:
    """Adds what is computed from the stored bytes as read back: payload_bytes, payload_sha256, tail_crc32, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, whole in _read(batches, None):
            out: dict[str, list] = {"payload_bytes": [], "payload_sha256": [], "tail_crc32": [], "media_sha256": [], "feature": []}
            for media in whole:
                payload = from_png(media)
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), hashlib.sha256(media).hexdigest(), describe(payload))
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            yield pa.record_batch({**dict(zip(batch.schema.names, batch.columns, strict=True)), **{c: pa.array(v) for c, v in out.items()}})

    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"
    return places.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema) + f", {added}")


def media_columns(docs: DataFrame, text: str = "text", id_column: str = "doc_id", folder: str | None = None) -> DataFrame:
    """A row for each of ``docs``: id, n_bytes, place in the shards, header metadata and features.

    Rows with equal texts share a digest, a place and all values; null ids and
    repeated rows are kept; an empty table gives an empty result; columns of
    ``docs`` besides id and text are not read.
    """
    manifest = store(docs, text, id_column, folder)
    filled = fill_features(fill_metadata(entries(manifest)))
    return manifest.select("doc_id", "n_bytes", "digest").join(filled, "digest")
