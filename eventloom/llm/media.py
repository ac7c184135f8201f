"""Media columns: content-addressed payloads in tar shards.

Each distinct payload is stored once under its SHA-256 as a PNG of 8-bit grey samples, 192 a row: payloads are told
apart by hash before any is written. Rows carry digest, shard, offset and length. Image columns come from range reads of the
header alone; samples are read back by range where they are needed, each stretch of a shard by a task of its own.

A shard is written by one task under a name of its own (partition, attempt and a random part). Rows name a shard only
once its task has ended well and their table is written, so what a lost or repeated task leaves behind is never read.
Shards lie in the folder that executors share, by any URI that Arrow's file systems open.
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
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded_batches, fresh_path

WIDTH = 192
PAD = b"\x20"
#: Bytes of a shard, about.
SHARD_BYTES = 256 << 20
#: Payloads of several rows whose table is broadcast.
COPIES = 2_000_000
#: Bytes of a shard that one task reads.
STRETCH = 16 << 20
#: PNG's signature, and the length of signature and header chunk.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
#: Level of deflate: beyond it, time grows faster than texts shrink.
LEVEL = 4


def padded(raw: bytes) -> bytes:
    """The bytes with blanks up to a positive multiple of the width."""
    return raw + PAD * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes) -> bytes:
    """A grey PNG, eight bits a sample, no filter. Equal payloads give equal files."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    held = np.zeros((len(rows), WIDTH + 1), np.uint8)
    held[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(held.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from a file's first HEADER_BYTES."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_image(stored: bytes) -> bytes:
    """The samples of a file that encode_image made; checks each chunk's CRC."""
    width, height, bits = read_header(stored[:HEADER_BYTES])
    at, data = 8, []
    while at < len(stored):
        (n,) = struct.unpack(">I", stored[at : at + 4])
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("broken chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width * bits // 8 + 1)
    return rows[:, 1:].tobytes()


def image_feature(payload: bytes) -> str:
    """Height, mean and spread of the samples, and a 64-bit average hash over an 8 x 8 grid of the image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.int64)
    n, total, square = rows.size, int(rows.sum()), int((rows * rows).sum())
    columns = np.add.reduceat(rows, np.arange(0, WIDTH, WIDTH // 8), axis=1)
    edges = np.arange(9) * len(rows) // 8
    sums = np.vstack([np.zeros((1, 8), np.int64), np.cumsum(columns, axis=0)])
    low, high = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
    cells = (sums[high] - sums[low]) / ((high - low)[:, None] * (WIDTH // 8))
    bits = (cells > total / n).ravel()
    return f"h={len(rows)};mean={total / n:.4f};var={square / n - (total / n) ** 2:.3f};hash={int(np.packbits(bits).view('>u8')[0]):016x}"


class Shards:
    """Tar files that one task appends to, each of about SHARD_BYTES."""

    def __init__(self, folder: str, part: str) -> None:
        self.fs, self.root = arrow_fs.FileSystem.from_uri(folder)
        self.folder, self.part, self.number = folder, part, 0
        self.out, self.name, self.at = None, "", 0

    def add(self, digest: bytes, stored: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.name, self.at = f"shard-{self.part}-{self.number:04d}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
            self.number += 1
        member = tarfile.TarInfo(f"{digest.hex()}.png")
        member.size = len(stored)
        head = member.tobuf(tarfile.PAX_FORMAT)
        self.out.write(head + stored + b"\0" * (-len(stored) % 512))
        place = (f"{self.folder}/{self.name}", self.at + len(head), len(stored))
        self.at += len(head) + len(stored) + -len(stored) % 512
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def payload_key(text: Column) -> list[Column]:
    """128 bits that stand for a text's payload, which the blanks at its end only change by its length."""
    held = F.coalesce(text.cast("string"), F.lit(""))
    bare, rows = F.rtrim(held), F.greatest(F.lit(1), F.ceil(F.octet_length(held) / WIDTH))
    return [F.xxhash64(bare, rows).alias("_k1"), F.xxhash64(F.lit(1), bare, rows).alias("_k2")]


def _writers(df: DataFrame, text: str, keep: str) -> DataFrame:
    """(_k1, _k2, _text): a row for each distinct payload, that of the smallest ``keep``; equal rows stay.

    Only what several rows have is looked up: that table is broadcast up to COPIES rows (24 bytes each), so that texts
    stay where they are; beyond, texts move once.
    """
    rows = df.select(F.col(keep).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), *payload_key(F.col(text)))
    copies = Written(rows.groupBy("_k1", "_k2").agg(F.min("_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1").select("_k1", "_k2", "_least", F.lit(True).alias("_copied")), "media-copies").df
    joined = rows.join(F.broadcast(copies) if copies.count() <= COPIES else copies, ["_k1", "_k2"], "left")
    return joined.where(F.col("_copied").isNull() | F.col("_id").eqNullSafe(F.col("_least"))).select("_k1", "_k2", "_text")


def store(df: DataFrame, folder: str | None = None, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """Writes every distinct payload; returns ``_k1``, ``_k2`` (the payload's key), ``digest``, ``shard``, ``offset``,
    ``length``, a row each.

    Null texts count as empty: 192 blanks. The table that is returned is written, so the shards are made once.
    """
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "media")
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shards = Shards(folder, f"{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex[:12]}")
        for batch in batches:
            made = []
            for t in batch.column(2).to_pylist():
                payload = padded(t.encode())
                digest = hashlib.sha256(payload).digest()
                made.append((digest.hex(), *shards.add(digest, encode_image(payload))))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = zip(*made, strict=True) if made else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["_k1", "_k2", "digest", "shard", "offset", "length"])
        shards.close()

    placed = Written(_writers(df, text, keep).mapInArrow(run, "_k1 long, _k2 long, digest string, shard string, offset long, length long"), "media-places").df
    # Equal rows of one id have each written their payload: one place counts.
    return placed.groupBy("_k1", "_k2").agg(F.min(F.struct("digest", "shard", "offset", "length")).alias("p")).select("_k1", "_k2", "p.*")


def _ranges(places: DataFrame, columns: str, work, header: bool = False) -> DataFrame:
    """Reads each place's bytes, or their header alone, stretch by stretch of a shard in order of offset."""
    stretch = F.floor(F.col("offset") / STRETCH).alias("_stretch")
    ordered = places.select("_k1", "_k2", "shard", "offset", "length", stretch).repartition("shard", "_stretch").sortWithinPartitions("shard", "offset").drop("_stretch")
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, held = "", None
        for batch in batches:
            made = []
            for k1, k2, shard, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard != opened:
                    if held is not None:
                        held.close()
                    system, path = arrow_fs.FileSystem.from_uri(shard)
                    opened, held = shard, system.open_input_file(path)
                made.append((k1, k2, *work(held.read_at(min(length, HEADER_BYTES) if header else length, offset))))
            yield pa.RecordBatch.from_pylist([dict(zip(["_k1", "_k2", *names], m, strict=True)) for m in made], schema=kinds)
        if held is not None:
            held.close()

    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    kinds = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), *[(c.split()[0], arrow[c.split()[1]]) for c in columns.split(", ")]])
    return ordered.mapInArrow(run, f"_k1 long, _k2 long, {columns}")


def headers(places: DataFrame) -> DataFrame:
    """``width``, ``height`` and ``bits`` of each digest, from header-only range reads."""
    return _ranges(places, "width int, height int, bits int", read_header, header=True)


def read_back(places: DataFrame) -> DataFrame:
    """For each digest, what its stored bytes and the samples read back from them give."""

    def work(stored: bytes) -> tuple:
        payload = decode_image(stored)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), image_feature(payload)

    return _ranges(places, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", work)


def media_columns(df: DataFrame, folder: str | None = None, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """Each row's place and what reading its payload back gives; equal texts have equal values.

    Null texts count as empty; rows may repeat; other columns are ignored; an empty table gives no rows.
    """
    places = store(df, folder, text, keep)
    columns = read_back(places).join(headers(places), ["_k1", "_k2"])
    # Written, so that the join of all rows is a join alone, which may be split where a text has many rows.
    named = Written(places.join(columns, ["_k1", "_k2"]), "media-columns").df
    rows = df.select(F.col(keep).alias("_id"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"), *payload_key(F.col(text)))
    return rows.join(named, ["_k1", "_k2"]).select(F.col("_id").alias(keep), "n_bytes", "digest", "shard", "offset", "length", "width", "height", "bits", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def digests(df: DataFrame, keep: str = "doc_id") -> DataFrame:
    """The columns of ``media_columns`` that do not depend on where payloads lie. Nulls, empty and long texts, repeated
    rows, empty tables and other columns as there."""
    return media_columns(df, keep=keep).select(keep, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
