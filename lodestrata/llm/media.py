"""Media columns: payloads as PNG members of ZIP archives, read back through a Spark data source.

Method: the data source lists the archives of a folder (by the manifest of committed tasks), plans byte ranges over each of
them, and every partition reads the archive's central directory, keeps the members whose local header starts in its range,
and streams their payloads through Arrow batches of bounded size. Each member is read by its own offset and retried on its own.

A payload is the UTF-8 text padded with spaces to a positive multiple of 192 bytes, stored losslessly as an RGB picture of
8-bit samples, 64 pixels wide: a row is 192 bytes. The unpadded size stands in a text chunk of the picture.

Defined cases: null and empty texts are 192 spaces; equal texts give equal pictures, digests and features; a null doc_id is
kept; rows that repeat are stored once each; an empty table gives no archive and no row; columns besides doc_id and text are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import zipstore
from .common import open_store, stored, table, workspace

ROW = 192
WIDTH = ROW // 3
#: Bytes after which a writing task starts another archive, bytes of a planned range, bytes of a batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 128 << 20, 16 << 20, 8 << 20
RETRIES = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the PNG format
MANIFEST = "path string, bytes long, members long"
MEDIA = "member string, doc_id long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(raw: bytes) -> bytes:
    return raw + b" " * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(raw: bytes, level: int = 1) -> bytes:
    """The padded payload as a picture; filter type 0 on every row."""
    rows = np.frombuffer(padded(raw), np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded bytes); raises BadArchive where a chunk's checksum differs."""
    if media[:8] != SIGNATURE:
        raise zipstore.BadArchive("no picture")
    at, body, told = 8, [], 0
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if len(data) < n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise zipstore.BadArchive("a chunk's checksum differs")
        if kind == b"IDAT":
            body.append(data)
        elif kind == b"tEXt":
            told = int(data.partition(b"\0")[2])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, ROW + 1)
    return np.ascontiguousarray(lines[:, 1:]).tobytes(), told


def feature(payload: bytes) -> str:
    """Height, mean of each channel in thousandths, and a 64-bit average hash over an 8 by 8 grid of sample means."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, 3)
    sums = pixels.sum(axis=0, dtype=np.int64)
    means = [int(x) * 1000 // len(pixels) for x in sums]
    samples = np.frombuffer(payload, np.uint8)
    cells = np.add.reduceat(samples, np.arange(64) * len(samples) // 64, dtype=np.int64)
    bits = cells * 64 > int(samples.sum(dtype=np.int64))
    return f"{len(pixels) // WIDTH}x{WIDTH};{','.join(map(str, means))};{int(np.packbits(bits).view('>u8')[0]):016x}"


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        out = pack = None

        def closed() -> pa.RecordBatch:
            n, size = len(pack.members), pack.close()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "members": pa.array([n], pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if pack is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    path, out = f"{folder}/{name}", fs.open_output_stream(f"{root}/{name}")
                    pack = zipstore.ZipWriter(out)
                pack.add(f"{len(pack.members):08d}-{'' if doc_id is None else doc_id}.png", to_png((text.as_py() or "").encode()))
                if pack.at >= archive_bytes:
                    yield closed()
                    pack = None
        if pack is not None:
            yield closed()

    return run


class Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class MediaReader(DataSourceReader):
    """Options: manifest (a folder of Parquet with path and bytes), range_bytes, batch_bytes, retries."""

    def __init__(self, options):
        self.manifest = options["manifest"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[InputPartition]:
        import pyarrow.dataset as ds

        fs, root = open_store(self.manifest)
        rows = ds.dataset(root, filesystem=fs, format="parquet", schema=pa.schema([("path", pa.string()), ("bytes", pa.int64())])).to_table().to_pylist()
        return [Range(r["path"], at, min(at + self.range_bytes, r["bytes"])) for r in rows for at in range(0, r["bytes"], self.range_bytes)] or [Range("", 0, 0)]

    def member(self, fs, where: str, held: list, m: zipstore.Member) -> bytes:
        """One member's bytes, with retries of its own that open the archive anew."""
        for attempt in range(self.retries + 1):
            try:
                if held[0] is None:
                    held[0] = fs.open_input_file(where)
                read = zipstore.reader(held[0])
                head = read(m.offset, 30 + 256 + m.size)  # header and body in one range; names are under 256 bytes
                n, k = struct.unpack_from("<HH", head, 26)
                data = head[30 + n + k : 30 + n + k + m.size]
                if struct.unpack_from("<I", head)[0] != zipstore.LOCAL or len(data) != m.size or zlib.crc32(data) != m.crc:
                    raise zipstore.BadArchive(f"{where}: the member at {m.offset} is damaged")
                return data
            except (OSError, ValueError, struct.error):
                held[0] = None
                if attempt == self.retries:
                    raise
                time.sleep(0.05 * 2**attempt)
        raise AssertionError

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, where = open_store(partition.path)
        with fs.open_input_file(where) as handle:
            read = zipstore.reader(handle)
            own = [m for m in zipstore.central_members(read, handle.size()) if partition.low <= m.offset < partition.high]
        held, rows, size = [None], ([], [], []), 0
        for m in own:
            data = self.member(fs, where, held, m)
            told = m.name.partition("-")[2].removesuffix(".png")
            for column, x in zip(rows, (m.name, int(told) if told else None, data), strict=True):
                column.append(x)
            size += len(data)
            if size >= self.batch_bytes:
                yield self.batch(rows)
                rows, size = ([], [], []), 0
        if rows[0]:
            yield self.batch(rows)

    def batch(self, rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["member", "doc_id", "media"])


class MediaArchives(DataSource):
    """spark.read.format("media_archives").option("manifest", folder).load(): member, doc_id, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEDIA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Store every text of docs; returns the folder of the manifest of committed archives."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored(rows.mapInArrow(_write(f"{folder}/archives", archive_bytes), MANIFEST), f"{folder}/manifest")
    return f"{folder}/manifest"


def read_archives(spark: SparkSession, manifest: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(manifest=manifest, **options).load()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(7)]
        for media in batch.column("media"):
            media = media.as_py()
            payload, n = from_png(media)
            for column, x in zip(columns, (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)), strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def payload_features(media: DataFrame) -> DataFrame:
    """Digests and features of the payloads as they are read back."""
    return media.select("doc_id", "media").mapInArrow(_features, READ)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as media and read back: sizes, digests, tail checksum and feature."""
    return payload_features(read_archives(spark, write_archives(table(spark, sf_dir, "documents"), workspace(spark, "media"))))
