"""WARC: write pages as record archives inside ZIP packages and range-read the records back.

Method: every package is a ZIP of stored members, `archive/data.warc.gz` (a gzip member per record) and
`indexes/index.cdx` (offset and length per record). The reader parses the central directory, with its ZIP64 records,
locates the stored archive and its index, and reads records by byte range; nothing is extracted.

Defined cases: null html is the empty payload; a null page_id is written and read as null and is always a response; rows
that repeat a page_id with the same payload are all written, and are responses if that id is the smallest; an empty table
gives no package and no row; columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import zipstore
from .common import open_store, small, stored, table, workspace

#: Bytes of compressed records after which a task starts another package; bounds the writer's memory.
PACKAGE_BYTES = 32 << 20
READ_AHEAD = 4 << 20
# Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

MANIFEST = "path string, bytes long, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _urn(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head (with the full length) and no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head += [f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Page-ID: {page_id}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict[str, object]:
    """Fields of a record; payload_digest is computed from a response's payload and taken from a revisit's head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise zipstore.BadArchive(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    if (kind := fields["WARC-Type"]) == "response":
        size = len(payload)
        if told != (told := base64.b32encode(hashlib.sha1(payload).digest()).decode()):
            raise zipstore.BadArchive("payload digest differs")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("WARC-Page-ID"), "payload_bytes": size, "payload_digest": told, "record_type": kind, "refers_to": number("WARC-Refers-To-Page-ID"), "payload": payload}


def _write(folder: str, package_bytes: int, zip64: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        body, index, held = [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(f"{root}/{name}") as out:
                pack = zipstore.ZipWriter(out, zip64)
                pack.add("archive/data.warc.gz", *body)
                pack.add("indexes/index.cdx", "".join(f"{at} {n}\n" for at, n in index).encode())
                size = pack.close()
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": pa.array([size], pa.int64()), "records": pa.array([len(index)], pa.int64())})
            body.clear(), index.clear()
            return row

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                raw = zlib.compress(record(row[0], row[1], (row[2] or "").encode(), row[3]), 1, 31)
                index.append((held, len(raw)))
                body.append(raw)
                held += len(raw)
                if held >= package_bytes:
                    yield flush()
                    held = 0
        if index:
            yield flush()

    return run


def read_records(path: str) -> Iterator[dict[str, object]]:
    """Records of one package by range reads of its stored members."""
    fs, where = open_store(path)
    with fs.open_input_file(where) as handle:
        read = zipstore.reader(handle)
        members = {m.name: m for m in zipstore.central_members(read, handle.size())}
        for name, member in members.items():
            if name.startswith("archive/") and member.method != 0:
                raise zipstore.BadArchive(f"{name} isn't stored")
        cdx, data = members["indexes/index.cdx"], members["archive/data.warc.gz"]
        spans = [tuple(map(int, x.split())) for x in read(zipstore.body_offset(read, cdx), cdx.size).decode().splitlines()]
        start, k = zipstore.body_offset(read, data), 0
        while k < len(spans):
            first, end = spans[k][0], k
            while end < len(spans) and (end == k or spans[end][0] + spans[end][1] - first <= READ_AHEAD):
                end += 1
            window = memoryview(read(start + first, spans[end - 1][0] + spans[end - 1][1] - first))
            for at, n in spans[k:end]:
                yield parse(zlib.decompress(window[at - first : at - first + n], 31))
            k = end


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows: list[dict[str, object]] = []
            for x in read_records(path):
                rows.append({c: x[c] for c in schema.names})
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, zip64: bool = True) -> DataFrame:
    """Write pages as packages under folder; returns the manifest of those that committed tasks wrote.

    Of equal payloads (by SHA-256) of least_bytes or more, the smallest page_id is the response that the others refer to.
    Only ids and digests are shuffled for that; the payloads stay where they are read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.unhex(F.sha2("html", 256)))
    ids = keyed.where(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = stored(ids.join(first, "digest").where("page_id > refers_to").distinct(), f"{folder}/later")
    joined = keyed.join(small(later, later.count()), ["page_id", "digest"], "left")
    return stored(joined.select("page_id", "url", "html", "refers_to").mapInArrow(_write(f"{folder}/packages", package_bytes, zip64), MANIFEST), f"{folder}/manifest")


def read_packages(manifest: DataFrame) -> DataFrame:
    """A row per record of the packages that the manifest lists."""
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(_read, RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_packages(write_packages(table(spark, sf_dir, "pages"), workspace(spark, "warc")))


#: The same rows from the table itself. DuckDB has no base32, so it is spelled out by 5-bit groups of the SHA-1's bits.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS k, sha1(b) AS h FROM p),
f AS (SELECT k, min(page_id) AS first_id FROM d GROUP BY k),
alphabet AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a)
SELECT d.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: a[1 + CAST(
    (('0x' || substr(h, 1 + CAST(5 * (i // 4) AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT)]), '') AS payload_digest,
  CASE WHEN d.page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id > first_id THEN first_id END AS refers_to
FROM d JOIN f USING (k), alphabet
"""
