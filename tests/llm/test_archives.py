"""Media archives and WARC packages."""

import base64
import hashlib
import io
import zipfile
import zlib

import pytest

from lodestrata.llm import media, warc, zipstore
from lodestrata.llm.common import workspace


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_is_read_by_others_and_reads_theirs(zip64):
    out = io.BytesIO()
    pack = zipstore.ZipWriter(out, zip64)
    pack.add("a/b.txt", b"one", b"two")
    pack.add("empty")
    size = pack.close()
    assert size == len(out.getvalue())
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None and z.read("a/b.txt") == b"onetwo" and z.namelist() == ["a/b.txt", "empty"]
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("x", b"stored")
        z.comment = b"a comment"
    for raw, name, body in ((out.getvalue(), "a/b.txt", b"onetwo"), (other.getvalue(), "x", b"stored")):
        read = lambda at, n, raw=raw: raw[at : at + n]
        m = next(iter(zipstore.central_members(read, len(raw))))
        at = zipstore.body_offset(read, m)
        assert m.name == name and raw[at : at + m.size] == body
    with pytest.raises(zipstore.BadArchive):
        list(zipstore.central_members(lambda at, n: b"x" * n, 100))


def test_media_round_trip_by_small_ranges(spark):
    rows = [(k, "téxt " * k) for k in range(60)] + [(100, None), (None, "same"), (101, "same"), (101, "same"), (102, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("member", docs_lit()).repartition(3)
    manifest = media.write_archives(docs, workspace(spark, "t"), archive_bytes=4000)
    source = media.read_archives(spark, manifest, range_bytes=700, batch_bytes=500)
    found = [tuple(r) for r in media.payload_features(source).collect()]
    assert len(found) == len(rows)
    by_id = {r[0]: r for r in found}
    for doc_id, text in rows:
        raw = (text or "").encode()
        payload = media.padded(raw)
        assert by_id[doc_id][1:5] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert by_id[None][1:] == by_id[101][1:]
    empty = media.write_archives(docs.where("doc_id > 999"), workspace(spark, "t"))
    assert media.read_archives(spark, empty).count() == 0


def docs_lit():
    from pyspark.sql import functions as F

    return F.lit("a clashing name")


def test_member_is_retried_on_its_own(tmp_path):
    path = tmp_path / "a.zip"
    with path.open("wb") as out:
        pack = zipstore.ZipWriter(out)
        pack.add("00000000-1.png", media.to_png(b"hello"))
        pack.close()

    class Flaky:
        def __init__(self):
            self.failures = 2

        def open_input_file(self, where):
            if self.failures:
                self.failures -= 1
                raise OSError("gone")
            from pyarrow import fs

            return fs.LocalFileSystem().open_input_file(where)

    reader = media.MediaReader({"manifest": ""})
    member = pack.members[0]
    data = reader.member(Flaky(), str(path), [None], member)
    assert media.from_png(data) == (media.padded(b"hello"), 5)
    raw = bytearray(path.read_bytes())
    raw[60] ^= 1
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        reader.member(Flaky(), str(path), [None], member)


def test_warc_records_and_revisits(spark):
    rows = [(5, "http://a/\r\nx", "same"), (3, None, "same"), (9, "u", "same"), (9, "u", "same"), (1, "u", None), (2, "u", ""), (None, "u", "same"), (4, "u", "é" * 100_000), (7, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = sorted(map(tuple, warc.read_packages(warc.write_packages(pages, workspace(spark, "t"), package_bytes=300)).collect()), key=repr)
    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        first = {"same": 3, "": 1}.get(html or "", page_id)
        later = page_id is not None and page_id > first
        want.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if later else "response", first if later else None))
    assert found == sorted(want, key=repr)
    assert warc.read_packages(warc.write_packages(pages.where("page_id > 99"), workspace(spark, "t"))).count() == 0
    least = warc.read_packages(warc.write_packages(pages, workspace(spark, "t"), least_bytes=5)).where("record_type = 'revisit'")
    assert least.count() == 0


def decoded_picture(blob):
    """A reader of the picture format of its own: chunks, checksums, filters 0 to 4."""
    import struct
    import zlib

    assert blob[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, head, data = 8, None, b""
    while at < len(blob):
        (n,), kind = struct.unpack(">I", blob[at : at + 4]), blob[at + 4 : at + 8]
        body = blob[at + 8 : at + 8 + n]
        assert struct.unpack(">I", blob[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        head, data = (struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head), data + (body if kind == b"IDAT" else b"")
        at += 12 + n
    width, height, depth, colour, *_ = head
    assert (depth, colour) == (8, 2)
    raw, size, rows, last = zlib.decompress(data), 3 * width, [], bytes(3 * width)
    for y in range(height):
        kind, line = raw[y * (size + 1)], bytearray(raw[y * (size + 1) + 1 : (y + 1) * (size + 1)])
        for x in range(size):
            a, b, c = (line[x - 3] if x >= 3 else 0), last[x], (last[x - 3] if x >= 3 else 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line[x] = line[x] + (0, a, b, (a + b) // 2, nearest)[kind] & 255
        last = bytes(line)
        rows.append(last)
    return b"".join(rows)


def test_stored_pictures_by_another_reader(spark, tmp_path):
    import hashlib
    import zlib

    from lodestrata.llm import media

    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "ab\n" * 3000, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = media.read_archives(spark, media.write_archives(docs, workspace(spark, "t")))
    blobs = {r.doc_id: bytes(r.media) for r in stored.collect()}
    found = {r.doc_id: r for r in media.payload_features(stored).collect()}
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = found[k]
        assert decoded_picture(blobs[k]) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(blobs[k]), hashlib.sha256(blobs[k]).hexdigest())
    assert found[2].feature == found[7].feature and len({r.feature for r in found.values()}) >= 5
