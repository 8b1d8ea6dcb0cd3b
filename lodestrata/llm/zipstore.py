"""Minimal streaming ZIP writer and range-reading ZIP reader for stored members.

Both sides follow the published ZIP layout: local headers, a central directory, and the ZIP64 records where a size,
an offset or a count does not fit the classic fields (or where the caller asks for them).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
DOS_DATE = 33  # 1980-01-01, so that equal members give equal bytes
TAIL = 22 + 0xFFFF


class BadArchive(ValueError):
    """The bytes at hand are not the archive that the directory describes."""


@dataclass(frozen=True)
class Member:
    name: str
    offset: int  # of the local header
    size: int
    crc: int
    method: int


class ZipWriter:
    """Writes stored members one after another to a stream that need not seek."""

    def __init__(self, stream, zip64: bool = False):
        self.stream, self.zip64, self.at, self.members = stream, zip64, 0, []

    def _put(self, data) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, name: str, *parts: bytes) -> None:
        size, crc, raw = sum(map(len, parts)), 0, name.encode()
        for part in parts:
            crc = zlib.crc32(part, crc)
        large = self.zip64 or size >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if large else b""
        self.members.append(Member(name, self.at, size, crc, 0))
        shown = FULL32 if large else size
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if large else 20, 0x800, 0, 0, DOS_DATE, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        for part in parts:
            self._put(part)

    def close(self) -> int:
        """Write the directories; returns the bytes of the archive."""
        start = self.at
        for m in self.members:
            raw, large = m.name.encode(), self.zip64 or max(m.size, m.offset) >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, m.size, m.size, m.offset) if large else b""
            size, offset = (FULL32, FULL32) if large else (m.size, m.offset)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if large else 20, 0x800, 0, 0, DOS_DATE, m.crc, size, size, len(raw), len(extra), 0, 0, 0, 0, offset) + raw + extra)
        size, count = self.at - start, len(self.members)
        if large := self.zip64 or count >= FULL16 or max(size, start) >= FULL32:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, size, start) + struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
        n, s, o = (FULL16, FULL32, FULL32) if large else (count, size, start)
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, s, o, 0))
        return self.at


def central_range(read, size: int) -> tuple[int, int, int]:
    """(offset, length, members) of the central directory. read(offset, length) -> bytes."""
    tail_at = max(0, size - TAIL)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise BadArchive("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if count == FULL16 or length == FULL32 or offset == FULL32:
        sign, _, end64, _ = struct.unpack("<IIQI", read(tail_at + at - 20, 20))
        if sign != LOCATOR64:
            raise BadArchive("no ZIP64 locator")
        fields = struct.unpack("<IQHHIIQQQQ", read(end64, 56))
        if fields[0] != END64:
            raise BadArchive("no ZIP64 end of central directory")
        count, length, offset = fields[7:]
    return offset, length, count


def central_members(read, size: int) -> Iterator[Member]:
    """Members as the central directory lists them, with their ZIP64 fields resolved."""
    offset, length, count = central_range(read, size)
    raw, at = read(offset, length), 0
    for _ in range(count):
        f = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
        if f[0] != CENTRAL:
            raise BadArchive("broken central directory")
        method, crc, packed, full, n, m, k, where = f[4], f[7], f[8], f[9], f[10], f[11], f[12], f[16]
        name, extra = raw[at + 46 : at + 46 + n].decode(), raw[at + 46 + n : at + 46 + n + m]
        x = 0
        while x + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, x)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, x + 4))
                full = next(wide) if full == FULL32 else full
                packed = next(wide) if packed == FULL32 else packed
                where = next(wide) if where == FULL32 else where
            x += 4 + width
        yield Member(name, where, packed, crc, method)
        at += 46 + n + m + k


def body_offset(read, member: Member) -> int:
    """Offset of a member's bytes, behind its local header."""
    head = read(member.offset, 30)
    if len(head) < 30 or struct.unpack_from("<I", head)[0] != LOCAL:
        raise BadArchive(f"no local header at {member.offset}")
    n, m = struct.unpack_from("<HH", head, 26)
    return member.offset + 30 + n + m


def reader(handle):
    """read(offset, length) over a random access file of pyarrow."""

    def read(offset: int, length: int) -> bytes:
        handle.seek(offset)
        return handle.read(length)

    return read
