"""gzip (RFC 1952), ZIP (APPNOTE) and JPEG markers."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace

from .deflate import best_deflate, inflate

MOST_BYTES = 1_200_000_000


class FormatError(ValueError):
    """Input that is not what it claims; the message says why."""


@dataclass(frozen=True)
class GzipMember:
    flags: int
    mtime: int
    name: str | None
    has_extra: bool
    has_comment: bool
    crc32: int
    isize: int


def gzip_header(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The fields of a member header and where its stream begins."""
    if data[at : at + 2] != b"\x1f\x8b" or len(data) < at + 10 or data[at + 2] != 8:
        raise FormatError("not gzip")
    flags, mtime, xfl, system = data[at + 3], *struct.unpack_from("<IBB", data, at + 4)
    if flags & 0xE0:
        raise FormatError("reserved flags")
    pos, name = at + 10, None
    if flags & 4:
        if pos + 2 > len(data):
            raise FormatError("truncated")
        pos += 2 + struct.unpack_from("<H", data, pos)[0]
    for bit in (8, 16):
        if flags & bit:
            end = data.find(b"\0", pos)
            if end < 0:
                raise FormatError("truncated")
            if bit == 8:
                name = data[pos:end].decode("latin-1")
            pos = end + 1
    if flags & 2:
        pos += 2
    if pos > len(data):
        raise FormatError("truncated")
    return {"flags": flags, "mtime": mtime, "xfl": xfl, "os": system, "name": name, "has_extra": bool(flags & 4), "has_comment": bool(flags & 16)}, pos


def gzip_classify(data: bytes) -> str:
    """``none``, ``gzip``, ``extras`` (fields a rewrite would drop) or ``error``."""
    if data[:3] != b"\x1f\x8b\x08":
        return "none"
    try:
        fields, _ = gzip_header(data)
    except FormatError:
        return "error"
    return "extras" if fields["has_extra"] or fields["has_comment"] else "gzip"


def gunzip(data: bytes, most: int = MOST_BYTES) -> tuple[bytes, list[GzipMember]]:
    """The content of all members; bytes after the last that begin no member are ignored.

    A truncated stream, a wrong CRC, a wrong length and more than ``most`` bytes of content are errors.
    """
    parts, members, pos, total = [], [], 0, 0
    view = memoryview(data)
    while pos < len(data):
        try:
            fields, start = gzip_header(data, pos)
        except FormatError:
            if members:
                break
            raise
        stream, found, fed = zlib.decompressobj(-15), [], start
        try:
            while not stream.eof and fed < len(data):
                rest, fed = view[fed : fed + (1 << 20)], min(fed + (1 << 20), len(data))
                while rest and not stream.eof:
                    found.append(stream.decompress(rest, 1 << 24))
                    total += len(found[-1])
                    if total > most:
                        raise FormatError("too big")
                    rest = stream.unconsumed_tail
        except zlib.error as e:
            raise FormatError("stream") from e
        tail = fed - len(stream.unused_data)
        if not stream.eof or tail + 8 > len(data):
            raise FormatError("truncated")
        body = b"".join(found)
        crc, size = struct.unpack_from("<II", data, tail)
        if crc != zlib.crc32(body) or size != len(body) & 0xFFFFFFFF:
            raise FormatError("checksum")
        members.append(GzipMember(fields["flags"], fields["mtime"], fields["name"], fields["has_extra"], fields["has_comment"], crc, size))
        parts.append(body)
        pos = tail + 8
    if not members:
        raise FormatError("not gzip")
    return b"".join(parts), members


def gzip_frame(body: bytes, crc32: int, size: int, name: str | None = None, mtime: int = 0) -> bytes:
    """A member around a raw DEFLATE stream; the name is reduced to its last path component."""
    base = os.path.basename(name).encode("latin-1", "replace") if name else b""
    head = b"\x1f\x8b\x08" + bytes([8 if base else 0]) + struct.pack("<IBB", mtime, 2, 3) + (base + b"\0" if base else b"")
    return head + body + struct.pack("<II", crc32, size & 0xFFFFFFFF)


def gzip_encode(content: bytes, level: int = 3, name: str | None = None, mtime: int = 0, passes: int | None = None, rounds: int = 0) -> bytes:
    """One member."""
    return gzip_frame(best_deflate(content, level, passes, rounds), zlib.crc32(content), len(content), name, mtime)


def gzip_optimize(data: bytes, level: int = 3, strict: bool = False, name: str | None = None, passes: int | None = None, rounds: int = 0) -> tuple[bytes, str]:
    """The result and a status: ``created``, ``smaller``, ``kept`` or why it was refused.

    A new member is kept even if it is larger; a rewrite only if it is smaller.
    """
    if not data:
        return data, "empty"
    if len(data) >= MOST_BYTES:
        return data, "too big"
    kind = gzip_classify(data)
    if kind == "none":
        return gzip_encode(data, level, name, 0, passes, rounds), "created"
    if kind == "error" or (kind == "extras" and strict):
        return data, "refused"
    try:
        content, members = gunzip(data)
    except FormatError as e:
        return data, f"error: {e}"
    made = gzip_encode(content, level, members[0].name, members[0].mtime, passes, rounds)
    if len(made) < len(data) and gunzip(made)[0] == content:
        return made, "smaller"
    return data, "kept"


@dataclass(frozen=True)
class ZipEntry:
    name: bytes
    method: int
    flags: int
    time: int
    date: int
    crc32: int
    compressed_size: int
    size: int
    offset: int
    version_made: int = 0
    internal: int = 0
    external: int = 0
    data: bytes = b""

    @property
    def encrypted(self) -> bool:
        return bool(self.flags & 1)


def valid_archive_name(name: str) -> bool:
    return not name.startswith("/") and "\\" not in name and ":" not in name and bool(name)


def dos_time(year: int, month: int, day: int, hour: int, minute: int, second: int) -> tuple[int, int]:
    """(date, time) words; years outside 1980 to 2107 are clamped to the first and last moment."""
    if year < 1980:
        return 0x21, 0
    if year > 2107:
        return 0xFF9F, 0xBF7D
    return (year - 1980) << 9 | month << 5 | day, hour << 11 | minute << 5 | second // 2


def _end_records(data: bytes):
    """Every place that may be the end record, last first."""
    low = max(0, len(data) - 65557)
    at = data.rfind(b"PK\5\6", low)
    while at >= 0:
        yield at
        at = data.rfind(b"PK\5\6", low, at + 3)


def zip_entries(data: bytes) -> tuple[list[ZipEntry], int]:
    """Entries by local offset and the bytes that precede the archive.

    An end record whose directory does not parse (one in a comment, say) is passed over for an earlier one.
    """
    reason = "no end record"
    for end in _end_records(data):
        if end + 22 > len(data):
            continue
        count, size, offset = struct.unpack_from("<HII", data, end + 10)
        last = end
        if count == 0xFFFF or 0xFFFFFFFF in (size, offset):
            # ZIP64: a locator, and before it the large end record.
            last = end - 20 - 56
            if last < 0 or data[end - 20 : end - 16] != b"PK\6\7" or data[last : last + 4] != b"PK\6\6":
                reason = "large end record"
                continue
            count, size, offset = struct.unpack_from("<QQQ", data, last + 32)
        base = last - size - offset
        if base < 0:
            reason = "directory bounds"
            continue
        try:
            return _directory(data, base, base + offset, last, count), base
        except FormatError as e:
            reason = str(e)
    raise FormatError(reason)


def _directory(data: bytes, base: int, at: int, end: int, count: int) -> list[ZipEntry]:
    out = []
    for _ in range(count):
        if at + 46 > end or data[at : at + 4] != b"PK\1\2":
            raise FormatError("directory entry")
        made, _, flags, method, time, date, crc, packed, size, n, extra, note, _, internal, external, local = struct.unpack_from("<HHHHHHIIIHHHHHII", data, at + 4)
        name = data[at + 46 : at + 46 + n]
        place = base + local
        if place + 30 > end or data[place : place + 4] != b"PK\3\4":
            raise FormatError("local header")
        ln, le = struct.unpack_from("<HH", data, place + 26)
        if data[place + 30 : place + 30 + ln] != name:
            raise FormatError("names differ")
        start = place + 30 + ln + le
        if start + packed > end:
            raise FormatError("entry bounds")
        out.append(ZipEntry(name, method, flags, time, date, crc, packed, size, local, made, internal, external, data[start : start + packed]))
        at += 46 + n + extra + note
    out.sort(key=lambda e: e.offset)
    for a, b in zip(out, out[1:]):
        if a.offset + 30 + len(a.name) + a.compressed_size > b.offset:
            raise FormatError("entries overlap")
    return out


class ZipStream:
    """Writes an archive without extra fields, descriptors and comments, entry by entry; from 65,535 entries on with ZIP64
    end records.  Only the directory is held."""

    def __init__(self, write: Callable[[bytes], object], prefix: bytes = b""):
        self.write, self.place, self.count, self.directory = write, 0, 0, bytearray()
        if prefix:
            write(prefix)

    def add(self, e: ZipEntry) -> None:
        flags = e.flags & ~8
        common = struct.pack("<HHHHHIIIH", 20, flags, e.method, e.time, e.date, e.crc32, len(e.data), e.size, len(e.name))
        head = b"PK\3\4" + common + b"\0\0" + e.name
        if self.place > 0xFFFFFFFE - len(head) - len(e.data):
            raise FormatError("archive of 4 GiB or more")
        self.write(head)
        self.write(e.data)
        self.directory += b"PK\1\2" + struct.pack("<H", e.version_made) + common + struct.pack("<HHHHII", 0, 0, 0, e.internal, e.external, self.place) + e.name
        self.place += len(head) + len(e.data)
        self.count += 1

    def finish(self) -> None:
        start, size = self.place, len(self.directory)
        self.write(bytes(self.directory))
        if self.count >= 0xFFFF:
            self.write(b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, self.count, self.count, size, start) + b"PK\6\7" + struct.pack("<IQI", 0, start + size, 1))
            self.write(b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        else:
            self.write(b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, self.count, self.count, size, start, 0))


def zip_write(entries: list[ZipEntry], prefix: bytes = b"") -> bytes:
    """An archive in memory."""
    out = bytearray()
    stream = ZipStream(out.extend, prefix)
    for e in entries:
        stream.add(e)
    stream.finish()
    return bytes(out)


def zip_entry(name: str, content: bytes, level: int = 3, date: int = 0x21, time: int = 0, passes: int | None = None, rounds: int = 0) -> ZipEntry:
    """A new entry, stored if deflating does not help.  A directory ends with /."""
    if not valid_archive_name(name):
        raise FormatError(f"name: {name}")
    packed = best_deflate(content, level, passes, rounds) if content else b""
    method = 8 if content and len(packed) < len(content) else 0
    return ZipEntry(name.encode(), method, 0, time, date, zlib.crc32(content), 0, len(content), 0, data=packed if method else content, external=0x10 if name.endswith("/") else 0)


def zip_content(entry: ZipEntry) -> bytes | None:
    """The checked content, or None for encrypted, foreign or corrupt entries."""
    if entry.encrypted or entry.method not in (0, 8):
        return None
    try:
        content = entry.data if entry.method == 0 else inflate(entry.data)
    except (zlib.error, ValueError):
        return None
    return content if len(content) == entry.size and zlib.crc32(content) == entry.crc32 else None


def zip_create(files: list[tuple[str, bytes]], existing: bytes = b"", date: int = 0x21, time: int = 0, level: int = 3) -> bytes:
    """Append files; names that are invalid or already there (in any case) are errors.  A directory ends with /."""
    entries, base = zip_entries(existing) if existing else ([], 0)
    names = {e.name.lower() for e in entries}
    entries = list(entries)
    for name, content in files:
        if name.encode().lower() in names:
            raise FormatError(f"name: {name}")
        names.add(name.encode().lower())
        entries.append(zip_entry(name, content, level, date, time))
    return zip_write(entries, existing[:base])


def _nested(name: bytes, content: bytes, level: int, depth: int, passes: int | None, rounds: int) -> bytes:
    """A smaller form of a PNG or ZIP inside an archive; other content as it is."""
    from .png import PngError, optimize

    if b"." not in name:
        return content
    ending = name.rsplit(b".", 1)[1]
    if ending in (b"png", b"PNG"):
        try:
            return optimize(content, level, passes=passes, rounds=rounds)
        except (PngError, zlib.error):
            return content
    if content[:4] == b"PK\3\4" and depth < 8:
        try:
            return zip_optimize(content, level, depth=depth + 1, passes=passes, rounds=rounds)
        except FormatError:
            return content
    return content


def zip_optimize_entry(e: ZipEntry, level: int = 3, strict: bool = False, depth: int = 0, passes: int | None = None, rounds: int = 0) -> ZipEntry:
    """The entry as the smallest of stored, old and new; one that cannot be read as it is."""
    content = zip_content(e)
    if content is None:
        return e
    inner = content if strict else _nested(e.name, content, level, depth, passes, rounds)
    changed = {"crc32": zlib.crc32(inner), "size": len(inner)}
    if e.method == 0 or not inner:
        return replace(e, method=0, data=inner, **changed)
    packed = best_deflate(inner, level, passes, rounds)
    if len(inner) <= len(packed) and (len(inner) <= len(e.data) or inner != content):
        return replace(e, method=0, data=inner, **changed)
    return replace(e, method=8, data=packed, **changed) if inner != content or len(packed) < len(e.data) else e


def zip_optimize(data: bytes, level: int = 3, strict: bool = False, depth: int = 0, passes: int | None = None, rounds: int = 0) -> bytes:
    """The archive with each entry at its smallest; the input if that is not smaller."""
    entries, base = zip_entries(data)
    made = zip_write([zip_optimize_entry(e, level, strict, depth, passes, rounds) for e in entries], data[:base])
    if len(made) >= len(data):
        return data
    check, _ = zip_entries(made)
    return made if [zip_content(e) is None for e in check] == [zip_content(e) is None for e in entries] else data


# Fixed value: EXIF orientation to the transform that undoes it.
ORIENTATION = {1: "none", 2: "flip horizontally", 3: "rotate 180", 4: "flip vertically", 5: "transpose", 6: "rotate 90", 7: "transverse", 8: "rotate 270"}


def jpeg_segments(data: bytes) -> list[tuple[int, bytes]]:
    """(marker, content) up to the first scan."""
    if data[:2] != b"\xff\xd8":
        raise FormatError("not jpeg")
    out, pos = [], 2
    while pos + 4 <= len(data) and data[pos] == 0xFF:
        marker = data[pos + 1]
        if marker == 0xFF:
            pos += 1
            continue
        size = struct.unpack_from(">H", data, pos + 2)[0]
        if size < 2 or pos + 2 + size > len(data):
            raise FormatError("truncated")
        out.append((marker, data[pos + 4 : pos + 2 + size]))
        pos += 2 + size
        if marker == 0xDA:
            return out
    raise FormatError("no scan")


def exif_orientation(data: bytes) -> int:
    """1 to 8 from the first EXIF segment; 0 where there is none or it is broken."""
    try:
        segments = jpeg_segments(data)
    except FormatError:
        return 0
    body = next((c[6:] for m, c in segments if m == 0xE1 and c[:6] == b"Exif\0\0"), b"")
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(body[:4])
    if order is None or len(body) < 8:
        return 0
    at = struct.unpack_from(order + "I", body, 4)[0]
    if at + 2 > len(body):
        return 0
    for k in range(struct.unpack_from(order + "H", body, at)[0]):
        place = at + 2 + 12 * k
        if place + 12 > len(body):
            return 0
        tag, kind, count = struct.unpack_from(order + "HHI", body, place)
        if tag == 0x0112:
            value = struct.unpack_from(order + "H", body, place + 8)[0]
            return value if kind == 3 and count == 1 and 1 <= value <= 8 else 0
    return 0


def jpeg_strip(data: bytes) -> bytes:
    """The file without comments and application segments other than JFIF and Adobe, each once."""
    segments, seen = jpeg_segments(data), set()
    out, used = [b"\xff\xd8"], 2
    for marker, content in segments:
        used += 4 + len(content)
        kind = content[:5] if marker in (0xE0, 0xEE) else b""
        if marker == 0xFE or 0xE1 <= marker <= 0xED or marker == 0xEF or (kind and (kind in seen or kind not in (b"JFIF\0", b"Adobe"))):
            continue
        seen.add(kind)
        out.append(bytes([0xFF, marker]) + struct.pack(">H", len(content) + 2) + content)
    return b"".join(out) + data[used:]


def tries_progressive(size: int, level: int, progressive: bool) -> bool:
    return progressive and (level > 1 or size > 5000)


def tries_baseline(stripped: int, level: int) -> bool:
    """Whether a baseline scan is worth trying beside a progressive one."""
    return stripped < {2: 6500, 3: 10000, 4: 15000}.get(level, 20000)
