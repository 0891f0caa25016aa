"""Media columns: signature sniffing, structural validation, type correction and carving."""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .common import settle

# Magic bytes, how far before them a file begins, and the media type they announce.
SIGNATURES: tuple[tuple[bytes, int, str], ...] = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"WEBP", 8, "image/webp"),
    (b"WAVE", 8, "audio/wav"),
    (b"AVI ", 8, "video/x-msvideo"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b".snd", 0, "audio/basic"),
    (b"MThd", 0, "audio/midi"),
    (b"ftyp", 4, "video/mp4"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
)


# Marks by which validators find the end of a file.
MARKS = (b"%%EOF", b"startxref", b"PK\x05\x06")


@dataclass
class Cell:
    """A binary value, the places of each of ``MARKS`` in order, and what validators learnt of it."""

    data: bytes
    marks: dict[bytes, list[int]] = field(default_factory=lambda: {m: [] for m in MARKS})
    pages: dict[int, int | None] = field(default_factory=dict)
    archives: dict[int, int] | None = None

    def after(self, mark: bytes, at: int) -> int | None:
        """The first place of ``mark`` from ``at`` on."""
        places = self.marks[mark]
        k = bisect.bisect_left(places, at)
        return places[k] if k < len(places) else None


def _riff(data: bytes, at: int, form: bytes) -> int | None:
    """End of a RIFF file whose chunks tile its declared length."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != form:
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return None
    pos, seen = at + 12, 0
    while pos + 8 <= end:
        size = struct.unpack_from("<I", data, pos + 4)[0]
        pos += 8 + size + (size & 1)
        seen += 1
    return end if seen and pos in (end, end + 1) else None


def _png(data: bytes, at: int) -> int | None:
    pos, first = at + 8, True
    while pos + 12 <= len(data):
        size = struct.unpack_from(">I", data, pos)[0]
        kind, stop = data[pos + 4 : pos + 8], pos + 12 + size
        if stop > len(data) or first != (kind == b"IHDR") or zlib.crc32(data[pos + 4 : stop - 4]) != struct.unpack_from(">I", data, stop - 4)[0]:
            return None
        if kind == b"IEND":
            return stop
        pos, first = stop, False
    return None


def _jpeg(data: bytes, at: int) -> int | None:
    pos, scanned = at + 2, False
    while pos + 4 <= len(data):
        if data[pos] != 0xFF:
            return None
        marker = data[pos + 1]
        if marker == 0xFF:
            pos += 1
            continue
        if marker == 0xD9:
            return pos + 2 if scanned else None
        if marker < 0xC0 or 0xD0 <= marker <= 0xD8:
            return None
        pos += 2 + struct.unpack_from(">H", data, pos + 2)[0]
        if marker == 0xDA:
            scanned = True
            while True:
                pos = data.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(data):
                    return None
                if data[pos + 1] == 0 or 0xD0 <= data[pos + 1] <= 0xD7:
                    pos += 2
                else:
                    break
    return pos + 2 if scanned and data[pos : pos + 2] == b"\xff\xd9" else None


def _gif(data: bytes, at: int) -> int | None:
    if at + 13 > len(data):
        return None
    flags, pos = data[at + 10], at + 13
    pos += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    images = 0
    while pos < len(data):
        tag = data[pos]
        if tag == 0x3B:
            return pos + 1 if images else None
        if tag == 0x21:
            pos += 2
        elif tag == 0x2C and pos + 10 <= len(data):
            local = data[pos + 9]
            pos += 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1
            images += 1
        else:
            return None
        while pos < len(data) and data[pos]:
            pos += 1 + data[pos]
        pos += 1
    return None


def _bmp(data: bytes, at: int) -> int | None:
    if at + 54 > len(data):
        return None
    size, _, offset, header = struct.unpack_from("<IIII", data, at + 2)
    width, height, planes, bits = struct.unpack_from("<iiHH", data, at + 18)
    if header not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not 14 + header <= offset <= size:
        return None
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    return at + size if offset + rows <= size and at + size <= len(data) else None


def _crc_table(bits: int, poly: int) -> list[int]:
    table = []
    for value in range(256):
        value <<= bits - 8
        for _ in range(8):
            value = (value << 1) ^ (poly if value >> (bits - 1) & 1 else 0)
        table.append(value & ((1 << bits) - 1))
    return table


# The generators of FLAC's header and frame checks.
_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _flac_header(data: bytes, at: int) -> tuple[int, int] | None:
    """End and block size of the frame header at ``at``, if its check holds."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return None
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    lead = data[at + 4]
    pos = at + 5 + (0 if lead < 0x80 else 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3 if lead < 0xF8 else 4 if lead < 0xFC else 5 if lead < 0xFE else 6)
    extra = {6: 1, 7: 2}.get(code, 0)
    size = int.from_bytes(data[pos : pos + extra], "big") + 1 if extra else 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8) if code >= 8 else 0
    pos += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not code or rate == 15 or pos >= len(data):
        return None
    check = 0
    for byte in data[at:pos]:
        check = _CRC8[check ^ byte]
    return (pos + 1, size) if check == data[pos] else None


def _flac(data: bytes, at: int) -> int | None:
    """The end of the last frame: metadata blocks tile, frames follow each other with right checks, and together they
    hold the samples that the first block states (where it states them)."""
    pos, last, first, samples, least = at + 4, False, True, 0, 0
    while not last:
        if pos + 4 > len(data):
            return None
        head = struct.unpack_from(">I", data, pos)[0]
        last, kind, size = bool(head >> 31), head >> 24 & 127, head & 0xFFFFFF
        if (first and (kind, size) != (0, 34)) or pos + 4 + size > len(data):
            return None
        if first:
            least, samples = int.from_bytes(data[pos + 8 : pos + 11], "big"), int.from_bytes(data[pos + 17 : pos + 22], "big") & 0xFFFFFFFFF
        pos, first = pos + 4 + size, False
    held, header = 0, _flac_header(data, pos)
    while header:
        begin, (end, size) = pos, header
        held, check, pos, header = held + size, 0, 0, None
        for k in range(begin, len(data)):
            check = (check << 8 & 0xFF00) ^ _CRC16[check >> 8 ^ data[k]]
            if check == 0 and k + 1 > end + 2 and k + 1 - begin >= least:
                following = _flac_header(data, k + 1)
                if following if samples and held < samples else following or not samples or held >= samples:
                    pos, header = k + 1, None if samples and held >= samples else following
                    break
        if not pos:
            return None
    return pos if held and held >= samples else None


def _ogg(cell: Cell, at: int) -> int | None:
    """The end of the page that ends the stream which begins at ``at``; the walk from a page is remembered."""
    data, pos, walked = cell.data, at, []
    if data[at + 5 : at + 6] and not data[at + 5] & 2:
        return None
    end: int | None = None
    while data[pos : pos + 5] == b"OggS\0" and pos + 27 <= len(data):
        if pos in cell.pages:
            end = cell.pages[pos]
            break
        walked.append(pos)
        count = data[pos + 26]
        stop = pos + 27 + count + sum(data[pos + 27 : pos + 27 + count])
        if data[pos + 5] & 4:
            end = stop if stop <= len(data) else None
            break
        pos = stop
    cell.pages.update(dict.fromkeys(walked, end))
    return end


def _au(data: bytes, at: int) -> int | None:
    if at + 24 > len(data):
        return None
    head, size, code, rate, channels = struct.unpack_from(">IIIII", data, at + 4)
    return at + head + size if head >= 24 and 1 <= code <= 27 and rate and 0 < channels < 256 and at + head + size <= len(data) else None


def _midi(data: bytes, at: int) -> int | None:
    if at + 14 > len(data) or struct.unpack_from(">I", data, at + 4)[0] != 6:
        return None
    tracks, pos = struct.unpack_from(">H", data, at + 10)[0], at + 14
    for _ in range(tracks):
        if data[pos : pos + 4] != b"MTrk" or pos + 8 > len(data):
            return None
        pos += 8 + struct.unpack_from(">I", data, pos + 4)[0]
    return pos if tracks and pos <= len(data) else None


def _mp4(data: bytes, at: int) -> int | None:
    pos, kinds = at, []
    while pos + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, pos)
        if size == 1 and pos + 16 <= len(data):
            size = struct.unpack_from(">Q", data, pos + 8)[0]
            size = size if size >= 16 else 0
        if size < 8 or pos + size > len(data) or not kind.isalnum():
            break
        kinds.append(kind)
        pos += size
    return pos if kinds[:1] == [b"ftyp"] and (b"moov" in kinds or b"mdat" in kinds) else None


def _pdf(cell: Cell, at: int) -> int | None:
    end, table = cell.after(b"%%EOF", at), cell.after(b"startxref", at)
    return end + 5 if end is not None and table is not None and table < end and cell.data[at + 5 : at + 6].isdigit() else None


def _zip(cell: Cell, at: int) -> int | None:
    """The end of the archive whose directory says that it begins at ``at``."""
    if cell.archives is None:
        cell.archives = {}
        for end in cell.marks[b"PK\x05\x06"]:
            if end + 22 <= len(cell.data):
                size, offset, note = struct.unpack_from("<IIH", cell.data, end + 12)
                if end + 22 + note <= len(cell.data):
                    cell.archives.setdefault(end - size - offset, end + 22 + note)
    return cell.archives.get(at)


def _gzip(data: bytes, at: int) -> int | None:
    stream, view, pos = zlib.decompressobj(31), memoryview(data), at
    try:
        while not stream.eof and pos < len(data):
            rest, pos = view[pos : pos + 65536], min(pos + 65536, len(data))
            while rest and not stream.eof:
                stream.decompress(rest, 1 << 20)
                rest = stream.unconsumed_tail
    except zlib.error:
        return None
    return pos - len(stream.unused_data) if stream.eof else None


def _plain(check: Callable[..., int | None], *more) -> Callable[[Cell, int], int | None]:
    return lambda cell, at: check(cell.data, at, *more)


VALIDATORS: dict[str, Callable[[Cell, int], int | None]] = {
    "image/png": _plain(_png),
    "image/jpeg": _plain(_jpeg),
    "image/gif": _plain(_gif),
    "image/bmp": _plain(_bmp),
    "image/webp": _plain(_riff, b"WEBP"),
    "audio/wav": _plain(_riff, b"WAVE"),
    "video/x-msvideo": _plain(_riff, b"AVI "),
    "audio/flac": _plain(_flac),
    "audio/ogg": _ogg,
    "audio/basic": _plain(_au),
    "audio/midi": _plain(_midi),
    "video/mp4": _plain(_mp4),
    "application/pdf": _pdf,
    "application/zip": _zip,
    "application/gzip": _plain(_gzip),
}


def automaton():
    """Aho-Corasick over all magic bytes and marks; bytes stand as the characters of the same number."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for magic, back, kind in SIGNATURES:
        out.add_word(magic.decode("latin-1"), (len(magic), back, kind))
    for mark in MARKS:
        out.add_word(mark.decode("latin-1"), (len(mark), 0, mark))
    out.make_automaton()
    return out


def sniff(data: bytes, machine) -> list[tuple[str, int, int]]:
    """Every confirmed medium in ``data`` as (type, start, end), by start; one that fails its validator is none."""
    cell, starts, found = Cell(data), [], set()
    for last, (size, back, kind) in machine.iter(data.decode("latin-1")):
        start = last + 1 - size - back
        if isinstance(kind, bytes):
            cell.marks[kind].append(start)
        elif start >= 0:
            starts.append((kind, start))
    for kind, start in starts:
        try:
            end = VALIDATORS[kind](cell, start)
        except (struct.error, IndexError):
            end = None
        if end is not None:
            found.add((kind, start, end))
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def wav_bytes(payload: bytes, rate: int = 8000) -> bytes:
    """One channel of unsigned 8-bit samples."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def wav_samples(data: bytes, start: int, end: int) -> tuple[bytes, int, int] | None:
    """The samples, rate and bits of a WAV file at ``start``."""
    pos, rate, bits = start + 12, 0, 0
    while pos + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, pos)
        if kind == b"fmt ":
            rate, bits = struct.unpack_from("<I", data, pos + 12)[0], struct.unpack_from("<H", data, pos + 22)[0]
        elif kind == b"data":
            return data[pos + 8 : pos + 8 + size], rate, bits
        pos += 8 + size + (size & 1)
    return None


@dataclass(frozen=True)
class MediaParams:
    block: int = 64
    declared: str = "application/octet-stream"


def text_media(docs: DataFrame, params: MediaParams = MediaParams()) -> DataFrame:
    """Store each text of ``docs(doc_id, text, ...)`` as a medium: ``doc_id, n_bytes, declared, media``.

    The payload is the text in UTF-8 (null: empty), followed by zero bytes up to a positive multiple of ``block``.
    Repeated rows each get a medium; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                raw = [b"" if t is None else t.encode() for t in part.column(1).to_pylist()]
                made = [wav_bytes(r + b"\0" * (-len(r) % params.block if r else params.block)) for r in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([params.declared] * len(raw)), pa.array(made, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_bytes long, declared string, media binary")


SNIFFED = "actual string, corrected boolean, payload binary, rate int, bits int, parts array<struct<type:string,start:long,end:long>>"


def sniff_media(table: DataFrame, media: str = "media", declared: str = "declared", finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str | None = None) -> DataFrame:
    """Confirm what a binary column really holds.

    Adds ``actual`` (the confirmed type of the medium that begins at byte 0, else application/octet-stream),
    ``corrected`` (whether that differs from ``declared``), ``payload`` (a WAV file's samples, else the medium),
    ``rate, bits`` (of samples) and ``parts``: every confirmed medium inside, by start, as byte ranges to carve.

    Null and empty cells have no parts; repeated rows each get a row; cells of any length are read whole; parts that begin
    together (ties) go by length, longest first, then type; an empty table gives no rows; columns of the added names are
    replaced; magic bytes without the structure and lengths
    of their format count for nothing.  ``finish`` maps output batches inside the task, for callers that keep only
    digests of the payload.
    """
    table = table.drop("actual", "corrected", "payload", "rate", "bits", "parts")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = []
                for data, said in zip(part.column(media).to_pylist(), part.column(declared).to_pylist()):
                    data = data or b""
                    parts = sniff(data, machine)
                    whole = next((p for p in parts if p[1] == 0), None)
                    actual = whole[0] if whole else "application/octet-stream"
                    samples = wav_samples(data, 0, whole[2]) if actual == "audio/wav" else None
                    payload, rate, bits = samples or (data[: whole[2]] if whole else data, None, None)
                    rows.append((actual, actual != said, payload, rate, bits, [{"type": a, "start": b, "end": c} for a, b, c in parts]))
                kinds = (pa.string(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), kind)
                new = [pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]
                out = pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "actual", "corrected", "payload", "rate", "bits", "parts"])
                yield finish(out) if finish else out

    return map_arrow(table, run, schema or ", ".join([*fields, SNIFFED]))


def stored(table: DataFrame) -> DataFrame:
    """The media table written to shared storage and read back."""
    return settle(table, "media")
