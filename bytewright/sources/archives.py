"""Containers as rows: gzip contents, ZIP entries, PNG chunks, JPEG segments; and ZIP archives from rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import containers, jpeg, png
from ..runtime import map_arrow, ship


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=names)


#: What broken input raises in a codec; all become rows with an error.
BROKEN = (ValueError, zlib.error, struct.error, IndexError, KeyError, EOFError, OverflowError)
_BATCH_ROWS, _BATCH_BYTES = 4096, 4 << 20


def _each(files: DataFrame, key: str, content: str, one, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """Rows that ``one`` makes of each cell's bytes; an error is a row with ``error`` set.  Batches are bounded in rows and
    bytes."""
    names = [key, *(n for n, _, _ in fields), "error"]
    kinds = [pa.string(), *(k for _, _, k in fields), pa.string()]
    wide = [c for c, k in enumerate(kinds) if pa.types.is_binary(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for name, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    made = [(name, *r, None) for r in one(cell.as_py() or b"")]
                except BROKEN as e:
                    made = [(name, *[None] * len(fields), str(e) or type(e).__name__)]
                rows += made
                held += sum(len(r[c] or b"") for r in made for c in wide)
                if len(rows) >= _BATCH_ROWS or held >= _BATCH_BYTES:
                    yield _rows(names, kinds, rows)
                    rows, held = [], 0
            if rows:
                yield _rows(names, kinds, rows)

    schema = ", ".join([f"{key} string", *(f"{n} {t}" for n, t, _ in fields), "error string"])
    return map_arrow(files.selectExpr(f"cast({key} AS string) AS {key}", content), run, schema)


def gzip_contents(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``content`` and ``members`` of each gzip file; truncated and corrupt files have an error."""

    def one(data: bytes):
        body, members = containers.gunzip(data)
        yield body, len(members), members[0].name, members[0].mtime

    return _each(files, key, content, one, [("content", "binary", pa.binary()), ("members", "int", pa.int32()), ("name", "string", pa.string()), ("mtime", "long", pa.int64())])


def zip_entries(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """One row per archive entry, by local offset."""

    def one(data: bytes):
        for e in containers.zip_entries(data)[0]:
            body = containers.zip_content(e)
            yield e.name.decode("utf-8", "replace"), e.method, e.encrypted, e.crc32, e.compressed_size, e.size, e.offset, body is not None

    kinds = [("name", "string", pa.string()), ("method", "int", pa.int32()), ("encrypted", "boolean", pa.bool_()), ("crc32", "long", pa.int64()), ("compressed_size", "long", pa.int64()), ("size", "long", pa.int64()), ("offset", "long", pa.int64()), ("intact", "boolean", pa.bool_())]
    return _each(files, key, content, one, kinds)


def png_chunks(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """One row per chunk: place, type, length, checksum, and the position group."""

    def one(data: bytes):
        all_chunks = png.chunks(data)
        for k, (c, group) in enumerate(zip(all_chunks, png.position_group(all_chunks))):
            yield k, c.kind.decode("latin-1"), len(c.data), c.crc_ok, c.ancillary, group

    kinds = [("idx", "int", pa.int32()), ("type", "string", pa.string()), ("length", "long", pa.int64()), ("crc_ok", "boolean", pa.bool_()), ("ancillary", "boolean", pa.bool_()), ("pos_group", "int", pa.int32())]
    return _each(files, key, content, one, kinds)


def png_frames(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """One row per file: first and last chunk, whether all checksums hold, and the stored scanlines."""

    def one(data: bytes):
        found = png.chunks(data)
        yield found[0].kind.decode("latin-1"), found[-1].kind.decode("latin-1"), all(c.crc_ok for c in found), len(png.filter_types(data))

    return _each(files, key, content, one, [("first", "string", pa.string()), ("last", "string", pa.string()), ("checked", "boolean", pa.bool_()), ("lines", "long", pa.int64())])


def png_idat_sizes(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """The bytes of compressed pixels in each file, whatever the number of chunks."""
    return png_chunks(files, key, content).where("type = 'IDAT'").groupBy(key).agg(F.sum("length").alias("idat"), F.count("*").alias("n_chunks"))


def png_filter_types(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """One row per stored scanline with its filter type."""
    return _each(files, key, content, lambda data: enumerate(png.filter_types(data)), [("y", "int", pa.int32()), ("filter_type", "int", pa.int32())])


def jpeg_segments(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """One row per marker segment, and the orientation the file states."""

    def one(data: bytes):
        orientation = containers.exif_orientation(data)
        for k, (marker, body) in enumerate(containers.jpeg_segments(data)):
            yield k, marker, len(body), orientation

    return _each(files, key, content, one, [("idx", "int", pa.int32()), ("marker", "int", pa.int32()), ("length", "long", pa.int64()), ("orientation", "int", pa.int32())])


def png_texts(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """One row per text chunk: place, type, keyword, language, translated keyword, text, and whether it is compressed."""

    def one(data: bytes):
        for k, t in enumerate(png.texts(data)):
            yield k, t.kind.decode("latin-1"), t.keyword, t.language, t.translated, t.text, t.compressed

    text = [(n, "string", pa.string()) for n in ("type", "keyword", "language", "translated", "text")]
    return _each(files, key, content, one, [("idx", "int", pa.int32()), *text, ("compressed", "boolean", pa.bool_())])


def jpeg_coefficients(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """One row per block that holds part of the image: component, block row and column, and its 64 coefficients along the
    zigzag."""

    def one(data: bytes):
        for c in jpeg.read(data).components:
            for y in range(c.size[0]):
                for x in range(c.size[1]):
                    yield c.name, y, x, c.blocks[y, x].tolist()

    return _each(files, key, content, one, [("component", "int", pa.int32()), ("y", "int", pa.int32()), ("x", "int", pa.int32()), ("coefficients", "array<int>", pa.list_(pa.int32()))])


def build_zips(entries: DataFrame, archive: str, name: str, content: str, level: int = 3) -> DataFrame:
    """One ZIP archive per group: ``archive, n_entries, zip``.  An archive is one task's work, as its format is one
    file; groups are the caller's choice of archives."""
    ship(entries.sparkSession)

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("name").to_pylist(), table.column("content").to_pylist()))
        made = containers.zip_create([(n, c or b"") for n, c in rows], level=level)
        return pa.table({"archive": pa.array([table.column("archive")[0].as_py()], pa.string()), "n_entries": pa.array([len(rows)], pa.int64()), "zip": pa.array([made], pa.binary())})

    picked = entries.selectExpr(f"cast({archive} AS string) AS archive", f"cast({name} AS string) AS name", f"cast({content} AS binary) AS content")
    return picked.groupBy("archive").applyInArrow(build, "archive string, n_entries long, zip binary")
