"""WARC archives: writing with revisit records, and reading in ranges by boundary-chain verification."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import map_arrow, ship
from .common import discard, remove, scratch_path, settle
from .textkit import text_buffers

# How a record begins, and what ends a header and a record.
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
_BEGIN = re.compile(rb"WARC/1\.[01]\r\n")
_END = b"\r\n\r\n"


@dataclass(frozen=True)
class WarcParams:
    """Payloads of at least ``least_revisit`` bytes are stored once.  An archive written here has at most ``archive_bytes``
    of records (a larger record has its own); archives are read in ranges of about ``range_bytes``."""

    least_revisit: int = 0
    archive_bytes: int = 64 << 20
    range_bytes: int = 4 << 20
    date: str = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in base32, from 20-bit pieces of its hexadecimal form."""
    letters, digest = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.sha1(payload)
    pieces = [F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(letters, F.shiftright(p, s).bitwiseAND(31) + 1, F.lit(1)) for p in pieces for s in (15, 10, 5, 0)])


def _page_rows(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    return rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": base32_sha1(F.col("html").cast("binary"))})


def payload_groups(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """``digest, size, first`` of each payload that several pages have, as a table: only ids and digests are aggregated."""
    rows = _page_rows(pages).where(F.col("size") >= params.least_revisit)
    groups = rows.groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    return settle(groups.where("n > 1").drop("n"), "warc-groups")


def warc_records(pages: DataFrame, groups: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """One record text per row of ``pages(page_id, url, html, ...)``, in the column ``record``.

    Of equal payloads of at least ``least_revisit`` bytes the largest page_id is a response and the others revisit
    it.  As ``groups`` (of ``payload_groups``) is a table, AQE can split the partition of a payload that a third of all
    pages share.
    """
    p = params
    rows = _page_rows(pages)
    named = rows.join(groups, ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    url = F.regexp_replace("url", r"[\x00-\x1F\x7F]", "")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        urn(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {p.date}\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("first")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block),
        F.lit("\r\n\r\n"),
    )
    return named.select(F.concat(head, block).alias("record"))


def _archives(p: WarcParams):
    """Number the archives of a task so that none holds more than its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            _, offsets = text_buffers(batch.column(0))
            names = np.empty(batch.num_rows, np.int64)
            for k, size in enumerate((np.diff(offsets) + len(_END)).tolist()):
                if held and held + size > p.archive_bytes:
                    number, held = number + 1, 0
                names[k] = number
                held += size
            yield pa.RecordBatch.from_arrays([pa.array(names), batch.column(0)], names=["archive", "record"])

    return run


def write_warc(pages: DataFrame, path: str, params: WarcParams = WarcParams()) -> None:
    """Write archives below ``path`` on any file system Spark reaches.

    A record ends with two CRLF, which is the text sink's line separator, so a part file is an archive as it is,
    compressed as a whole with gzip.
    """
    groups = payload_groups(pages, params)
    records = map_arrow(warc_records(pages, groups, params), _archives(params), "archive long, record string")
    records.write.partitionBy("archive").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    discard(groups)


def _plain(data: bytes) -> Iterator[bytes]:
    """The content of an archive, in parts; it may be compressed as a whole or record by record."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        for k in range(0, len(view), 1 << 20):
            yield bytes(view[k : k + (1 << 20)])
        return
    stream, rest, at = zlib.decompressobj(31), b"", 0
    while rest or at < len(view):
        if not rest:
            rest, at = bytes(view[at : at + (1 << 18)]), at + (1 << 18)
        try:
            yield stream.decompress(rest, 1 << 20)
        except zlib.error:
            return
        rest = stream.unconsumed_tail
        if stream.eof:
            rest, stream = stream.unused_data, zlib.decompressobj(31)


def _fields(head: bytes) -> dict[bytes, bytes]:
    lines = head.split(b"\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}


def _page(urn: bytes | None) -> int | None:
    text = (urn or b"").removeprefix(b"<urn:x-page:").removesuffix(b">")
    return int(text) if text.lstrip(b"-").isdigit() else None


class _Cutter:
    """Cuts the content of an archive into ranges.  A range may end anywhere but inside what looks like a record's
    header, so a task that has a range sees the headers that begin in it whole."""

    def __init__(self, size: int):
        self.size, self.held, self.start, self.behind, self.read = size, bytearray(), 0, b"", 0

    def _end(self) -> int | None:
        """Where the range that is held can end."""
        if len(self.held) < self.size + 16:
            return None
        cut = self.size
        last = self.held.rfind(_END, 0, cut)
        begin = last + 4 if last >= 0 else 0 if self.behind == _END or not self.start else None
        head = bytes(self.held[begin : min(begin + 10, cut)]) if begin is not None else b""
        if not head or not any(v.startswith(head) for v in VERSIONS):
            return cut
        found = self.held.find(_END, max(cut - 3, self.read, begin))
        self.read = max(len(self.held) - 3, 0)
        return found + 4 if found >= 0 else None

    def add(self, part: bytes, last: bool = False) -> Iterator[tuple[int, bytes, bytes]]:
        self.held += part
        while (cut := self._end()) is not None or last and self.held:
            cut = len(self.held) if cut is None else cut
            data = bytes(self.held[:cut])
            del self.held[:cut]
            yield self.start, self.behind, data
            self.start, self.behind, self.read = self.start + cut, (self.behind + data)[-4:], 0


def _ranges(p: WarcParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                cutter = _Cutter(p.range_bytes)
                for part in _plain(cell.as_buffer().to_pybytes()):
                    yield from (_one(archive, *r) for r in cutter.add(part))
                yield from (_one(archive, *r) for r in cutter.add(b"", last=True))

    return run


RANGE = "archive string, start long, behind binary, data binary"


def _one(archive: str, start: int, behind: bytes, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([start]), pa.array([behind], pa.binary()), pa.array([data], pa.binary())], names=["archive", "start", "behind", "data"])


# A link is a candidate (kind ``whole`` or, where its payload crosses a border, ``cross``) or a ``range`` itself.
LINK = "archive string, kind string, offset long, successor long, block long, start long, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, said string"
_NAMES = [x.split()[0] for x in LINK.split(", ")]
_KINDS = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in LINK.split(", ")]


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(_KINDS)], names=_NAMES)


def _payload(kind: str, http: dict[bytes, bytes], said: str, size: int, digest: bytes) -> tuple[int, str]:
    """Size and digest of a record's full payload: its own, or those a revisit states."""
    if kind == "revisit":
        stated = http.get(b"content-length", b"")
        return int(stated) if stated.isdigit() else size, said
    return size, base64.b32encode(digest).decode()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every place in a range that looks like the start of a record, with where that record would end."""
    for batch in batches:
        for archive, start, behind, cell in zip(*(batch.column(c).to_pylist() for c in range(4))):
            data, base = behind + cell, start - len(behind)
            rows: list[tuple] = [(archive, "range", start, start + len(cell), None, start, *[None] * 7)]
            for m in _BEGIN.finditer(data, len(behind)):
                at = m.start()
                # Headers that follow two CRLF do not overlap, so the search for their ends is linear.
                head = data.find(_END, m.end() - 2) if base + at == 0 or data[at - 4 : at] == _END else -1
                f = _fields(data[m.end() : head]) if head >= 0 else {}
                length = f.get(b"content-length", b"")
                if not length.isdigit() or len(length) > 15:
                    continue
                block, stop = head + 4, head + 4 + int(length)
                kind, said = f.get(b"warc-type", b"").decode("latin-1"), f.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
                size: int | None = None
                digest: str | None = None
                whole = stop + 4 <= len(data)
                if whole:
                    if data[stop : stop + 4] != _END:
                        continue
                    inner = data.find(_END, block, stop)
                    body = memoryview(data)[inner + 4 if inner >= 0 else block : stop]
                    size, digest = _payload(kind, _fields(data[block:inner]) if inner >= 0 else {}, said, len(body), hashlib.sha1(body).digest())
                url = f.get(b"warc-target-uri", b"").decode("utf-8", "replace")
                rows.append((archive, "whole" if whole else "cross", base + at, base + stop + 4, base + block, start, _page(f.get(b"warc-record-id")), kind, _page(f.get(b"warc-refers-to")), url, size, digest, said))
                if len(rows) >= 1024:
                    yield _batch_of(rows)
                    rows = []
            yield _batch_of(rows)


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 visits, by pointer jumping: log2(n) rounds over whole arrays."""
    order = np.argsort(offsets, kind="stable")
    ranked, n = offsets[order], len(offsets)
    jump = np.full(n + 1, n)
    at = np.searchsorted(ranked, successors[order])
    hit = (at < n) & (ranked[np.minimum(at, n - 1)] == successors[order])
    jump[:n][hit] = at[hit]
    seen = np.zeros(n + 1, dtype=bool)
    seen[0] = n > 0 and ranked[0] == 0
    for _ in range(max(n, 1).bit_length()):
        seen[jump[seen]] = True
        jump = jump[jump]
    out = np.zeros(n, dtype=bool)
    out[order] = seen[:n]
    return out


def _chain(table: pa.Table) -> pa.Table:
    """The reachable candidates of an archive; for those that cross borders also a row, of kind ``piece``, per range."""
    is_range = pc.equal(table.column("kind"), "range")
    ranges, found = table.filter(is_range), table.filter(pc.invert(is_range))
    starts = np.sort(ranges.column("start").to_numpy())
    size = int(pc.max(ranges.column("successor")).as_py())
    found = found.filter(pc.less_equal(found.column("successor"), size))
    found = found.filter(pa.array(reachable(found.column("offset").to_numpy(), found.column("successor").to_numpy())))
    cross = found.filter(pc.equal(found.column("kind"), "cross"))
    block, stop = cross.column("block").to_numpy(), cross.column("successor").to_numpy()
    lo = np.searchsorted(starts, block, side="right") - 1
    counts = np.searchsorted(starts, stop, side="left") - lo
    row = np.repeat(np.arange(len(block)), counts)
    piece = lo[row] + np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
    pieces = cross.take(pa.array(row)).set_column(_NAMES.index("kind"), "kind", pa.array(["piece"] * len(row), pa.string()))
    pieces = pieces.set_column(_NAMES.index("start"), "start", pa.array(starts[piece].astype(np.int64) if len(row) else np.zeros(0, np.int64)))
    return pa.concat_tables([found, pieces.cast(found.schema)])


PIECE = "archive string, offset long, start long, stop long, record_type string, said string, data binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a range holds of the blocks that cross its borders, and of the two CRLF after them."""
    names = [x.split()[0] for x in PIECE.split(", ")]
    for batch in batches:
        for archive, start, cell, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            data = cell.as_buffer()
            for w in wanted:
                part = data[max(w["block"] - start, 0) : min(w["successor"] - start, len(data))].to_pybytes()
                values = (archive, w["offset"], start, w["successor"] - 4 - w["block"], w["record_type"], w["said"], part)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()))], names=names)


WHOLE = "archive string, offset long, payload_bytes long, payload_digest string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and digest of payloads whose pieces follow each other, a piece at a time; blocks without their end are none."""
    key, info, head, digest, read, tail = None, None, b"", None, 0, b""

    def finish() -> Iterator[pa.RecordBatch]:
        if key is None or read != info[0] + 4 or tail != _END:
            return
        http, sha = (_fields(head[: head.find(_END)]), digest) if digest is not None else ({}, hashlib.sha1(head))
        first = head.find(_END) + 4 if digest is not None else 0
        size, said = _payload(info[1], http, info[2], info[0] - first, sha.digest())
        values = (*key, size, said)
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=[x.split()[0] for x in WHOLE.split(", ")])

    for batch in batches:
        for archive, offset, stop, kind, said, data in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5, 6))):
            if (archive, offset) != key:
                yield from finish()
                key, info, head, digest, read, tail = (archive, offset), (stop, kind, said), b"", None, 0, b""
            inner = data[: max(stop - read, 0)]
            tail += data[len(inner) :]
            read += len(data)
            if digest is not None:
                digest.update(inner)
                continue
            head += inner
            end = head.find(_END)
            if end >= 0:
                digest = hashlib.sha1(head[end + 4 :])
                head = head[: end + 4]
    yield from finish()


def read_warc(spark: SparkSession, path: str, params: WarcParams = WarcParams()) -> DataFrame:
    """The records of the archives below ``path``, whatever the files are called (names that begin with a dot or an
    underscore are left out, as everywhere in Spark); plain, or gzip as a whole or record by record.

    ``archive, offset, page_id, record_type, refers_to, url, payload_bytes, payload_digest, intact``.  Archives are cut into
    ranges; the tasks that have them emit a link (offset to successor) for each place that parses as a record, whether or
    not it lies inside a payload; per archive, pointer jumping from offset 0 keeps what the chain of lengths reaches.
    Payloads inside a range are digested there; those that cross borders are put together from their pieces.
    Links travel, and the ranges that a border-crossing record touches.  ``intact`` says whether a response's payload
    has the digest it states.  An archive whose chain breaks yields the records before the break; no archive yields no
    rows.  A file must be below 2 GiB as it is stored, which is what a ``binaryFile`` cell holds.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    ranges = map_arrow(files.select(F.col("path").alias("archive"), "content"), _ranges(params), RANGE)
    links = map_arrow(ranges, _links, LINK)
    chain = settle(links.groupBy("archive").applyInArrow(_chain, LINK), "warc-chain")
    wanted = chain.where("kind = 'piece'").groupBy("archive", "start").agg(F.collect_list(F.struct("offset", "block", "successor", "record_type", "said")).alias("wanted"))
    held = ranges.select("archive", "start", "data").join(wanted, ["archive", "start"])
    pieces = map_arrow(held.select("archive", "start", "data", "wanted"), _pieces, PIECE)
    pieces = pieces.repartition("archive", "offset").sortWithinPartitions("archive", "offset", "start")
    whole = settle(map_arrow(pieces, _joined, WHOLE), "warc-crossing")
    columns = ["archive", "offset", "page_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest"]
    inside = chain.where("kind = 'whole'").select(*columns, "said")
    crossing = chain.where("kind = 'cross'").drop("payload_bytes", "payload_digest").join(whole, ["archive", "offset"]).select(*columns, "said")
    return inside.unionAll(crossing).select(*columns, (F.col("payload_digest") == F.col("said")).alias("intact"))


def warc_round_trip(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back.

    One row per page; null html is an empty payload and null urls are empty; rows that repeat the largest page_id of
    a payload (ties) are all responses; a null page_id revisits like any other; urls and payloads of any length are
    stored whole; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, params)
    found = read_warc(spark, path, params)
    remove(spark, path)
    return found


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT page_id, payload_bytes, h, list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS top FROM b
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""
