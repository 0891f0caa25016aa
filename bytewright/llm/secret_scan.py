"""Secret scans with a recursive decoding worklist."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..runtime import map_arrow
from .textkit import slices

#: The kinds in their listed order.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

# What a text must hold before anything is tried on it; RE2 reads whole batches with these.
_MAY_MATCH = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
_MAY_ESCAPE = r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f]{2}|&#[xX]?[0-9A-Fa-f]+;"
_MAY_RUN = r"[A-Za-z0-9+/_-]{16}"

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8})+|&#(?:[0-9]+|[xX][0-9A-Fa-f]+);")
_ESCAPED = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, all but the last of one length.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*+\r?\n[ \t]*+)+[A-Za-z0-9+/_-]++={0,2}(?![:=])")
_BLANK = re.compile(r"[ \t\r\n]+")
# How gzip, zlib, bzip2 and xz streams begin.
_MAGIC = re.compile("\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
_WIDE = re.compile("[^\x00-\xff]")
#: No pattern crosses one of these, so a long layer may be cut after it; the second choice is the end of a line.
_CUT = re.compile(r"[^A-Za-z0-9+/_.=:\"'%\\&#;\x20\r\n\t\x80-\xff-]".encode("latin-1"))


@dataclass(frozen=True)
class SecretParams:
    """Unpacked content is scanned in layers of about ``layer_bytes``, cut where no pattern can cross."""

    layer_bytes: int = 16 << 20


@dataclass
class Layer:
    """A decoded text; character k stands for the root's characters ``start[k]`` to ``end[k]`` (None: itself).

    ``place`` is set instead where all characters stand for one range.
    """

    text: str
    start: np.ndarray | None = None
    end: np.ndarray | None = None
    place: tuple[int, int] | None = None

    @property
    def root(self) -> bool:
        return self.start is None and self.place is None

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.place is not None:
            return self.place
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[b - 1]))

    def bounds(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Root starts and ends of the characters from ``a`` to ``b``."""
        if self.place is not None:
            return np.full(b - a, self.place[0], np.int32), np.full(b - a, self.place[1], np.int32)
        if self.start is None:
            at = np.arange(a, b, dtype=np.int32)
            return at, at + 1
        return self.start[a:b], self.end[a:b]


def _may(text: str, pattern: str) -> bool:
    """Whether a text can match; long ones are read by RE2 first, which is many times faster where nothing is found."""
    return len(text) < 4096 or pc.match_substring_regex(pa.scalar(text, pa.large_string()), pattern).as_py()


def matches(text: str) -> list[tuple[str, int, int]]:
    """The base spans of a text: per kind leftmost and non-overlapping, without those that fail its length."""
    out: list[tuple[str, int, int]] = []
    if _may(text, r"(?i:password|passwd|secret|token|api_?key)"):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _may(text, r"[0-9a-f]{32}"):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every run of ``pattern`` decoded in place; ``decode`` gives (characters, width in the run)."""
    parts, starts, ends, last = [], [], [], 0
    for m in pattern.finditer(layer.text):
        pieces = decode(m.group())
        if pieces is None:
            continue
        if layer.place is None:
            s, e = layer.bounds(last, m.start())
            starts.append(s)
            ends.append(e)
            edges = m.start() + np.cumsum([0] + [w for _, w in pieces])
            counts = [len(c) for c, _ in pieces]
            first, final = (edges[:-1], edges[1:]) if layer.start is None else (layer.start[edges[:-1]], layer.end[edges[1:] - 1])
            starts.append(np.repeat(first, counts).astype(np.int32))
            ends.append(np.repeat(final, counts).astype(np.int32))
        parts.append(layer.text[last : m.start()])
        parts += [c for c, _ in pieces]
        last = m.end()
    if not last:
        return None
    text = "".join([*parts, layer.text[last:]])
    if layer.place is not None:
        return Layer(text, place=layer.place)
    s, e = layer.bounds(last, len(layer.text))
    return Layer(text, np.concatenate([*starts, s]), np.concatenate([*ends, e]))


def _percent(run: str) -> list[tuple[str, int]]:
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        return [(c, 3 * len(c.encode())) for c in raw.decode()]
    except UnicodeDecodeError:
        return [(chr(b), 3) for b in raw]


def _percent_bytes(run: str) -> list[tuple[str, int]]:
    return [(chr(b), 3) for b in bytes.fromhex(run.replace("%", ""))]


def _escape(run: str) -> list[tuple[str, int]] | None:
    if run[0] == "&":
        digits = run[3:-1] if run[2] in "xX" else run[2:-1]
        digits = digits.lstrip("0") or "0"
        code = int(digits, 16 if run[2] in "xX" else 10) if len(digits) < 9 else 0
        return [(chr(code), len(run))] if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    out: list[tuple[str, int]] = []
    high: tuple[int, int] | None = None
    for m in _ESCAPED.finditer(run):
        code = int(m.group(1) or m.group(2) or m.group(3), 16)
        width = m.end() - m.start()
        if high and 0xDC00 <= code < 0xE000:
            out[-1] = (chr(0x10000 + ((high[0] - 0xD800) << 10) + code - 0xDC00), high[1] + width)
            high = None
            continue
        high = (code, width) if 0xD800 <= code < 0xDC00 else None
        out.append((chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�", width))
    return out


def _decoder(head: bytes):
    if head[:1] == b"B":
        return bz2.BZ2Decompressor()
    if head[:1] == b"\xfd":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ)
    return zlib.decompressobj(47)


def _inflated(raw: bytes, at: int, size: int) -> Iterator[tuple[bytes, int, bool]]:
    """Parts of the stream at ``at``, each with where reading stands, and whether the stream has ended there.  A stream
    that breaks ends without saying so."""
    stream, fed = _decoder(raw[at : at + 6]), at
    tail = b""
    try:
        while not stream.eof:
            more = tail
            if not more and getattr(stream, "needs_input", True):
                more, fed = raw[fed : fed + 4096], min(fed + 4096, len(raw))
            part = stream.decompress(more, size)
            tail = getattr(stream, "unconsumed_tail", b"")
            if not more and not part:
                return
            yield part, fed - len(stream.unused_data), stream.eof
    except (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError):
        return


def _unpacked(raw: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """The content of the compressed streams that ``raw`` begins with, in parts of about ``size`` bytes, and how many bytes
    of ``raw`` were read by then.  A stream that breaks gives what came before the break."""
    at, held, upto, ended = 0, bytearray(), 0, True
    while ended and _MAGIC.match(raw[at : at + 10].decode("latin-1")):
        ended, tried = False, 0
        for part, upto, ended in _inflated(raw, at, size):
            held += part
            # A part that could not be cut is tried again when it has doubled.
            while len(held) >= max(size, 2 * tried):
                cut = _cut(held, size)
                tried = 0 if cut else len(held)
                if cut:
                    yield bytes(held[:cut]), upto
                    del held[:cut]
        if upto <= at:
            break
        at = upto
    if held:
        yield bytes(held), upto


def _cut(data: bytes | bytearray, size: int) -> int:
    """Where a part of about ``size`` bytes may end, or 0."""
    for m in _CUT.finditer(data, size // 2):
        return m.end()
    return data.rfind(b"\n") + 1


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _base64(body: str) -> bytes | None:
    body = body.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    """The content of base64 runs, also of runs over several lines."""
    for pattern in (_RUN, _WRAPPED):
        for m in pattern.finditer(layer.text):
            body = m.group()
            if pattern is _WRAPPED:
                lines = _BLANK.split(body)
                if len({len(x) for x in lines[:-1]}) > 1 or len(lines[-1]) > len(lines[0]):
                    continue
                body = "".join(lines)
            raw = _base64(body)
            if not raw:
                continue
            text = _text(raw)
            if layer.place is not None:
                yield Layer(text, place=layer.place)
                continue
            s, e = layer.bounds(m.start(), m.end())
            if pattern is _WRAPPED:
                solid = np.array([c not in " \t\r\n" for c in m.group()])
                s, e = s[solid], e[solid]
            # Three bytes come from four characters; a character may be several bytes.
            k = np.arange(len(raw))
            first = k // 3 * 4 + k % 3
            if len(text) < len(raw):
                lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                stop = np.append(lead[1:], len(raw)) - 1
            else:
                lead = stop = k
            yield Layer(text, s[first[lead]], e[np.minimum(first[stop] + 1, len(body.rstrip("=")) - 1)])


def _unpacked_layers(layer: Layer, p: SecretParams) -> Iterator[Layer]:
    """The content of compressed streams in a layer whose characters are bytes."""
    read = 0
    for m in _MAGIC.finditer(layer.text):
        if m.start() < read:
            continue
        wide = _WIDE.search(layer.text, m.start())
        raw = layer.text[m.start() : wide.start() if wide else len(layer.text)].encode("latin-1")
        for part, used in _unpacked(raw, p.layer_bytes):
            read = m.start() + used
            yield Layer(_text(part), place=layer.span(m.start(), read))


def scan(text: str, p: SecretParams = SecretParams()) -> list[tuple[str, int, int, bool]]:
    """All spans of a text as (kind, start, end, base), by start and listed kind.

    Layers wait on a worklist; each is scanned, and its URL escapes, Unicode escapes, base64 runs and compressed
    streams give new layers, until none is new.  A layer already seen at the same place is not taken up again.
    """
    base = set(matches(text))
    found = set(base)
    work: list[Iterator[Layer]] = [iter([Layer(text)])]
    seen: set[tuple] = set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        place = (0, len(text)) if not layer.text else layer.span(0, len(layer.text))
        mark = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), place)
        if mark in seen:
            continue
        seen.add(mark)
        if not layer.root:
            found.update((kind, *layer.span(a, b)) for kind, a, b in matches(layer.text))
        work.append(_inner(layer, p))
    return [(*x, x in base) for x in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))]


def _inner(layer: Layer, p: SecretParams) -> Iterator[Layer]:
    """The layers inside a layer, one at a time."""
    text = layer.text
    steps = [(_PERCENT, _percent), (_PERCENT, _percent_bytes)] if "%" in text else []
    if "\\" in text or "&#" in text:
        steps.append((_ESCAPE, _escape))
    for pattern, decode in steps:
        inner = _replaced(layer, pattern, decode)
        if inner is not None:
            yield inner
    if _may(text, _MAY_RUN):
        yield from _base64_layers(layer)
    if not layer.root:
        yield from _unpacked_layers(layer, p)


def candidates(texts: pa.Array) -> np.ndarray:
    """Which texts can hold a base span or a layer; the others need no scan."""
    return pc.match_substring_regex(texts, f"{_MAY_MATCH}|{_MAY_ESCAPE}|{_MAY_RUN}").to_numpy(zero_copy_only=False)


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def scan_secrets(docs: DataFrame, params: SecretParams = SecretParams(), redact: bool = False) -> DataFrame:
    """Add ``secrets``, an array of (kind, start, end, base) in code points, to ``docs(text, ...)``.

    Base spans are those of the text itself; the others lie in decoded layers and cover the characters they were
    decoded from.  With ``redact`` the spans are replaced by ``[secret]`` in ``text`` (``n_chars`` follows, where
    there is one).  Null and empty texts have no spans; repeated rows each get theirs; texts and layers of any length are
    scanned whole; spans that begin together (ties) go by listed kind, then end; an empty table gives no rows; other
    columns pass through, but for ``secrets``, which is replaced.
    """
    docs = docs.drop("secrets")
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"secrets {SPANS}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(at)):
                part = batch.slice(i, j - i)
                texts = part.column(at).fill_null("")
                rows: list[list[dict]] = [[] for _ in range(j - i)]
                changed: dict[int, str] = {}
                for k in np.flatnonzero(candidates(texts)).tolist():
                    text = texts[k].as_py()
                    spans = scan(text, params)
                    rows[k] = [{"kind": a, "start": b, "end": c, "base": d} for a, b, c, d in spans]
                    if redact and spans:
                        changed[k] = redacted(text, [(b, c) for _, b, c, _ in spans])
                columns = list(part.columns)
                if changed:
                    columns[at] = pa.array([changed.get(k, t) for k, t in enumerate(columns[at].to_pylist())], columns[at].type)
                    if size is not None:
                        columns[size] = pa.array([len(changed[k]) if k in changed else n for k, n in enumerate(columns[size].to_pylist())], columns[size].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, _SPAN_TYPE)], names=[*part.schema.names, "secrets"])

    return map_arrow(docs, run, schema)


def redacted(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each run of overlapping spans replaced."""
    out, last = [], 0
    for a, b in sorted(spans):
        if b <= last:
            continue
        if a >= last:
            out += [text[last:a], "[secret]"]
        last = b
    return "".join([*out, text[last:]])
