"""JPEG (ITU-T T.81) without loss: coefficients are decoded, turned or flipped if asked, and coded again.

Sequential and progressive Huffman files of 8 bits are read; both forms are written, with Huffman codes made for each
scan.  Samples are never computed, so nothing is rounded.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np

from .containers import ORIENTATION, FormatError, exif_orientation, jpeg_strip, tries_baseline, tries_progressive
from .huffman import limited_lengths


def _zigzag() -> np.ndarray:
    """Natural place (8 * row + column) of each place along the zigzag."""
    places = sorted(((v, u) for v in range(8) for u in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * v + u for v, u in places])


ZIGZAG = _zigzag()
NATURAL = np.argsort(ZIGZAG)


@dataclass
class Component:
    """``blocks``: (rows, columns, 64) coefficients in zigzag order, padded to whole MCUs; ``size``: rows and columns that
    hold the image."""

    name: int
    h: int
    v: int
    table: int
    size: tuple[int, int] = (0, 0)
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))


@dataclass
class Jpeg:
    """A decoded file: dimensions, quantisation tables (64 values along the zigzag), components and other segments."""

    width: int
    height: int
    tables: dict[int, tuple[int, ...]]
    components: list[Component]
    segments: list[tuple[int, bytes]]
    progressive: bool = False
    tail: bytes = b""

    @property
    def most(self) -> tuple[int, int]:
        """Largest horizontal and vertical sampling factor."""
        return max(c.h for c in self.components), max(c.v for c in self.components)

    def lay_out(self) -> None:
        """Set the sizes of all components, and their blocks where there are none."""
        if len(self.components) == 1:
            self.components[0].h = self.components[0].v = 1
        hm, vm = self.most
        across, down = -(-self.width // (8 * hm)), -(-self.height // (8 * vm))
        for c in self.components:
            c.size = -(-(-(-self.height * c.v // vm)) // 8), -(-(-(-self.width * c.h // hm)) // 8)
            if not c.blocks.size:
                c.blocks = np.zeros((down * c.v, across * c.h, 64), np.int32)


def _order(image: Jpeg, parts: list[Component]) -> Iterator[tuple[int, Component, int, int]]:
    """MCU number, component, block row and column, as a scan of these components stores them."""
    if len(parts) == 1:
        rows, columns = parts[0].size
        for k in range(rows * columns):
            yield k, parts[0], k // columns, k % columns
        return
    hm, vm = image.most
    across, down = -(-image.width // (8 * hm)), -(-image.height // (8 * vm))
    for k in range(across * down):
        y, x = divmod(k, across)
        for c in parts:
            for j in range(c.v):
                for i in range(c.h):
                    yield k, c, y * c.v + j, x * c.h + i


# Reading


class _Bits:
    """Bits of one entropy-coded interval, highest first; what lies past its end is an error."""

    def __init__(self, data: bytes):
        raw = data.replace(b"\xff\x00", b"\xff")
        self.value, self.left, self.size = int.from_bytes(raw, "big"), 8 * len(raw), 8 * len(raw)
        self.raw, self.at = raw, 0

    def take(self, n: int) -> int:
        if self.at + n > self.size:
            raise FormatError("truncated scan")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        self.at += n
        return int.from_bytes(self.raw[first:last], "big") >> (8 * last - self.at) & ((1 << n) - 1)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            found = codes.get((n, code))
            if found is not None:
                return found
        raise FormatError("no such code")

    def signed(self, n: int) -> int:
        """A value of ``n`` bits whose first bit is its sign."""
        if not n:
            return 0
        value = self.take(n)
        return value if value >> (n - 1) else value - (1 << n) + 1


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _intervals(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded intervals from ``at`` on, and where the marker after them stands."""
    out, begin = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise FormatError("truncated scan")
        marker = data[at + 1]
        if 0xD0 <= marker <= 0xD7:
            out.append(data[begin:at])
            begin = at + 2
        elif marker == 0xFF:
            at += 1
            continue
        elif marker:
            return [*out, data[begin:at]], at
        at += 2


def _read_block(bits: _Bits, block: np.ndarray, dc, ac, band: tuple[int, int, int, int], state: dict, name: int) -> None:
    """One block of a scan over the band ``(first, last, high, low)``."""
    first, last, high, low = band
    if first == 0:
        if high:
            block[0] |= bits.take(1) << low
        else:
            state[name] = state.get(name, 0) + bits.signed(bits.symbol(dc))
            block[0] = state[name] << low
        first = 1
    if last == 0:
        return
    if state.get("run"):
        state["run"] -= 1
        if high:
            _refine(bits, block, first, last, 1 << low)
        return
    k = first
    while k <= last:
        run, size = divmod(bits.symbol(ac), 16)
        if size == 0 and run < 15:
            state["run"] = (1 << run) + (bits.take(run) if run else 0) - 1
            if high:
                _refine(bits, block, k, last, 1 << low)
            return
        if not high:
            k += run
            if k > last:
                raise FormatError("coefficient place")
            if size:
                block[k] = bits.signed(size) << low if low == 0 else int(np.sign(value := bits.signed(size))) * (abs(value) << low)
            k += 1
            continue
        value = (1 if bits.take(1) else -1) << low if size == 1 else 0
        while k <= last:
            if block[k]:
                if bits.take(1) and not abs(int(block[k])) & 1 << low:
                    block[k] += (1 << low) if block[k] > 0 else -(1 << low)
            elif run:
                run -= 1
            else:
                break
            k += 1
        if value and k <= last:
            block[k] = value
        k += 1


def _refine(bits: _Bits, block: np.ndarray, first: int, last: int, step: int) -> None:
    """A correction bit for each coefficient that is not zero."""
    for k in range(first, last + 1):
        if block[k] and bits.take(1) and not abs(int(block[k])) & step:
            block[k] += step if block[k] > 0 else -step


def _read_scan(image: Jpeg, body: bytes, data: bytes, at: int, codes: dict, interval: int) -> int:
    """Decode one scan into the blocks; returns the place after it."""
    count = body[0]
    if len(body) != 4 + 2 * count:
        raise FormatError("scan header")
    by_name = {c.name: c for c in image.components}
    try:
        parts = [(by_name[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(count)]
    except KeyError as e:
        raise FormatError("scan component") from e
    first, last, both = body[1 + 2 * count], body[2 + 2 * count], body[3 + 2 * count]
    band = (first, last, both >> 4, both & 15) if image.progressive else (0, 63, 0, 0)
    pieces, end = _intervals(data, at)
    tables = {c.name: (codes.get((0, d)), codes.get((1, a))) for c, d, a in parts}
    bits, state, used = _Bits(pieces[0]), {}, 0
    for mcu, c, y, x in _order(image, [p[0] for p in parts]):
        if interval and mcu // interval != used:
            used = mcu // interval
            if used >= len(pieces):
                raise FormatError("restart intervals")
            bits, state = _Bits(pieces[used]), {}
        try:
            _read_block(bits, c.blocks[y, x], *tables[c.name], band, state, c.name)
        except AttributeError as e:
            raise FormatError("no code table") from e
    return end


def read(data: bytes) -> Jpeg:
    """All coefficients of a file; what is damaged, arithmetic, lossless or of 12 bits is an error."""
    if data[:2] != b"\xff\xd8":
        raise FormatError("not jpeg")
    image: Jpeg | None = None
    tables: dict[int, tuple[int, ...]] = {}
    codes: dict[tuple[int, int], dict] = {}
    segments: list[tuple[int, bytes]] = []
    pos, interval, scans = 2, 0, 0
    while pos + 2 <= len(data):
        if data[pos] != 0xFF:
            raise FormatError("marker")
        marker = data[pos + 1]
        if marker == 0xFF:
            pos += 1
            continue
        if marker == 0xD9:
            if image is None or not scans:
                raise FormatError("no scan")
            image.tables, image.tail = tables, data[pos + 2 :]
            return image
        if pos + 4 > len(data):
            break
        size = struct.unpack_from(">H", data, pos + 2)[0]
        body = data[pos + 4 : pos + 2 + size]
        if size < 2 or pos + 2 + size > len(data):
            break
        pos += 2 + size
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                values = struct.unpack(">64H", body[1:129]) if wide else tuple(body[1:65])
                if len(values) != 64:
                    raise FormatError("quantisation table")
                if scans and tables.get(name, values) != values:
                    raise FormatError("tables change between scans")
                tables[name], body = tuple(values), body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                codes[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + total].ljust(total, b"\0"))
                body = body[17 + total :]
        elif marker in (0xC0, 0xC1, 0xC2):
            depth, height, width, count = struct.unpack_from(">BHHB", body)
            if image is not None or depth != 8 or not width or not height or len(body) < 6 + 3 * count or not 1 <= count <= 4:
                raise FormatError("frame")
            parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
            if any(not 1 <= c.h <= 4 or not 1 <= c.v <= 4 for c in parts):
                raise FormatError("sampling")
            image = Jpeg(width, height, tables, parts, segments, marker == 0xC2)
            image.lay_out()
        elif marker == 0xDD:
            interval = struct.unpack_from(">H", body)[0]
        elif marker == 0xDA:
            if image is None:
                raise FormatError("scan before frame")
            pos = _read_scan(image, body, data, pos, codes, interval)
            scans += 1
        elif 0xE0 <= marker <= 0xEF or marker == 0xFE:
            segments.append((marker, body))
        else:
            raise FormatError(f"marker {marker:02x}")
    raise FormatError("truncated")


# Writing

#: What a scan is made of: (code table or None for plain bits, symbol or value, extra value, extra bits).
Symbols = list[tuple[tuple[int, int] | None, int, int, int]]


def _size_and_bits(value: int) -> tuple[int, int]:
    n = abs(value).bit_length()
    return n, value if value >= 0 else value + (1 << n) - 1


class _Scan:
    """Collects the symbols of one scan over a band, with its runs of ended blocks."""

    def __init__(self, band: tuple[int, int, int, int]):
        self.band, self.out = band, []
        self.before: dict[int, int] = {}
        self.run, self.late = 0, []
        self.run_table = 0

    def flush(self) -> None:
        if self.run:
            n = self.run.bit_length() - 1
            self.out.append(((1, self.run_table), n << 4, self.run & ((1 << n) - 1), n))
            self.out += [(None, b, 0, 1) for b in self.late]
            self.run, self.late = 0, []

    def block(self, c: Component, values: list[int], table: int, whole: bool) -> None:
        """Add one block; ``whole`` marks a sequential scan, whose blocks end one by one."""
        first, last, high, low = self.band
        self.run_table = table
        if first == 0:
            if high:
                self.out.append((None, values[0] >> low & 1, 0, 1))
            else:
                value = values[0] >> low
                n, bits = _size_and_bits(value - self.before.get(c.name, 0))
                self.before[c.name] = value
                self.out.append(((0, table), n, bits, n))
            first = 1
        if last == 0:
            return
        if high:
            self._refined(values, first, last, low, table)
            return
        zeros = 0
        for k in range(first, last + 1):
            value = values[k]
            value = value >> low if value >= 0 else -(-value >> low)
            if not value:
                zeros += 1
                continue
            self.flush()
            while zeros > 15:
                self.out.append(((1, table), 0xF0, 0, 0))
                zeros -= 16
            n, bits = _size_and_bits(value)
            self.out.append(((1, table), zeros << 4 | n, bits, n))
            zeros = 0
        if zeros:
            self.run += 1
            if whole or self.run == 0x7FFF:
                self.flush()

    def _refined(self, values: list[int], first: int, last: int, low: int, table: int) -> None:
        sizes = [abs(v) >> low for v in values]
        end = max((k for k in range(first, last + 1) if sizes[k] == 1), default=0)
        zeros, held = 0, []
        for k in range(first, last + 1):
            if not sizes[k]:
                zeros += 1
                continue
            while zeros > 15 and k <= end:
                self.flush()
                self.out.append(((1, table), 0xF0, 0, 0))
                self.out += [(None, b, 0, 1) for b in held]
                zeros, held = zeros - 16, []
            if sizes[k] > 1:
                held.append(sizes[k] & 1)
                continue
            self.flush()
            self.out.append(((1, table), zeros << 4 | 1, int(values[k] > 0), 1))
            self.out += [(None, b, 0, 1) for b in held]
            zeros, held = 0, []
        if zeros or held:
            self.run += 1
            self.late += held
            if self.run == 0x7FFF or len(self.late) > 900:
                self.flush()


def _code_table(counts: Counter) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The segment of an optimal code, and (code, length) by symbol.  No code is all ones: a symbol that never occurs
    takes the last one."""
    symbols = sorted(counts)
    lengths = limited_lengths([0, *(counts[s] * 2 for s in symbols), 1] if symbols else [0, 2, 1], 16)[1:]
    ranked = sorted((n, k) for k, n in enumerate(lengths[:-1]) if n) if symbols else []
    # The unused symbol has the longest code; if others share its length it is the last of them.
    per = [0] * 17
    for n, _ in ranked:
        per[n] += 1
    out, code, previous = {}, 0, 0
    for n, k in ranked:
        code <<= n - previous
        previous = n
        out[symbols[k]] = (code, n)
        code += 1
    return bytes(per[1:]) + bytes(symbols[k] for _, k in ranked), out


def _packed(symbols: Symbols, codes: dict[tuple[int, int], dict[int, tuple[int, int]]]) -> bytes:
    parts = []
    for table, symbol, extra, n in symbols:
        if table is None:
            parts.append("1" if symbol else "0")
        else:
            code, size = codes[table][symbol]
            parts.append(f"{code:0{size}b}")
            if n:
                parts.append(f"{extra:0{n}b}")
    text = "".join(parts)
    text += "1" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00") if text else b""


def _script(count: int, progressive: bool) -> list[tuple[list[int], tuple[int, int, int, int]]]:
    """Which components and bands the scans hold, in order."""
    every = list(range(count))
    if not progressive:
        return [(every, (0, 63, 0, 0))]
    out = [(every, (0, 0, 0, 1)), ([0], (1, 5, 0, 2))]
    out += [([k], (1, 63, 0, 1)) for k in reversed(every[1:])]
    out += [([0], (6, 63, 0, 2)), ([0], (1, 63, 2, 1)), (every, (0, 0, 1, 0))]
    out += [([k], (1, 63, 1, 0)) for k in reversed(every[1:])]
    return [*out, ([0], (1, 63, 1, 0))]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def write(image: Jpeg, progressive: bool = False) -> bytes:
    """A file of the same coefficients with a Huffman code for each scan."""
    out = [b"\xff\xd8", *(_segment(m, b) for m, b in image.segments)]
    wide = False
    for name, values in sorted(image.tables.items()):
        large = max(values) > 255
        wide |= large
        out.append(_segment(0xDB, bytes([name | (16 if large else 0)]) + (struct.pack(">64H", *values) if large else bytes(values))))
    frame = struct.pack(">BHHB", 8, image.height, image.width, len(image.components)) + b"".join(bytes([c.name, c.h << 4 | c.v, c.table]) for c in image.components)
    out.append(_segment(0xC2 if progressive else 0xC1 if wide else 0xC0, frame))
    # Interleaved scans hold at most ten blocks an MCU; larger ones are written component by component.
    fits = sum(c.h * c.v for c in image.components) <= 10
    for chosen, band in _script(len(image.components), progressive):
        for part in [chosen] if fits or len(chosen) == 1 else [[k] for k in chosen]:
            out.append(_scan(image, [(k, image.components[k]) for k in part], band, progressive))
    return b"".join([*out, b"\xff\xd9", image.tail])


def _scan(image: Jpeg, chosen: list[tuple[int, Component]], band: tuple[int, int, int, int], progressive: bool) -> bytes:
    scan = _Scan(band)
    table = {c.name: min(k, 1) for k, c in chosen}
    for _, c, y, x in _order(image, [c for _, c in chosen]):
        scan.block(c, c.blocks[y, x].tolist(), table[c.name], not progressive)
    scan.flush()
    counts: dict[tuple[int, int], Counter] = {}
    for name, symbol, _, _ in scan.out:
        if name is not None:
            counts.setdefault(name, Counter())[symbol] += 1
    tables = {name: _code_table(found) for name, found in sorted(counts.items())}
    head = b"".join(_segment(0xC4, bytes([kind << 4 | n]) + body) for (kind, n), (body, _) in tables.items())
    refers = b"".join(bytes([c.name, table[c.name] << 4 | table[c.name]]) for _, c in chosen)
    head += _segment(0xDA, bytes([len(chosen)]) + refers + bytes([band[0], band[1], band[2] << 4 | band[3]]))
    return head + _packed(scan.out, {name: codes for name, (_, codes) in tables.items()})


# Turning


def _mirrored(image: Jpeg, across: bool, trim: bool) -> Jpeg | None:
    """The image flipped left to right (``across``) or upside down; None if its edge cuts an MCU, unless it is trimmed."""
    hm, vm = image.most
    size, unit = (image.width, 8 * hm) if across else (image.height, 8 * vm)
    if size % unit:
        if not trim or size < unit:
            return None
        size -= size % unit
    sign = np.where((ZIGZAG % 8 if across else ZIGZAG // 8) % 2, -1, 1).astype(np.int32)
    parts = []
    for c in image.components:
        used = size // unit * (c.h if across else c.v)
        blocks = c.blocks[:, :used][:, ::-1] if across else c.blocks[:used][::-1]
        parts.append(replace(c, blocks=blocks * sign))
    out = replace(image, components=parts, **({"width": size} if across else {"height": size}))
    out.lay_out()
    return out


def _transposed(image: Jpeg) -> Jpeg:
    swap = NATURAL[(ZIGZAG % 8) * 8 + ZIGZAG // 8]
    parts = [replace(c, h=c.v, v=c.h, blocks=c.blocks.transpose(1, 0, 2)[:, :, swap]) for c in image.components]
    tables = {k: tuple(v[s] for s in swap) for k, v in image.tables.items()}
    out = replace(image, width=image.height, height=image.width, tables=tables, components=parts)
    out.lay_out()
    return out


# How each transform is put together: whether axes are swapped first, then flips across and down.
TRANSFORMS = {
    "none": (False, False, False),
    "flip horizontally": (False, True, False),
    "rotate 180": (False, True, True),
    "flip vertically": (False, False, True),
    "transpose": (True, False, False),
    "rotate 90": (True, True, False),
    "transverse": (True, True, True),
    "rotate 270": (True, False, True),
}


def transform(image: Jpeg, how: str, trim: bool = False) -> Jpeg | None:
    """The turned image; None if that would move a cut MCU inside, unless edges are trimmed."""
    swap, across, down = TRANSFORMS[how]
    out = _transposed(image) if swap else image
    for wanted, axis in ((across, True), (down, False)):
        if wanted:
            out = _mirrored(out, axis, trim)
            if out is None:
                return None
    return out


def same_coefficients(a: Jpeg, b: Jpeg) -> bool:
    """Equal dimensions, tables and coefficients of the blocks that hold the image."""
    if (a.width, a.height, len(a.components)) != (b.width, b.height, len(b.components)):
        return False
    for x, y in zip(a.components, b.components):
        rows, columns = x.size
        if (x.h, x.v, a.tables.get(x.table)) != (y.h, y.v, b.tables.get(y.table)) or not (x.blocks[:rows, :columns] == y.blocks[:rows, :columns]).all():
            return False
    return True


def optimize(data: bytes, level: int = 3, progressive: bool = False, strip: bool = False, autorotate: int = 0) -> tuple[bytes, str]:
    """The smallest verified re-coding and a status; never larger unless the image was turned.

    A progressive form is tried where ``tries_progressive`` says so, a sequential one where that lost or
    ``tries_baseline`` says so.  ``autorotate`` (2: only without loss, 1: edges may be trimmed) needs ``strip``, as the
    orientation that is undone goes with the metadata.
    """
    original = read(data)
    start = read(jpeg_strip(data)) if strip else original
    turned = None
    if autorotate and strip:
        how = ORIENTATION.get(exif_orientation(data), "none")
        if how != "none":
            turned = transform(start, how, trim=autorotate == 1)
    image = start if turned is None else turned
    base = None if turned is not None else jpeg_strip(data) if strip else data
    found: list[bytes] = []
    for form in [True, False] if tries_progressive(len(data), level, progressive) else [False]:
        won = bool(found) and len(found[0]) < len(base or data)
        if won and not tries_baseline(len(base or data), level):
            break
        made = write(image, form)
        if same_coefficients(read(made), image):
            found.append(made)
    if turned is not None:
        return (min(found, key=len), "turned") if found else (data, "kept")
    best = min([base, *found], key=len)
    return (best, "smaller") if len(best) < len(data) else (data, "kept")
