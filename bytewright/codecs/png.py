"""PNG (W3C specification): chunks, scanline filters, interlacing, colour modes, decoding and encoding."""

from __future__ import annotations

import math
import random
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Allowed bit depths and channels by colour type.
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
# First column, first row, column step and row step of the interlace passes.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
CRITICAL = {b"IHDR", b"PLTE", b"IDAT", b"IEND"}
ANIMATION = {b"acTL", b"fcTL", b"fdAT"}


class PngError(ValueError):
    """A file that does not decode; ``code`` names the reason."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Chunk:
    kind: bytes
    data: bytes
    crc_ok: bool = True

    @property
    def ancillary(self) -> bool:
        return bool(self.kind[0] & 32)


def chunks(data: bytes) -> list[Chunk]:
    """All chunks up to IEND; a broken frame raises."""
    if data[:8] != SIGNATURE:
        raise PngError("signature")
    out, pos = [], 8
    while True:
        if pos + 12 > len(data):
            raise PngError("truncated")
        size = struct.unpack_from(">I", data, pos)[0]
        if size > 0x7FFFFFFF or pos + 12 + size > len(data):
            raise PngError("chunk length")
        kind, body = data[pos + 4 : pos + 8], data[pos + 8 : pos + 8 + size]
        out.append(Chunk(kind, body, zlib.crc32(kind + body) == struct.unpack_from(">I", data, pos + 8 + size)[0]))
        pos += 12 + size
        if kind == b"IEND":
            return out


def position_group(all_chunks: list[Chunk]) -> list[int]:
    """0 before PLTE, 1 before IDAT, 2 after: where an ancillary chunk belongs."""
    out, group = [], 0
    for c in all_chunks:
        group = max(group, 1 if c.kind == b"PLTE" else 2 if c.kind == b"IDAT" else 0)
        out.append(group)
    return out


def write_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    depth: int
    color: int
    interlace: int = 0

    @property
    def bits(self) -> int:
        return self.depth * CHANNELS[self.color]

    @property
    def pixel_bytes(self) -> int:
        return max(1, self.bits // 8)

    def line_bytes(self, width: int | None = None) -> int:
        return -(-(self.width if width is None else width) * self.bits // 8)

    def passes(self) -> list[tuple[int, int]]:
        """(width, height) of each sub-image that is stored."""
        if not self.interlace:
            return [(self.width, self.height)]
        return [(-(-(self.width - x) // dx) if self.width > x else 0, -(-(self.height - y) // dy) if self.height > y else 0) for x, y, dx, dy in ADAM7]

    def raw_size(self) -> int:
        """Bytes of the filtered scanlines."""
        return sum(h * (1 + self.line_bytes(w)) for w, h in self.passes() if w and h)


def header(data: bytes) -> Header:
    """The checked IHDR."""
    if data[:8] != SIGNATURE:
        raise PngError("signature")
    if len(data) < 33 or data[12:16] != b"IHDR" or struct.unpack_from(">I", data, 8)[0] != 13:
        raise PngError("header")
    if zlib.crc32(data[12:29]) != struct.unpack_from(">I", data, 29)[0]:
        raise PngError("header crc")
    w, h, depth, color, compression, filtering, interlace = struct.unpack_from(">IIBBBBB", data, 16)
    if not w or not h or w > 0x7FFFFFFF or h > 0x7FFFFFFF:
        raise PngError("size")
    if color not in DEPTHS or depth not in DEPTHS[color]:
        raise PngError("colour mode")
    if compression or filtering or interlace > 1:
        raise PngError("method")
    return Header(w, h, depth, color, interlace)


def filter_line(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One scanline under filter 0 to 4; bytes missing on the left or above are 0."""
    if kind == 0:
        return line
    left = np.concatenate([np.zeros(step, np.uint8), line[:-step]]) if len(line) > step else np.zeros_like(line)
    if kind == 1:
        return line - left
    if kind == 2:
        return line - above
    if kind == 3:
        return line - ((left.astype(np.uint16) + above) >> 1).astype(np.uint8)
    corner = np.concatenate([np.zeros(step, np.uint8), above[:-step]]) if len(line) > step else np.zeros_like(line)
    a, b, c = (x.astype(np.int16) for x in (left, above, corner))
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return line - np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def unfilter(raw: bytes, width_bytes: int, height: int, step: int) -> np.ndarray:
    """Scanlines of one sub-image from their filtered form."""
    rows = np.frombuffer(raw, np.uint8).reshape(height, width_bytes + 1)
    out = np.zeros((height, width_bytes), np.uint8)
    above = np.zeros(width_bytes, np.uint8)
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:]
        if kind == 0:
            now = line.copy()
        elif kind == 1:
            now = np.empty_like(line)
            for k in range(min(step, width_bytes)):
                now[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            now = line + above
        elif kind in (3, 4):
            cur, up, src = [0] * width_bytes, above.tolist(), line.tolist()
            for i in range(width_bytes):
                a, b = (cur[i - step] if i >= step else 0), up[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[i - step] if i >= step else 0
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                cur[i] = (src[i] + guess) & 255
            now = np.array(cur, np.uint8)
        else:
            raise PngError("filter type")
        out[y] = above = now
    return out


def line_score(kind: int, line: np.ndarray, measure: str) -> float:
    """What a filtered scanline costs under a heuristic; lower is better."""
    if measure == "minsum":
        x = line.astype(np.int64)
        return float(x.sum() if kind == 0 else np.minimum(x, 255 - x).sum())
    with_type = np.concatenate([[np.uint8(kind)], line])
    if measure == "distinct_bytes":
        return float(len(np.unique(with_type)))
    if measure == "distinct_bigrams":
        pairs = with_type[:-1].astype(np.int32) << 8 | with_type[1:]
        return float(len(np.unique(pairs)))
    if measure == "entropy":
        n = np.bincount(with_type, minlength=256)
        p = n[n > 0] / len(with_type)
        return float(-(p * np.log2(p)).sum())
    if measure == "deflate":
        return float(len(zlib.compress(with_type.tobytes(), 9)))
    raise ValueError(measure)


#: zlib effort of the strategies that carry a compressor's state from line to line.
INCREMENTAL = {"incremental": 2, "incremental2": 6, "incremental3": 1}


def _deflated(options: list[list[np.ndarray]], types: list[int]) -> int:
    return len(zlib.compress(b"".join(bytes([k]) + options[y][k].tobytes() for y, k in enumerate(types)), 9))


def _incremental(options: list[list[np.ndarray]], effort: int) -> list[int]:
    """Per line the filter after which the stream so far is smallest, ties to the highest type; its state is kept."""
    out, state = [], zlib.compressobj(effort, zlib.DEFLATED, 15, 8, zlib.Z_FILTERED)
    for lines in options:
        tries = []
        for k in range(5):
            trial = state.copy()
            size = len(trial.compress(bytes([k]) + lines[k].tobytes())) + len(trial.copy().flush(zlib.Z_SYNC_FLUSH))
            tries.append((size, -k, trial))
        best = min(tries, key=lambda t: t[:2])
        out.append(-best[1])
        state = best[2]
    return out


def _genetic(lines: np.ndarray, options: list[list[np.ndarray]], step: int, rnd: random.Random, people: int = 19, children: int = 3, crossover: float = 0.9, mutation: float = 0.01, stale: int = 500) -> list[int]:
    """A population of whole filter choices: parents are chosen by rank, children replace the worst, until ``stale``
    generations bring nothing better."""
    n = len(options)
    first = [[k] * n for k in range(5)] + [choose_filters(lines, step, s) for s in ("minsum", "entropy")]
    first += [[rnd.randrange(5) for _ in range(n)] for _ in range(people - len(first))]
    ranked = sorted((_deflated(options, x), x) for x in first)
    idle = 0 if n > 1 else stale
    while idle < stale:
        best = ranked[0][0]
        born = []
        for _ in range(children):
            a, b = (ranked[min(int(rnd.random() ** 2 * people), people - 1)][1] for _ in range(2))
            cut = rnd.randrange(n) if rnd.random() < crossover else n
            child = [rnd.randrange(5) if rnd.random() < mutation else k for k in a[:cut] + b[cut:]]
            born.append((_deflated(options, child), child))
        ranked = sorted([*ranked[: people - children], *born])
        idle = 0 if ranked[0][0] < best else idle + 1
    return ranked[0][1]


def choose_filters(lines: np.ndarray, step: int, strategy: str, given: list[int] | None = None, seed: int = 1) -> list[int]:
    """A filter type per scanline.

    ``0`` to ``4``: that type; ``minsum``, ``distinct_bytes``, ``distinct_bigrams``, ``entropy``, ``deflate``: the
    best line by line, ties to the lowest type; ``given``: the types passed in; ``incremental`` (three efforts): by a
    compressor that carries its state from line to line; ``cheap``: the best of the three; ``genetic``: a seeded
    population over whole images.
    """
    n = len(lines)
    if strategy in "01234":
        return [int(strategy)] * n
    if strategy == "given":
        return list(given or [0] * n)[:n] + [0] * (n - len(given or []))
    zero = np.zeros(lines.shape[1] if n else 0, np.uint8)
    options = [[filter_line(k, lines[y], lines[y - 1] if y else zero, step) for k in range(5)] for y in range(n)]
    if strategy in INCREMENTAL:
        return _incremental(options, INCREMENTAL[strategy])
    if strategy == "cheap":
        tries = [_incremental(options, effort) for effort in INCREMENTAL.values()]
        return min(tries, key=lambda types: (_deflated(options, types), tries.index(types)))
    if strategy == "genetic":
        return _genetic(lines, options, step, random.Random(seed))
    return [min(range(5), key=lambda k: (line_score(k, options[y][k], strategy), k)) for y in range(n)]


STRATEGIES = ("0", "1", "2", "3", "4", "minsum", "distinct_bytes", "distinct_bigrams", "entropy", "deflate", *INCREMENTAL)
#: Further strategies, tried when asked for.
BRUTE, CHEAP = ("genetic",), ("cheap",)


def apply_filters(lines: np.ndarray, step: int, types: list[int]) -> bytes:
    zero = np.zeros(lines.shape[1], np.uint8)
    return b"".join(bytes([k]) + filter_line(k, lines[y], lines[y - 1] if y else zero, step).tobytes() for y, k in enumerate(types))


def unpack_samples(lines: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """(height, width, channels) samples from packed scanlines."""
    if depth == 16:
        wide = lines.reshape(len(lines), -1, 2).astype(np.uint16)
        flat = wide[:, :, 0] << 8 | wide[:, :, 1]
    elif depth == 8:
        flat = lines.astype(np.uint16)
    else:
        bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
        flat = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint16)
    return flat[:, : width * channels].reshape(len(lines), width, channels)


def pack_samples(samples: np.ndarray, depth: int) -> np.ndarray:
    """Packed scanlines from samples; the last byte of a line is filled with zero bits."""
    flat = samples.reshape(len(samples), -1)
    if depth == 16:
        return np.stack([flat >> 8, flat & 255], axis=2).astype(np.uint8).reshape(len(flat), -1)
    if depth == 8:
        return flat.astype(np.uint8)
    bits = (flat[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1
    return np.packbits(bits.reshape(len(flat), -1).astype(np.uint8), axis=1)


@dataclass
class Image:
    """Pixels as (height, width, 4) samples of 8 or 16 bits, with the chunks that are kept beside them."""

    pixels: np.ndarray
    deep: bool = False
    extra: list[tuple[int, Chunk]] = field(default_factory=list)
    filters: list[int] = field(default_factory=list)
    source: Header | None = None


def filter_types(data: bytes) -> list[int]:
    """The filter type of every stored scanline."""
    h = header(data)
    raw = zlib.decompress(b"".join(c.data for c in chunks(data) if c.kind == b"IDAT"))
    out, pos = [], 0
    for w, rows in h.passes():
        if w and rows:
            size = h.line_bytes(w) + 1
            out += list(raw[pos : pos + rows * size : size])
            pos += rows * size
    return out


def decode(data: bytes, lenient: bool = False) -> Image:
    """The image, or a PngError; ``lenient`` forgives bad checksums of ancillary chunks."""
    h, all_chunks = header(data), chunks(data)
    for c in all_chunks:
        if not c.crc_ok and not (lenient and c.ancillary):
            raise PngError("chunk crc")
    stream = zlib.decompressobj()
    try:
        raw = stream.decompress(b"".join(c.data for c in all_chunks if c.kind == b"IDAT"), h.raw_size() + 1)
    except zlib.error as e:
        raise PngError("zlib") from e
    if len(raw) != h.raw_size() or not stream.eof:
        raise PngError("data size")
    palette = next((c.data for c in all_chunks if c.kind == b"PLTE"), b"")
    trns = next((c.data for c in all_chunks if c.kind == b"tRNS"), b"")
    if h.color == 3 and (not palette or len(palette) % 3 or len(palette) > 768):
        raise PngError("palette")
    samples = np.zeros((h.height, h.width, CHANNELS[h.color]), np.uint16)
    types, pos = [], 0
    places = ADAM7 if h.interlace else ((0, 0, 1, 1),)
    for (x, y, dx, dy), (w, rows) in zip(places, h.passes()):
        if w and rows:
            size = h.line_bytes(w)
            part = raw[pos : pos + rows * (size + 1)]
            types += list(part[:: size + 1])
            lines = unfilter(part, size, rows, h.pixel_bytes)
            samples[y::dy, x::dx] = unpack_samples(lines, w, h.depth, CHANNELS[h.color])
            pos += rows * (size + 1)
    deep = h.depth == 16
    top = 65535 if deep else 255
    out = np.full((h.height, h.width, 4), top, np.uint16)
    if h.color == 3:
        table = np.full((256, 4), 255, np.uint16)
        table[: len(palette) // 3, :3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        table[: len(trns), 3] = np.frombuffer(trns, np.uint8)
        if int(samples.max()) >= len(palette) // 3:
            raise PngError("palette index")
        out = table[samples[:, :, 0]]
    else:
        scale = 1 if h.depth >= 8 else 255 // ((1 << h.depth) - 1)
        if h.color in (0, 4):
            out[:, :, :3] = samples[:, :, :1] * scale
        else:
            out[:, :, :3] = samples[:, :, :3]
        if h.color in (4, 6):
            out[:, :, 3] = samples[:, :, -1]
        elif len(trns) >= 2 * CHANNELS[h.color]:
            key = np.array(struct.unpack(f">{CHANNELS[h.color]}H", trns[: 2 * CHANNELS[h.color]]), np.uint16)
            out[:, :, 3][(samples == key).all(axis=2)] = 0
    kept = [(g, c) for g, c in zip(position_group(all_chunks), all_chunks) if c.kind not in CRITICAL | {b"tRNS", b"bKGD", b"sBIT"}]
    return Image(out, deep, kept, types, h)


@dataclass(frozen=True)
class Mode:
    """How pixels are stored: colour type, depth, palette (RGBA rows) and colour key."""

    color: int
    depth: int
    palette: tuple[tuple[int, ...], ...] = ()
    key: tuple[int, ...] | None = None


def color_statistics(image: Image) -> dict:
    """What decides the colour mode: see ``choose_mode``."""
    px = image.pixels
    flat = px.reshape(-1, 4)
    colors, first, counts = np.unique(flat, axis=0, return_index=True, return_counts=True)
    alpha = flat[:, 3]
    top = 65535 if image.deep else 255
    clear = alpha == 0
    key = None
    if clear.any() and ((alpha == 0) | (alpha == top)).all():
        where = int(np.flatnonzero(clear)[0])
        candidate = flat[where, :3]
        hidden = flat[clear][:, :3]
        opaque = flat[~clear][:, :3]
        if (hidden == candidate).all() and not (opaque == candidate).all(axis=1).any():
            key = tuple(int(v) for v in candidate)
    gray = bool((flat[:, 0] == flat[:, 1]).all() and (flat[:, 1] == flat[:, 2]).all())
    narrow = not image.deep or bool((px >> 8 == px & 255).all())
    values = flat[:, 0] & 255
    bits = 8
    if gray and narrow and (key is not None or (alpha == top).all()):
        bits = 1 if (values % 255 == 0).all() else 2 if (values % 85 == 0).all() else 4 if (values % 17 == 0).all() else 8
    order = np.argsort(first)
    return {"colors": colors[order], "counts": counts[order], "gray": gray, "alpha": bool((alpha != top).any()), "key": key, "narrow": narrow, "bits": bits, "pixels": len(flat)}


#: Fixed value: images of at most so many pixels get no colour key.
KEY_PIXELS = 49


def choose_mode(image: Image, allow_palette: bool = True) -> Mode:
    """The smallest lossless mode: palette, gray, RGB, with key or alpha."""
    s = color_statistics(image)
    if not s["narrow"]:
        color = (0 if s["gray"] else 2) + (4 if s["alpha"] else 0)
        return Mode(color, 16)
    key = s["key"] if s["pixels"] > KEY_PIXELS else None
    alpha = s["alpha"] and key is None
    n = len(s["colors"])
    pal_bits = 1 if n <= 2 else 2 if n <= 4 else 4 if n <= 16 else 8
    if s["gray"] and not alpha:
        gray = Mode(0, s["bits"], key=(key[0] * ((1 << s["bits"]) - 1) // 255,) if key else None)
        if not allow_palette or n > 256 or pal_bits >= s["bits"]:
            return gray
    direct = 8 * (1 if s["gray"] else 3) + (8 if alpha else 0)
    if allow_palette and n <= 256 and n * 32 + s["pixels"] * pal_bits < s["pixels"] * direct:
        scale = 255 if image.deep else 1
        return Mode(3, pal_bits, tuple(tuple(int(v) // (257 if image.deep else 1) for v in c) for c in s["colors"]) if scale else ())
    if s["gray"]:
        return Mode(4, 8) if alpha else Mode(0, 8, key=(key[0],) if key else None)
    return Mode(6, 8) if alpha else Mode(2, 8, key=key)


# The palette orders: what the entries are sorted by, whether clear ones come first, and the direction.
ORDER_KEYS: dict[str, Callable[[tuple[int, ...]], float]] = {
    "rgb": lambda c: (c[0] << 16) + (c[1] << 8) + c[2],
    "yuv": lambda c: 0.299 * c[0] + 0.587 * c[1] + 0.114 * c[2],
    "lab": lambda c: _lightness(c),
    "msb": lambda c: sum(((c[k] >> b) & 1) << (3 * b + 2 - k) for b in range(8) for k in range(3)),
}


def _lightness(c: tuple[int, ...]) -> float:
    linear = [v / 255 / 12.92 if v <= 10 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in c[:3]]
    y = 0.2126 * linear[0] + 0.7152 * linear[1] + 0.0722 * linear[2]
    return 116 * y ** (1 / 3) - 16 if y > 0.008856 else 903.3 * y


def order_palette(palette: tuple[tuple[int, ...], ...], counts: dict[tuple[int, ...], int], key: str, alpha: str = "first", descending: bool = False) -> tuple[tuple[int, ...], ...]:
    """A permutation: by popularity or colour key; entries with alpha first, last or in their place."""
    score = (lambda c: counts.get(c, 0)) if key == "popularity" else ORDER_KEYS[key]
    ranked = sorted(palette, key=lambda c: (score(c), c), reverse=descending)
    if alpha == "ignore":
        return tuple(ranked)
    clear, solid = [c for c in ranked if c[3] < 255], [c for c in ranked if c[3] == 255]
    return tuple(clear + solid if alpha == "first" else solid + clear)


def nearest_palette(palette: tuple[tuple[int, ...], ...], indexes: np.ndarray | None = None) -> tuple[tuple[int, ...], ...]:
    """Greedy chain from the first entry: to the nearest colour, or with ``indexes`` to the commonest neighbour."""
    left, out = list(range(1, len(palette))), [0] if palette else []
    pairs = neighbours(indexes, len(palette)) if indexes is not None else None
    while left:
        last = out[-1]
        if pairs is None:
            nxt = min(left, key=lambda i: (sum((a - b) ** 2 for a, b in zip(palette[i], palette[last])), i))
        else:
            nxt = max(left, key=lambda i: (pairs[last, i], -i))
        left.remove(nxt)
        out.append(nxt)
    return tuple(palette[i] for i in out)


def neighbours(indexes: np.ndarray, n: int) -> np.ndarray:
    """How often two palette entries stand beside or above each other."""
    out = np.zeros((n, n), np.int64)
    for a, b in ((indexes[:, :-1], indexes[:, 1:]), (indexes[:-1], indexes[1:])):
        np.add.at(out, (a.ravel(), b.ravel()), 1)
        np.add.at(out, (b.ravel(), a.ravel()), 1)
    return out


def unused_color(pixels: np.ndarray) -> tuple[int, int, int] | None:
    """The first opaque gray that no pixel has, else the first RGB value in order that none has."""
    packed = np.unique((pixels[:, :, 0].astype(np.int64) << 16 | pixels[:, :, 1] << 8 | pixels[:, :, 2]).ravel())
    used = set(packed.tolist())
    for g in range(256):
        if (g << 16 | g << 8 | g) not in used:
            return g, g, g
    gap = np.flatnonzero(packed != np.arange(len(packed)))
    value = int(gap[0]) if len(gap) else len(packed)
    return (value >> 16, value >> 8 & 255, value & 255) if value < 1 << 24 else None


HIDDEN = ("black", "sub", "up", "average", "paeth")


def clean_alpha(image: Image, how: str = "black") -> Image:
    """Change the hidden colour of clear pixels: to black, or to what a scanline filter predicts there, so that the
    filtered bytes are zero.  Pixels before the first column and row count as black."""
    px = image.pixels.copy()
    clear = px[:, :, 3] == 0
    px[clear] = 0
    if how == "black":
        return Image(px, image.deep, image.extra, image.filters, image.source)
    none = np.zeros(3, np.int64)
    for y, x in np.argwhere(clear):
        left = px[y, x - 1, :3].astype(np.int64) if x else none
        above = px[y - 1, x, :3].astype(np.int64) if y else none
        if how == "sub":
            value = left
        elif how == "up":
            value = above
        elif how == "average":
            value = (left + above) >> 1
        else:
            corner = px[y - 1, x - 1, :3].astype(np.int64) if x and y else none
            pa, pb, pc = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
            value = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        px[y, x, :3] = value
    return Image(px, image.deep, image.extra, image.filters, image.source)


def to_samples(image: Image, mode: Mode) -> np.ndarray:
    px = image.pixels
    if mode.color == 3:
        scaled = px // 257 if image.deep else px
        table = {c: i for i, c in enumerate(mode.palette)}
        packed = scaled.reshape(-1, 4)
        colors, inverse = np.unique(packed, axis=0, return_inverse=True)
        lookup = np.array([table[tuple(int(v) for v in c)] for c in colors], np.uint16)
        return lookup[inverse].reshape(px.shape[0], px.shape[1], 1)
    if image.deep and mode.depth < 16:
        px = px & 255
    if mode.color in (0, 4):
        px = px[:, :, [0, 3]] if mode.color == 4 else px[:, :, :1]
        return px // (255 // ((1 << mode.depth) - 1)) if mode.depth < 8 else px
    return px[:, :, :3] if mode.color == 2 else px


def encode(image: Image, mode: Mode, strategy: str = "entropy", compress: Callable[[bytes], bytes] | None = None, keep_extra: bool = True) -> bytes:
    """A non-interlaced PNG; ``compress`` makes the zlib stream."""
    height, width = image.pixels.shape[:2]
    h = Header(width, height, mode.depth, mode.color)
    lines = pack_samples(to_samples(image, mode), mode.depth)
    types = choose_filters(lines, h.pixel_bytes, strategy, image.filters)
    stream = (compress or (lambda raw: zlib.compress(raw, 9)))(apply_filters(lines, h.pixel_bytes, types))
    groups: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
    for group, c in image.extra if keep_extra else []:
        groups[group].append(write_chunk(c.kind, c.data))
    out = [SIGNATURE, write_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, mode.depth, mode.color, 0, 0, 0)), *groups[0]]
    if mode.palette:
        out.append(write_chunk(b"PLTE", bytes(v for c in mode.palette for v in c[:3])))
        alphas = bytes(c[3] for c in mode.palette).rstrip(b"\xff")
        out += [write_chunk(b"tRNS", alphas)] if alphas else []
    elif mode.key is not None:
        out.append(write_chunk(b"tRNS", struct.pack(f">{len(mode.key)}H", *mode.key)))
    return b"".join([*out, *groups[1], write_chunk(b"IDAT", stream), *groups[2], write_chunk(b"IEND", b"")])


def essential(chunk: Chunk) -> bool:
    """The plain policy of a strip: critical chunks, tRNS and animation stay."""
    return not chunk.ancillary or chunk.kind == b"tRNS" or chunk.kind in ANIMATION


def strip(data: bytes, policy: Callable[[Chunk], bool] = essential) -> bytes:
    """The file without the ancillary chunks that the policy drops, its IDAT chunks joined."""
    all_chunks = chunks(data)
    keep = [c for c in all_chunks if not c.ancillary or policy(c)]
    image = b"".join(c.data for c in keep if c.kind == b"IDAT")
    out, done = [SIGNATURE], False
    for c in keep:
        if c.kind != b"IDAT":
            out.append(write_chunk(c.kind, c.data))
        elif not done:
            out.append(write_chunk(b"IDAT", image))
            done = True
    return b"".join(out)


def same_image(a: Image, b: Image, hidden: bool = True) -> bool:
    """Equal pixels, at the depth of the deeper; without ``hidden`` the colour of clear pixels may differ."""
    x, y = (i.pixels.astype(np.int64) * (1 if i.deep else 257) for i in (a, b))
    if x.shape != y.shape:
        return False
    if not hidden:
        x, y = x.copy(), y.copy()
        x[x[:, :, 3] == 0] = 0
        y[y[:, :, 3] == 0] = 0
    return bool((x == y).all())


def palette_orders(palette: tuple[tuple[int, ...], ...], counts: dict[tuple[int, ...], int], indexes: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], ...]]:
    """At most ``limit`` distinct orders out of 120: sorted as a whole, or chained from there to the nearest colour, the
    nearest popular colour or the commonest neighbour; by five keys, three places of clear entries, both directions."""
    pairs = neighbours(indexes, len(palette))
    place = {c: k for k, c in enumerate(palette)}

    def chained(start: tuple[tuple[int, ...], ...], how: str) -> tuple[tuple[int, ...], ...]:
        if how == "global":
            return start
        left, out = list(start[1:]), [start[0]]
        while left:
            last = out[-1]
            apart = lambda c: sum((a - b) ** 2 for a, b in zip(c, last))  # noqa: E731, B023
            score = {"nearest": apart, "nearest weighted": lambda c: apart(c) / max(counts.get(c, 1), 1), "neighbour": lambda c: -int(pairs[place[last], place[c]])}[how]  # noqa: B023
            nxt = min(left, key=lambda c: (score(c), left.index(c)))  # noqa: B023
            left.remove(nxt)
            out.append(nxt)
        return tuple(out)

    made: dict[tuple, None] = {}
    for how in ("global", "nearest", "nearest weighted", "neighbour"):
        for key in ("popularity", "rgb", "yuv", "lab", "msb"):
            for alpha in ("first", "ignore", "last"):
                for descending in (False, True):
                    if len(made) >= limit:
                        return list(made)
                    made[chained(order_palette(palette, counts, key, alpha, descending), how)] = None
    return list(made)


@dataclass(frozen=True)
class Text:
    """A text chunk: tEXt, zTXt (compressed) or iTXt (UTF-8, may be compressed, with a language and a translated keyword)."""

    kind: bytes
    keyword: str
    text: str
    compressed: bool = False
    language: str = ""
    translated: str = ""


def read_text(chunk: Chunk) -> Text:
    """The content of a text chunk; a broken one raises."""
    parts = chunk.data.split(b"\0", 1)
    if len(parts) < 2 or not 1 <= len(parts[0]) <= 79:
        raise PngError("keyword")
    keyword, rest = parts[0].decode("latin-1"), parts[1]
    try:
        if chunk.kind == b"tEXt":
            return Text(chunk.kind, keyword, rest.decode("latin-1"))
        if chunk.kind == b"zTXt":
            if rest[:1] != b"\0":
                raise PngError("text compression")
            return Text(chunk.kind, keyword, zlib.decompress(rest[1:]).decode("latin-1"), True)
        packed, method = rest[0], rest[1]
        language, translated, body = rest[2:].split(b"\0", 2)
        if method or packed > 1:
            raise PngError("text compression")
        return Text(chunk.kind, keyword, (zlib.decompress(body) if packed else body).decode(), bool(packed), language.decode("latin-1"), translated.decode())
    except (IndexError, UnicodeDecodeError, ValueError, zlib.error) as e:
        raise PngError("text chunk") from e


def write_text(text: Text, compress: Callable[[bytes], bytes] | None = None) -> Chunk:
    """The chunk of a text; ``compress`` makes the zlib stream of a compressed one."""
    pack = compress or (lambda raw: zlib.compress(raw, 9))
    head = text.keyword.encode("latin-1") + b"\0"
    if text.kind == b"tEXt":
        return Chunk(text.kind, head + text.text.encode("latin-1"))
    if text.kind == b"zTXt":
        return Chunk(text.kind, head + b"\0" + pack(text.text.encode("latin-1")))
    body = text.text.encode()
    middle = bytes([int(text.compressed), 0]) + text.language.encode("latin-1") + b"\0" + text.translated.encode() + b"\0"
    return Chunk(text.kind, head + middle + (pack(body) if text.compressed else body))


TEXT_KINDS = (b"tEXt", b"zTXt", b"iTXt")


def texts(data: bytes) -> list[Text]:
    """The text chunks of a file, in order."""
    return [read_text(c) for c in chunks(data) if c.kind in TEXT_KINDS]


def _smaller_texts(image: Image, compress: Callable[[bytes], bytes]) -> list[tuple[int, Chunk]]:
    """The kept chunks, compressed texts as the smaller of old and new; broken ones as they are."""
    out = []
    for group, chunk in image.extra:
        if chunk.kind in (b"zTXt", b"iTXt"):
            try:
                text = read_text(chunk)
                made = write_text(text, compress)
                if len(made.data) < len(chunk.data) and read_text(made) == text:
                    chunk = made
            except PngError:
                pass
        out.append((group, chunk))
    return out


@dataclass(frozen=True)
class PngPlan:
    """What a level does: the filter that is tried against none, what it is given for being chosen, and whether a pass
    without filters at a lower level comes first."""

    filtered: str
    bonus: float = 0.0
    before: int = 0


#: The plan of each level.
PLANS: dict[int, PngPlan] = {
    1: PngPlan("minsum"),
    2: PngPlan("distinct_bigrams"),
    3: PngPlan("deflate"),
    4: PngPlan("incremental"),
    **{n: PngPlan("incremental", 0.015) for n in (5, 6, 7, 8)},
    9: PngPlan("incremental", 0.015, before=3),
}


def plan_strategies(image: Image, mode: Mode, level: int) -> tuple[str, ...]:
    """The filter strategy of a level: none or its filter, by the size that zlib makes of the lines."""
    plan = PLANS[min(max(level, 1), 9)]
    h = Header(image.pixels.shape[1], image.pixels.shape[0], mode.depth, mode.color)
    lines = pack_samples(to_samples(image, mode), mode.depth)
    size = lambda name: len(zlib.compress(apply_filters(lines, h.pixel_bytes, choose_filters(lines, h.pixel_bytes, name)), 9))
    return (plan.filtered,) if size(plan.filtered) * (1 - plan.bonus) < size("0") else ("0",)


def optimize(data: bytes, level: int = 3, strict: bool = True, strip_extra: bool = False, reuse: bool = False, all_filters: bool = False, palette_sort: int = 0, passes: int | None = None, rounds: int = 0, brute: bool = False, cheap: bool = False) -> bytes:
    """The smallest verified rewrite, never larger than the input.

    Animated and signed files are returned as they are.  Candidates are the level's filter strategy (all of them with
    ``all_filters``, ``brute`` and ``cheap`` for more) with and without a palette, and some palette orders from level
    5 on; each is decoded and compared before it may win.  Compressed texts are coded again.
    """
    kinds = {c.kind for c in chunks(data)}
    if kinds & (ANIMATION | {b"dSIG"}):
        return data
    image = decode(data)
    hidden = not strict and not reuse and bool((image.pixels[:, :, 3] == 0).any())
    starts = [clean_alpha(image, how) for how in (HIDDEN if level >= 4 else HIDDEN[:1])] if hidden else [image]
    best = strip(data) if strip_extra else data
    for start in starts:
        best = _smallest(start, image, best, level, strict, strip_extra, reuse, all_filters, palette_sort, passes, rounds, brute, cheap)
    return best


def _smallest(start: Image, image: Image, best: bytes, level: int, strict: bool, strip_extra: bool, reuse: bool, all_filters: bool, palette_sort: int, passes: int | None, rounds: int, brute: bool, cheap: bool) -> bytes:
    """The smallest verified encoding of ``start``, or ``best``."""
    from .deflate import best_deflate

    def compress(raw: bytes, at: int = level) -> bytes:
        body = best_deflate(raw, at, passes, rounds)
        return b"\x78\xda" + body + struct.pack(">I", zlib.adler32(raw))

    modes = [choose_mode(start)]
    if modes[0].color == 3:
        tries = palette_sort or (6 if level >= 5 else 0)
        if tries:
            stats = color_statistics(start)
            scale = 257 if start.deep else 1
            counts = {tuple(int(v) // scale for v in c): int(n) for c, n in zip(stats["colors"], stats["counts"])}
            orders = palette_orders(modes[0].palette, counts, to_samples(start, modes[0])[:, :, 0], tries)
            modes += [Mode(3, modes[0].depth, order) for order in orders]
        if start.pixels.shape[0] * start.pixels.shape[1] <= 4096:
            modes.append(choose_mode(start, allow_palette=False))
    start = Image(start.pixels, start.deep, [] if strip_extra else _smaller_texts(start, compress), start.filters, start.source)
    plan = PLANS[min(max(level, 1), 9)]
    for mode in dict.fromkeys(modes):
        if reuse:
            strategies = ("given",)
            if image.source.interlace or (mode.color, mode.depth) != (image.source.color, image.source.depth):
                continue
        else:
            strategies = (*STRATEGIES, *(BRUTE if brute else ()), *(CHEAP if cheap else ())) if all_filters else plan_strategies(start, mode, level)
        for strategy in strategies:
            efforts = [plan.before, level] if plan.before and not reuse and not all_filters else [level]
            for effort in efforts:
                made = encode(start, mode, "0" if effort < level else strategy, lambda raw, at=effort: compress(raw, at))
                if len(made) < len(best) and same_image(decode(made), image, hidden=strict):
                    best = made
    return best


def entropy(values: np.ndarray) -> float:
    n = np.bincount(values, minlength=256)
    p = n[n > 0] / max(len(values), 1)
    return float(-(p * np.log2(p)).sum()) if len(values) else math.nan
