"""A DEFLATE encoder (RFC 1951): matches of all positions at once, lazy and shortest-path parsing, cost-driven blocks.

Matches, histograms and bits are NumPy arrays; only the parse goes token by token.  ``zlib`` stays the fast path.
"""

from __future__ import annotations

import heapq
import math
import zlib
from dataclasses import dataclass

import numpy as np

from .huffman import CODE_LENGTH_ORDER, EXTRA_BITS, canonical_codes, header_choice, limited_lengths, smoothed, strided, two_distance_codes

WINDOW, SHORTEST, LONGEST, END = 32768, 3, 258, 256


def length_symbol(length: int) -> tuple[int, int, int]:
    """(symbol, extra bits, extra value) of a match length from 3 to 258."""
    if length == LONGEST:
        return 285, 0, 0
    k = length - 3
    if k < 8:
        return 257 + k, 0, 0
    bits = k.bit_length() - 3
    return 257 + 4 * bits + (k >> bits), bits, k & ((1 << bits) - 1)


def distance_symbol(distance: int) -> tuple[int, int, int]:
    """(symbol, extra bits, extra value) of a distance from 1 to 32768."""
    k = distance - 1
    if k < 4:
        return k, 0, 0
    bits = k.bit_length() - 2
    return 2 * bits + (k >> bits), bits, k & ((1 << bits) - 1)


# The symbols of all lengths and distances, with their extra bits and first values.
LENGTH_SYMBOL, LENGTH_BITS, LENGTH_EXTRA = (np.array(x) for x in zip(*[(0, 0, 0)] * 3, *(length_symbol(n) for n in range(3, 259))))
DISTANCE_SYMBOL, DISTANCE_BITS, DISTANCE_EXTRA = (np.array(x) for x in zip((0, 0, 0), *(distance_symbol(n) for n in range(1, WINDOW + 1))))
#: Code lengths of fixed blocks.
FIXED_LITLEN = [8] * 144 + [9] * 112 + [7] * 24 + [8] * 8
FIXED_DIST = [5] * 32


@dataclass(frozen=True)
class Tokens:
    """A parse: per token a literal byte (distance 0) or a match length and its distance."""

    value: np.ndarray
    distance: np.ndarray

    def __len__(self) -> int:
        return len(self.value)

    def __getitem__(self, part: slice) -> Tokens:
        return Tokens(self.value[part], self.distance[part])

    @property
    def sizes(self) -> np.ndarray:
        """Bytes that each token stands for."""
        return np.where(self.distance > 0, self.value, 1)


def tokens_of(value: list[int], distance: list[int]) -> Tokens:
    return Tokens(np.array(value, np.int32), np.array(distance, np.int32))


@dataclass(frozen=True)
class DeflateLevel:
    """Search effort: earlier places tried, passes of the shortest-path parse, tokens below which a block stays whole,
    and how many code-length headers, smoothings and length limits are tried (0 to 2).  ``every``: the parse may take the
    longest match of each distance symbol, not only ever longer ones."""

    chain: int = 32
    passes: int = 0
    least_split: int = 512
    split: bool = True
    search: int = 1
    every: bool = False


LEVELS: dict[int, DeflateLevel] = {
    1: DeflateLevel(8, 0, split=False, search=0),
    2: DeflateLevel(16, 0, search=0),
    3: DeflateLevel(32, 1),
    4: DeflateLevel(64, 2),
    5: DeflateLevel(96, 3),
    6: DeflateLevel(128, 5),
    7: DeflateLevel(256, 8),
    8: DeflateLevel(512, 12),
    9: DeflateLevel(1024, 20, search=2, every=True),
}


class Matches:
    """Earlier occurrences of the bytes at each position from ``start`` on, nearest first.

    ``bounds`` divides the data into rows that are parsed each for itself.  All positions advance together along their
    chains of equal three-byte beginnings.  ``first``, ``length`` and ``distance`` list each position's ever longer
    matches, each at its least distance (with ``every``: its longest of each distance symbol); ``best_length`` and
    ``best_distance`` hold the longest.
    """

    def __init__(self, data: bytes, chain: int, bounds: np.ndarray | None = None, start: int = 0, every: bool = False):
        self.data, self.every, n = data, every, len(data)
        raw = np.frombuffer(data, np.uint8)
        bounds = np.array([0, n]) if bounds is None else np.asarray(bounds)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.limit = np.minimum(np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n), LONGEST).astype(np.int32)
        self.best_length, self.best_distance = np.zeros(n, np.int32), np.zeros(n, np.int32)
        padded = np.zeros(n + 16, np.uint8)
        padded[:n] = raw
        places: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if n >= SHORTEST:
            self._search(padded, row, chain, start, every, places)
        at, length, distance = (np.concatenate([p[k] for p in places]) if places else np.zeros(0, np.int64) for k in range(3))
        if every and len(at):
            # The longest of each distance symbol, at its least distance.
            symbol = DISTANCE_SYMBOL[distance]
            order = np.lexsort((distance, -length, symbol, at))
            at, length, distance, symbol = at[order], length[order], distance[order], symbol[order]
            keep = np.ones(len(at), bool)
            keep[1:] = (at[1:] != at[:-1]) | (symbol[1:] != symbol[:-1])
            at, length, distance = at[keep], length[keep], distance[keep]
        order = np.argsort(at, kind="stable")
        self.first = np.searchsorted(at[order], np.arange(n + 1))
        self.length, self.distance = length[order], distance[order]

    def _search(self, data: np.ndarray, row: np.ndarray, chain: int, start: int, every: bool, places: list) -> None:
        n = len(row)
        words = np.ndarray(n + 8, dtype="<u8", buffer=data, strides=(1,))
        key = data[: n - 2].astype(np.int64) | data[1 : n - 1].astype(np.int64) << 8 | data[2:n].astype(np.int64) << 16 | row[: n - 2] << 24
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        previous = np.full(n, -1)
        previous[order[1:][same]] = order[:-1][same]
        best = np.full(n, SHORTEST - 1, np.int32)
        where = np.zeros(n, np.int32)
        active = np.flatnonzero((previous >= 0) & (self.limit >= SHORTEST))
        active = active[active >= start]
        other = previous[active]
        for _ in range(chain):
            near = active - other <= WINDOW
            active, other = active[near], other[near]
            if not len(active):
                break
            # A longer match has the byte that would make it longer.
            grows = np.ones(len(active), bool) if every else data[other + best[active]] == data[active + best[active]]
            i, j = active[grows], other[grows]
            length = self._common(words, i, j, self.limit[i])
            longer = length > best[i]
            if every:
                places.append((i, length, i - j))
            else:
                places.append((i[longer], length[longer], (i - j)[longer]))
            best[i[longer]], where[i[longer]] = length[longer], (i - j)[longer]
            other = previous[other]
            on = (other >= 0) if every else (other >= 0) & (best[active] < self.limit[active])
            active, other = active[on], other[on]
        found = best >= SHORTEST
        self.best_length[found], self.best_distance[found] = best[found], where[found]

    @staticmethod
    def _common(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes the places share, eight at a time."""
        out = np.zeros(len(i), np.int32)
        live = np.arange(len(i))
        while len(live):
            a, b = words[i[live] + out[live]], words[j[live] + out[live]]
            differ = a ^ b
            whole = differ == 0
            low = differ[~whole]
            out[live[~whole]] += (np.log2((low & (~low + np.uint64(1))).astype(np.float64)) / 8).astype(np.int32)
            live = live[whole]
            out[live] += 8
            live = live[out[live] < most[live]]
        return np.minimum(out, most)

    def at(self, i: int) -> list[tuple[int, int]]:
        """(length, distance) of the listed matches of a position."""
        part = slice(self.first[i], self.first[i + 1])
        return list(zip(self.length[part].tolist(), self.distance[part].tolist()))


def lazy_tokens(data: bytes, matches: Matches, lo: int = 0, hi: int | None = None) -> Tokens:
    """Greedy parse of ``data[lo:hi]`` that waits one byte when the next match is longer."""
    hi = len(data) if hi is None else hi
    length, distance = matches.best_length[lo:hi].tolist(), matches.best_distance[lo:hi].tolist()
    raw = data[lo:hi]
    value_out: list[int] = []
    distance_out: list[int] = []
    i, n = 0, hi - lo
    while i < n:
        size = length[i]
        # A match of three bytes from far away costs more than they do.
        if size < SHORTEST or size == SHORTEST and distance[i] > 8192 or size < 64 and i + 1 < n and length[i + 1] > size:
            value_out.append(raw[i])
            distance_out.append(0)
            i += 1
        else:
            value_out.append(size)
            distance_out.append(distance[i])
            i += size
    return tokens_of(value_out, distance_out)


def histogram(tokens: Tokens) -> tuple[list[int], list[int]]:
    """Symbol counts of both alphabets; the end symbol counts once."""
    match = tokens.distance > 0
    symbols = np.where(match, LENGTH_SYMBOL[np.where(match, tokens.value, 0)], tokens.value)
    litlen = np.bincount(symbols, minlength=288).tolist()
    dist = np.bincount(DISTANCE_SYMBOL[tokens.distance[match]], minlength=32).tolist()
    litlen[END] = 1
    return litlen, dist


def shannon_costs(counts: list[int], cap: float = 15.0) -> list[float]:
    """Bits a symbol costs by its frequency; an unseen one costs what a single occurrence would, at most ``cap``."""
    total = sum(counts)
    if not total:
        return [math.log2(max(len(counts), 2))] * len(counts)
    return [min(cap, math.log2(total) - math.log2(n)) if n else min(cap, math.log2(total)) for n in counts]


#: Lengths that end a length symbol: within a symbol all lengths cost the same.
_LAST_OF_SYMBOL = [n for n in range(SHORTEST, LONGEST + 1) if n == LONGEST or LENGTH_SYMBOL[n] != LENGTH_SYMBOL[n + 1]]


def _reach(shortest: int, longest: int) -> list[int]:
    """Lengths of a match worth trying: all of them up to 32, then the last of each symbol and the whole match."""
    if longest <= 32:
        return list(range(shortest, longest + 1))
    return [*range(shortest, 33), *(n for n in _LAST_OF_SYMBOL if max(shortest, 33) <= n < longest), longest]


_REACH = {(a, b): _reach(a, b) for a in range(SHORTEST, 40) for b in range(a, LONGEST + 1)}


def shortest_path(data: bytes, matches: Matches, litlen: list[float], dist: list[float], lo: int = 0, hi: int | None = None) -> Tokens:
    """The cheapest token sequence of ``data[lo:hi]`` under the given symbol costs."""
    hi = len(data) if hi is None else hi
    n = hi - lo
    first = matches.first[lo : hi + 1].tolist()
    part = slice(first[0], first[-1])
    lengths, distances = matches.length[part].tolist(), matches.distance[part].tolist()
    symbols = DISTANCE_SYMBOL[matches.distance[part]]
    prices = (np.array(dist)[symbols] + DISTANCE_BITS[matches.distance[part]]).tolist()
    by_length = (np.array(litlen)[LENGTH_SYMBOL] + LENGTH_BITS).tolist()
    cost = [0.0] + [math.inf] * n
    size, far = [0] * (n + 1), [0] * (n + 1)
    base, raw = first[0], data[lo:hi]
    for i in range(n):
        here = cost[i]
        c = here + litlen[raw[i]]
        if c < cost[i + 1]:
            cost[i + 1], size[i + 1], far[i + 1] = c, 1, 0
        shortest, left = SHORTEST, n - i
        for s in range(first[i] - base, first[i + 1] - base):
            longest = lengths[s]
            if longest > left:
                longest = left
            if longest < SHORTEST:
                continue
            c0 = here + prices[s]
            for k in _REACH.get((shortest, longest)) or _reach(shortest, longest):
                c = c0 + by_length[k]
                if c < cost[i + k]:
                    cost[i + k], size[i + k], far[i + k] = c, k, distances[s]
            if not matches.every:
                shortest = longest + 1
                if shortest > left:
                    break
    value_out, distance_out, i = [], [], n
    while i:
        step, d = size[i], far[i]
        i -= step
        value_out.append(step if d else raw[i])
        distance_out.append(d)
    return tokens_of(value_out[::-1], distance_out[::-1])


def extra_bits(tokens: Tokens) -> int:
    match = tokens.distance > 0
    return int(LENGTH_BITS[tokens.value[match]].sum() + DISTANCE_BITS[tokens.distance[match]].sum())


def block_lengths(litlen: list[int], dist: list[int], search: int = 1) -> tuple[int, list[int], list[int]]:
    """Bits (header and symbols, without extra bits) and code lengths of the best way to smooth the counts and to limit
    the lengths: ``search`` 0 takes the counts as they are, 1 tries two smoothings, 2 also limits from 15 down to 9."""
    best, seen = None, set()
    ways = [lambda c: c, smoothed, strided][: 3 if search else 1]
    for limit in range(15, 8 if search > 1 else 14, -1):
        for way in ways:
            x, y = limited_lengths(way(litlen[:286]) + litlen[286:], limit), two_distance_codes(limited_lengths(way(dist[:30]) + dist[30:], limit))
            # A limit that no code reaches changes nothing.
            if (key := (*x, *y)) in seen:
                continue
            seen.add(key)
            bits = header_choice(x, y, min(search, 1))[0] + sum(n * k for n, k in zip(litlen, x)) + sum(n * k for n, k in zip(dist, y))
            if best is None or bits < best[0]:
                best = (bits, x, y)
    if search > 1:
        bits, x, y = best
        best = (bits - header_choice(x, y, 1)[0] + header_choice(x, y, search)[0], x, y)
    return best


def fixed_bits(litlen: list[int], dist: list[int]) -> int:
    return sum(n * k for n, k in zip(litlen, FIXED_LITLEN)) + 5 * sum(dist)


def block_bits(tokens: Tokens, search: int = 0) -> int:
    """Size of the better of a fixed and a dynamic block, ties to the fixed one."""
    litlen, dist = histogram(tokens)
    return 3 + extra_bits(tokens) + min(fixed_bits(litlen, dist), block_lengths(litlen, dist, search)[0])


def entropy_bits(tokens: Tokens) -> float:
    """A quick estimate of a dynamic block."""
    out = 300.0 + extra_bits(tokens)
    for counts in histogram(tokens):
        n = np.array([c for c in counts if c], np.float64)
        if len(n):
            out += float((n * np.minimum(15.0, np.log2(n.sum()) - np.log2(n))).sum())
    return out


class _Estimates:
    """``entropy_bits`` of any range of a parse, from counts kept at every 128th token."""

    STEP = 128

    def __init__(self, tokens: Tokens):
        match = tokens.distance > 0
        length = np.where(match, tokens.value, 0)
        self.symbols = np.where(match, LENGTH_SYMBOL[length], tokens.value)
        self.far = 288 + DISTANCE_SYMBOL[tokens.distance]
        self.match = match
        self.extra = np.concatenate([[0], np.cumsum(LENGTH_BITS[length] + DISTANCE_BITS[tokens.distance])])
        rows = len(tokens) // self.STEP
        upto = rows * self.STEP
        row = np.arange(upto) // self.STEP * 320
        flat = np.bincount(row + self.symbols[:upto], minlength=rows * 320) + np.bincount((row + self.far[:upto])[match[:upto]], minlength=rows * 320)
        self.counts = np.concatenate([np.zeros((1, 320), np.int64), np.cumsum(flat.reshape(rows, 320), axis=0)])

    def _upto(self, t: int) -> np.ndarray:
        row = t // self.STEP
        part = slice(row * self.STEP, t)
        rest = np.bincount(self.symbols[part], minlength=320) + np.bincount(self.far[part][self.match[part]], minlength=320)
        return self.counts[row] + rest

    def bits(self, counts: np.ndarray, extra: int) -> float:
        out = 300.0 + float(extra)
        for part in (counts[:288], counts[288:]):
            n = part[part > 0].astype(np.float64)
            if len(n):
                out += float((n * np.minimum(15.0, np.log2(n.sum()) - np.log2(n))).sum())
        return out

    def halves(self, lo: int, cut: int, hi: int) -> float:
        at, begin, end = self._upto(cut), self._upto(lo), self._upto(hi)
        return self.bits(at - begin, self.extra[cut] - self.extra[lo]) + self.bits(end - at, self.extra[hi] - self.extra[cut])

    def whole(self, lo: int, hi: int) -> float:
        return self.bits(self._upto(hi) - self._upto(lo), self.extra[hi] - self.extra[lo])


def split_points(tokens: Tokens, least: int, most: int = 0) -> list[int]:
    """Token indexes at which cutting lowers the estimated size, found by a 9-way narrowing search; the largest block is
    cut next, until none gains or there are ``most`` blocks (0: any number)."""
    out: list[int] = []
    if len(tokens) < 2 * least:
        return out
    estimates = _Estimates(tokens)
    work = [(-len(tokens), 0, len(tokens))]
    while work and (not most or len(out) + 1 < most):
        _, lo, hi = heapq.heappop(work)
        if hi - lo < 2 * least:
            continue
        a, b = lo + least, hi - least
        best = (math.inf, a)
        while a < b:
            step = max(1, (b - a) // 9)
            best = min(best, min((estimates.halves(lo, cut, hi), cut) for cut in range(a, b + 1, step)))
            a, b = max(a, best[1] - step + 1), min(b, best[1] + step - 1)
            if step <= 8:
                break
        if best[0] < estimates.whole(lo, hi):
            cut = best[1]
            out.append(cut)
            heapq.heappush(work, (lo - cut, lo, cut))
            heapq.heappush(work, (cut - hi, cut, hi))
    return sorted(out)


class BitWriter:
    """Bits from the low end of each byte."""

    def __init__(self):
        self.out, self.hold, self.count = bytearray(), 0, 0

    def bits(self, value: int, n: int) -> None:
        self.hold |= value << self.count
        self.count += n
        while self.count >= 8:
            self.out.append(self.hold & 255)
            self.hold >>= 8
            self.count -= 8

    def code(self, value: int, n: int) -> None:
        """A Huffman code: its first bit is its highest."""
        self.bits(int(f"{value:0{n}b}"[::-1], 2) if n else 0, n)

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """All values in a row, each of its own number of bits."""
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) - np.repeat(ends - sizes, sizes)
        bits = (np.repeat(values, sizes) >> place & 1).astype(np.uint8)
        held = np.array([self.hold >> k & 1 for k in range(self.count)], np.uint8)
        bits = np.concatenate([held, bits])
        whole = len(bits) // 8 * 8
        self.out += np.packbits(bits[:whole], bitorder="little").tobytes()
        self.hold, self.count = sum(int(b) << k for k, b in enumerate(bits[whole:])), len(bits) - whole

    def align(self) -> None:
        if self.count:
            self.bits(0, 8 - self.count)

    def finish(self) -> bytes:
        self.align()
        return bytes(self.out)


def cheaper_literals(tokens: Tokens, raw: bytes, litlen: list[int], dist: list[int]) -> Tokens:
    """Short matches whose bytes cost less as literals, all of which have codes, become literals."""
    lit = np.array(litlen[:256])
    at = np.cumsum(tokens.sizes) - tokens.sizes
    short = np.flatnonzero((tokens.distance > 0) & (tokens.value <= 7))
    if not len(short):
        return tokens
    price = np.where(lit > 0, lit, 1 << 20)[np.frombuffer(raw, np.uint8)]
    upto = np.concatenate([[0], np.cumsum(price)])
    length, far = tokens.value[short], tokens.distance[short]
    as_match = np.array(litlen)[LENGTH_SYMBOL[length]] + LENGTH_BITS[length] + np.array(dist)[DISTANCE_SYMBOL[far]] + DISTANCE_BITS[far]
    cheap = np.zeros(len(tokens), bool)
    cheap[short] = upto[at[short] + length] - upto[at[short]] < as_match
    counts = np.where(cheap, tokens.value, 1)
    origin = np.repeat(np.arange(len(tokens)), counts)
    place = at[origin] + np.arange(len(origin)) - (np.cumsum(counts) - counts)[origin]
    literal = cheap[origin]
    value = np.where(literal, np.frombuffer(raw, np.uint8)[place], tokens.value[origin]).astype(np.int32)
    return Tokens(value, np.where(literal, 0, tokens.distance[origin]).astype(np.int32))


def _reversed_codes(lengths: list[int]) -> np.ndarray:
    return np.array([int(f"{c:0{n}b}"[::-1], 2) if n else 0 for c, n in zip(canonical_codes(lengths), lengths)], np.int64)


def _write_tokens(w: BitWriter, tokens: Tokens, litlen: list[int], dist: list[int]) -> None:
    lc, dc, ln, dn = _reversed_codes(litlen), _reversed_codes(dist), np.array(litlen), np.array(dist)
    match = tokens.distance > 0
    length, far = np.where(match, tokens.value, 0), tokens.distance
    symbol = np.where(match, LENGTH_SYMBOL[length], tokens.value)
    none = np.zeros(len(tokens), np.int64)
    d = DISTANCE_SYMBOL[far]
    values = np.stack([lc[symbol], np.where(match, LENGTH_EXTRA[length], none), np.where(match, dc[d], none), np.where(match, DISTANCE_EXTRA[far], none)], axis=1)
    sizes = np.stack([ln[symbol], np.where(match, LENGTH_BITS[length], none), np.where(match, dn[d], none), np.where(match, DISTANCE_BITS[far], none)], axis=1)
    w.many(np.append(values.ravel(), lc[END]), np.append(sizes.ravel(), ln[END]))


def write_block(w: BitWriter, tokens: Tokens, raw: bytes, final: bool, search: int = 1) -> None:
    """The smallest of a stored, a fixed and a dynamic block."""
    litlen, dist = histogram(tokens)
    extra = extra_bits(tokens)
    fixed = fixed_bits(litlen, dist)
    bits, x, y = block_lengths(litlen, dist, search)
    plainer = cheaper_literals(tokens, raw, x, y)
    if len(plainer) > len(tokens) and block_bits(plainer, search) < 3 + extra + min(fixed, bits):
        tokens, (litlen, dist), extra = plainer, histogram(plainer), extra_bits(plainer)
        fixed, (bits, x, y) = fixed_bits(litlen, dist), block_lengths(litlen, dist, search)
    stored = 8 * len(raw) + 40 * max(1, -(-len(raw) // 65535))
    if stored < min(fixed, bits) + extra:
        chunks = [raw[i : i + 65535] for i in range(0, len(raw), 65535)] or [b""]
        for k, chunk in enumerate(chunks):
            w.bits(int(final and k == len(chunks) - 1), 3)
            w.align()
            w.out += len(chunk).to_bytes(2, "little") + (len(chunk) ^ 65535).to_bytes(2, "little") + chunk
    elif fixed <= bits:
        w.bits(int(final) | 2, 3)
        _write_tokens(w, tokens, FIXED_LITLEN, FIXED_DIST)
    else:
        w.bits(int(final) | 4, 3)
        _, coded, lengths, hlit, hdist = header_choice(x, y, search)
        count = max(4, max((i + 1 for i, s in enumerate(CODE_LENGTH_ORDER) if lengths[s]), default=4))
        w.bits(hlit - 257, 5)
        w.bits(hdist - 1, 5)
        w.bits(count - 4, 4)
        for s in CODE_LENGTH_ORDER[:count]:
            w.bits(lengths[s], 3)
        codes = canonical_codes(lengths)
        for s, value in coded:
            w.code(codes[s], lengths[s])
            w.bits(value, EXTRA_BITS.get(s, 0))
        _write_tokens(w, tokens, x, y)


def optimal_tokens(data: bytes, matches: Matches, passes: int, lo: int = 0, hi: int | None = None, start: Tokens | None = None) -> Tokens:
    """Lazy tokens (or ``start``), then shortest paths under the costs of the last parse; the smallest parse wins.

    Once passes stop to help, costs are moved at random, the same way in every run.
    """
    best = lazy_tokens(data, matches, lo, hi) if start is None else start
    if not passes:
        return best
    size, current, costs, random = block_bits(best), best, None, np.random.default_rng(1)
    stale = 0
    for k in range(passes):
        litlen, dist = histogram(current)
        fresh = shannon_costs(litlen), shannon_costs(dist)
        # Later passes move half-way, which keeps the search from swinging between two parses.
        costs = fresh if costs is None or k < 3 else tuple([(a + b) / 2 for a, b in zip(x, y)] for x, y in zip(costs, fresh))
        if stale:
            costs = tuple((np.array(x) * random.uniform(0.9, 1.1, len(x))).tolist() for x in costs)
        current = shortest_path(data, matches, *costs, lo, hi)
        bits = block_bits(current)
        if bits < size:
            best, size, stale = current, bits, 0
        else:
            stale += 1
            if stale > 3:
                break
    return best


def deflate(data: bytes, level: int = 5, master: int = 1_000_000, passes: int | None = None, rounds: int = 0, window: bytes = b"", final: bool = True) -> bytes:
    """A raw DEFLATE stream of ``data``; empty input is one fixed block.

    Master blocks of ``master`` bytes are parsed one by one, each with the 32 KiB before it as its window (``window``: what
    comes before the first).  ``passes`` overrides the level's; each of ``rounds`` parses every block again by its own
    statistics and divides anew.  A stream that is not ``final`` ends at a byte border with an empty stored block, so
    that another may follow it.
    """
    p = LEVELS[max(1, min(level, 9))]
    w = BitWriter()
    if not data and final:
        write_block(w, tokens_of([], []), b"", True)
        return w.finish()
    whole = window[-WINDOW:] + data
    for lo in range(len(whole) - len(data), len(whole), master):
        before, hi = max(0, lo - WINDOW), min(lo + master, len(whole))
        part, begin = whole[before:hi], lo - before
        matches = Matches(part, p.chain, start=begin, every=p.every)
        times = p.passes if passes is None else passes
        tokens = optimal_tokens(part, matches, times, begin)
        for n in range(rounds + 1):
            cuts = [0, *(split_points(tokens, p.least_split) if p.split else []), len(tokens)]
            if n < rounds:
                places = begin + np.concatenate([[0], np.cumsum(tokens.sizes)])[cuts]
                again = [optimal_tokens(part, matches, max(times, 1), int(a), int(b), tokens[c:d]) for a, b, c, d in zip(places, places[1:], cuts, cuts[1:])]
                tokens = Tokens(np.concatenate([t.value for t in again]), np.concatenate([t.distance for t in again]))
        at = begin
        for a, b in zip(cuts, cuts[1:]):
            size = int(tokens[a:b].sizes.sum())
            write_block(w, tokens[a:b], part[at : at + size], final and hi == len(whole) and b == len(tokens), p.search)
            at += size
    if not final:
        w.bits(0, 3)
        w.align()
        w.out += b"\0\0\xff\xff"
    return w.finish()


def inflate(data: bytes, limit: int = 0) -> bytes:
    """Strict: truncated or trailing bytes are errors."""
    d = zlib.decompressobj(-15)
    out = d.decompress(data, limit) if limit else d.decompress(data)
    if not d.eof or d.unused_data:
        raise ValueError("not one whole DEFLATE stream")
    return out


def best_deflate(data: bytes, level: int = 6, passes: int | None = None, rounds: int = 0) -> bytes:
    """The smallest of zlib's strategies at its best effort and, from level 3 on, of this encoder."""
    found = []
    for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FILTERED, zlib.Z_RLE, zlib.Z_HUFFMAN_ONLY, zlib.Z_FIXED):
        c = zlib.compressobj(9, zlib.DEFLATED, -15, 9, strategy)
        found.append(c.compress(data) + c.flush())
        if level <= 1:
            break
    if level >= 3:
        found.append(deflate(data, level, passes=passes, rounds=rounds))
    return min(found, key=len)
