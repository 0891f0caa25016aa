"""Length-limited Huffman codes, canonical codes and DEFLATE's code-length header (RFC 1951)."""

from __future__ import annotations

import itertools

# Fixed value: the order in which RFC 1951 stores the lengths of the code-length code.
CODE_LENGTH_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def limited_lengths(counts: list[int], limit: int) -> list[int]:
    """Optimal code lengths of at most ``limit`` bits; of equal weights the smaller symbol has the longer code.

    A plain Huffman tree serves if it is flat enough, else the coin-collector form of package-merge.  Unused symbols get
    0; a single used symbol gets 1.
    """
    used = sorted((n, s) for s, n in enumerate(counts) if n)
    out = [0] * len(counts)
    if not used:
        return out
    if len(used) == 1:
        out[used[0][1]] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("too many symbols for the limit")
    weights = [n for n, _ in used]
    depths = _tree_depths(weights)
    if max(depths) > limit:
        depths = _package_merge(weights, limit)
    for (_, s), depth in zip(used, sorted(depths, reverse=True)):
        out[s] = depth
    return out


def _tree_depths(weights: list[int]) -> list[int]:
    """Leaf depths of a Huffman tree over ascending weights, by the two-queue method."""
    n = len(weights)
    nodes, parent = list(weights), [0] * (2 * n - 1)
    leaf, inner = 0, n
    for k in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (inner >= k or nodes[leaf] <= nodes[inner]):
                pick, leaf = leaf, leaf + 1
            else:
                pick, inner = inner, inner + 1
            parent[pick] = k
            total += nodes[pick]
        nodes.append(total)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return depth[:n]


def _package_merge(weights: list[int], limit: int) -> list[int]:
    """Leaf depths of at most ``limit`` over ascending weights.

    Each level merges the leaves with pairs of the level before; the items that are taken from a level are its first
    ones, so it is enough to know how many leaves are among them.
    """
    levels: list[list[bool]] = []
    row = list(weights)
    levels.append([True] * len(row))
    for _ in range(limit - 1):
        pairs = [a + b for a, b in zip(row[::2], row[1::2])]
        merged = sorted([(w, False, k) for k, w in enumerate(weights)] + [(w, True, k) for k, w in enumerate(pairs)])
        row = [w for w, _, _ in merged]
        levels.append([not pair for _, pair, _ in merged])
    depths, take = [0] * len(weights), 2 * len(weights) - 2
    for kinds in reversed(levels):
        leaves = sum(kinds[:take])
        for k in range(leaves):
            depths[k] += 1
        take = 2 * (take - leaves)
    return depths


def canonical_codes(lengths: list[int]) -> list[int]:
    """Codes by length, then symbol; 0 for unused symbols."""
    out, code = [0] * len(lengths), 0
    for bits in range(1, max(lengths, default=0) + 1):
        code <<= 1
        for s, n in enumerate(lengths):
            if n == bits:
                out[s] = code
                code += 1
    return out


def kraft_sum(lengths: list[int]) -> float:
    return sum(2.0**-n for n in lengths if n)


def two_distance_codes(lengths: list[int]) -> list[int]:
    """Some decoders want two distance codes at least: unused ones are given one bit."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) >= 2:
        return lengths
    out = list(lengths)
    for s in (0, 1):
        if sum(1 for n in out if n) < 2 and not out[s]:
            out[s] = 1
    return out


def runs(values: list[int]) -> list[tuple[int, int]]:
    """(value, length) of each run of equal values."""
    return [(v, len(list(g))) for v, g in itertools.groupby(values)]


def rle_code_lengths(lengths: list[int], use16: bool = True, use17: bool = True, use18: bool = True, even: bool = False) -> list[tuple[int, int]]:
    """(symbol, extra value) of the code-length alphabet: 16 repeats the last, 17 and 18 are runs of zeros.

    ``even`` divides 7 or 8 repeats into two runs, where otherwise one or two lengths would stand alone.
    """
    out: list[tuple[int, int]] = []
    for value, n in runs(lengths):
        if value == 0:
            while use18 and n >= 11:
                k = min(n, 138)
                out.append((18, k - 11))
                n -= k
            while use17 and n >= 3:
                k = min(n, 10)
                out.append((17, k - 3))
                n -= k
        elif use16 and n >= 4:
            out.append((value, 0))
            n -= 1
            while n >= 3:
                k = n // 2 if even and n in (7, 8) else min(n, 6)
                out.append((16, k - 3))
                n -= k
        out.extend([(value, 0)] * n)
    return out


EXTRA_BITS = {16: 2, 17: 3, 18: 7}


def header_choice(litlen: list[int], dist: list[int], search: int = 1) -> tuple[int, list[tuple[int, int]], list[int], int, int]:
    """The cheapest header of a dynamic block: its bits, run symbols, code-length lengths, HLIT and HDIST.

    ``search`` 0 takes all run symbols; 1 tries each set of them; 2 also both ways to divide repeats.
    """
    hlit = max(257, max((s + 1 for s, n in enumerate(litlen) if n), default=257))
    hdist = max(1, max((s + 1 for s, n in enumerate(dist) if n), default=1))
    sequence = litlen[:hlit] + dist[:hdist]
    best = None
    ways = [(True, True, True, False)] if not search else itertools.product(*[(True, False)] * 3, (False, True) if search > 1 else (False,))
    for flags in ways:
        coded = rle_code_lengths(sequence, *flags)
        counts = [0] * 19
        for s, _ in coded:
            counts[s] += 1
        lengths = limited_lengths(counts, 7)
        stored = max(4, max((i + 1 for i, s in enumerate(CODE_LENGTH_ORDER) if lengths[s]), default=4))
        bits = 14 + 3 * stored + sum(lengths[s] * n for s, n in enumerate(counts)) + sum(EXTRA_BITS[s] * counts[s] for s in EXTRA_BITS)
        if best is None or bits < best[0]:
            best = (bits, coded, lengths, hlit, hdist)
    return best


def smoothed(counts: list[int], spread: int = 4) -> list[int]:
    """Counts with runs of similar values replaced by their mean, which makes their lengths cheaper to store."""
    out, i = list(counts), 0
    while i < len(out):
        j, low, high = i, out[i], out[i]
        while j + 1 < len(out) and out[j + 1] and max(high, out[j + 1]) - min(low, out[j + 1]) <= spread:
            j += 1
            low, high = min(low, out[j]), max(high, out[j])
        if j - i >= 3 and low:
            out[i : j + 1] = [max(1, round(sum(out[i : j + 1]) / (j + 1 - i)))] * (j + 1 - i)
        i = j + 1
    return out


def strided(counts: list[int]) -> list[int]:
    """Counts whose stretches near one mean are levelled, but for runs that are cheap to store as they are: five zeros or
    seven equal values."""
    out, fixed, at = list(counts), [False] * len(counts), 0
    for value, n in runs(counts):
        if n >= (5 if value == 0 else 7):
            fixed[at : at + n] = [True] * n
        at += n
    i = 0
    while i < len(out):
        j, total = i, 0
        while j < len(out) and not fixed[j] and (j == i or abs(out[j] * (j - i) - total) < 4 * (j - i)):
            total += out[j]
            j += 1
        if j - i >= 4:
            level = max(1, round(total / (j - i))) if total else 0
            out[i:j] = [level if n or total else 0 for n in out[i:j]]
        i = max(j, i + 1)
    return out
