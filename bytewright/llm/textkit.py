"""Word and shingle kernels over Arrow string buffers (NumPy, no per-word Python).

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D.  These bytes never occur inside a
multi-byte UTF-8 sequence, so working on the raw bytes equals working on code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Words longer than this are hashed by a keyed digest, the others eight bytes at a time.
_LONG = 256
_KEY = b"bytewright words"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: bijective, every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; a null counts as empty."""
    if pa.types.is_string_view(column.type) or pa.types.is_dictionary(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with at most ``limit`` text bytes each (a longer text stands alone)."""
    _, offsets = text_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every row (n + 1 entries)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word.

    Words are absorbed eight bytes at a time, each step a bijection of the state, so words of up to eight bytes never
    share a hash with others of their length; longer than ``_LONG`` bytes they are hashed by BLAKE2.  No family of
    words collides by its form.
    """
    low = np.empty(len(data) + 8, np.uint8)
    low[: len(data)] = _LOWER[data] if lower else data
    low[len(data) :] = 0
    chunks = np.ndarray(len(data) + 1, dtype="<u8", buffer=low, strides=(1,))
    sizes = ends - starts
    masks = U(0xFFFFFFFFFFFFFFFF) >> (U(8) * np.arange(8, -1, -1).astype(U)) % U(64)
    masks[0] = U(0)
    masks[8] = U(0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        out = mix((chunks[starts] & masks[np.minimum(sizes, 8)]) ^ (sizes.astype(U) * U(0xD6E8FEB86659FD93)))
        live = np.flatnonzero((sizes > 8) & (sizes <= _LONG))
        done = 8
        while len(live):
            at = starts[live] + done
            part = chunks[at] & masks[np.minimum(ends[live] - at, 8)]
            out[live] = mix((out[live] * U(0x9FB21C651E98DF25)) ^ mix(part + U(done)))
            done += 8
            live = live[sizes[live] > done]
    for k in np.flatnonzero(sizes > _LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(low[starts[k] : ends[k]], digest_size=8, key=_KEY).digest(), "little")
    return out


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (row borders are the caller's concern)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=U)
        for j in range(k):
            total *= U(0xD1342543DE82EF95)
            total += words[j : j + n]
        return mix(total + U((seed * 0x9E3779B97F4A7C15 + k) % (1 << 64)))


def shingles(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingle hashes of each row, sorted, with n + 1 row bounds.

    A row of 1 to k - 1 words has one shingle, its whole sequence; a row without words has none.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), n)
    out = np.empty(int(n.sum()), dtype=U)
    at = np.concatenate([[0], np.cumsum(n)])
    if len(out):
        grams = gram_hashes(words, k)
        inner = np.repeat(counts >= k, n)
        pos = np.arange(len(out)) - at[row] + bounds[row]
        out[inner] = grams[pos[inner]]
        for i in np.flatnonzero((counts > 0) & (counts < k)):
            out[at[i]] = gram_hashes(words[bounds[i] : bounds[i + 1]], int(counts[i]), seed=1)[0]
        for i in np.flatnonzero(n > 1):
            out[at[i] : at[i + 1]].sort()
        first = np.ones(len(out), dtype=bool)
        first[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
        out, row = out[first], row[first]
        at = np.searchsorted(row, np.arange(len(counts) + 1))
    return out, at
