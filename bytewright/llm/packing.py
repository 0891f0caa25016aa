"""Packing tokenised documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .textkit import slices, text_buffers, word_hashes, word_spans

#: Text encoded at a time.
_SLICE = 2 << 20
#: Most pieces whose ids are remembered, at about 30 bytes each.
_KNOWN = 1 << 19
#: Most ids in a batch that a task emits.
_BATCH_IDS = 1 << 20

# How the tokenizer file cuts lower-cased text: contractions, runs of letters, single digits, runs of anything else.
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_LAST = 0x24F


def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of the characters up to U+024F; odd ones are those whose word the library must encode."""
    kinds, lower = np.full(_LAST + 1, _ODD, np.uint8), np.arange(_LAST + 1, dtype=np.uint16)
    for code in range(_LAST + 1):
        char = chr(code)
        low = char.lower()
        if len(low) == 1 and ord(low) < 0x800 and (code < 0x80) == (ord(low) < 0x80) and (0x20 < code < 0x7F or code > 0xA0 and code != 0xAD):
            kinds[code] = _LETTER if regex.match(r"\p{L}", low) else _DIGIT if regex.match(r"\p{N}", low) else _MARK
            lower[code] = ord(low)
    kinds[[0x20, *range(0x09, 0x0E)]] = _SPACE
    return kinds, lower


_KINDS, _LOWER = _alphabet()


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and oddness of every piece; an odd word is one piece, in its own case."""
    kinds, low = np.full(len(data), _ODD, np.uint8), data.copy()
    plain = data < 0x80
    kinds[plain], low[plain] = _KINDS[data[plain]], _LOWER[data[plain]]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC0 | _LAST >> 6))
    code = (data[lead] & 31).astype(np.uint16) << 6 | data[lead + 1] & 63
    lead, code = lead[code <= _LAST], code[code <= _LAST]
    small = _LOWER[code]
    kinds[lead] = kinds[lead + 1] = _KINDS[code]
    low[lead], low[lead + 1] = 0xC0 | small >> 6, 0x80 | small & 63
    starts, ends, _ = word_spans(data, offsets)
    if not len(starts):
        return low, starts, ends, np.zeros(0, bool)
    special = np.zeros(len(data), bool)
    special[:-1] = (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    odd_word = np.add.reduceat(((kinds == _ODD) | special).astype(np.int64), starts) > 0
    # A piece begins with its word, where the class changes, and at every digit.
    begin = np.zeros(len(data) + 1, bool)
    begin[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
    begin[lead + 1] = False
    begin[starts] = True
    # Contractions: a mark that begins a piece and the letters after it, inside the word.
    limit = np.zeros(len(data) + 4, np.uint8)
    limit[: len(data)] = low
    edge = np.ones(len(data) + 4, bool)
    edge[: len(data)] = begin[:-1]
    word_edge = np.ones(len(data) + 4, bool)
    word_edge[: len(data)] = kinds == _SPACE
    word_edge[starts] = True
    at = np.flatnonzero((data == 0x27) & begin[:-1])
    one, two = limit[at + 1], limit[at + 2]
    single = np.isin(one, list(b"stmd")) & ~word_edge[at + 1]
    double = (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)) & ~word_edge[at + 1] & ~word_edge[at + 2]
    for chosen, size in ((at[single], 2), (at[double & ~single], 3)):
        begin[chosen + 1] = False
        after = chosen + size
        begin[after[after < len(data)]] = True
    # Inside odd words there are no cuts, and the case stays.
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, starts[odd_word], 1)
    np.add.at(inside, ends[odd_word], -1)
    odd = np.cumsum(inside)[:-1] > 0
    low[odd] = data[odd]
    begin[:-1][odd] = False
    begin[starts] = True
    solid = kinds != _SPACE
    first = np.flatnonzero(begin[:-1] & solid)
    stop = np.zeros(len(data) + 1, bool)
    stop[first] = True
    stop[ends] = True
    marks = np.flatnonzero(stop)
    return low, first, marks[np.searchsorted(marks, first, side="right")], odd[first]


class WordIds:
    """Token ids of whole texts, piece by piece: equal to encoding each text, as no piece crosses white space.

    Words of plain characters are cut into pieces over the bytes of many texts at once; the library encodes each
    distinct piece, and each distinct word that holds another character.  The ids of at most ``_KNOWN`` pieces are
    remembered, in arrays ordered by the pieces' hashes.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.model = self.whole.model
        # The printable stand-in of every byte that byte-level vocabularies use.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = (b for b in range(256) if b not in set(shown))
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.forget()

    def forget(self) -> None:
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, pieces: list[tuple[bytes, bool]]) -> None:
        """Remember the ids of pieces whose hashes, in order, are none of the known ones."""
        if len(self.places) + len(pieces) > _KNOWN:
            self.forget()
        tokenize, alphabet = self.model.tokenize, self.alphabet
        lists = [self.whole.encode(p.decode(), add_special_tokens=False).ids if odd else [t.id for t in tokenize(p.decode("latin-1").translate(alphabet))] for p, odd in pieces]
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        at = np.searchsorted(self.hashes, hashes)
        self.places = np.insert(self.places, at, np.arange(len(self.bounds) - 1, len(self.bounds) - 1 + len(lists)))
        self.hashes = np.insert(self.hashes, at, hashes)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int32, count=int(sizes.sum()))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and n + 1 bounds."""
        data, offsets = text_buffers(texts)
        low, first, stop, odd = _pieces(data, offsets) if len(data) else (data, *[np.zeros(0, np.int64)] * 2, np.zeros(0, bool))
        if not len(first):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        marked = word_hashes(low, first, stop) ^ np.where(odd, np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0))
        distinct, sample, codes = np.unique(marked, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inner = at < len(self.hashes)
        new[inner] = self.hashes[at[inner]] != distinct[inner]
        if len(self.places) + int(new.sum()) > _KNOWN:
            self.forget()
            new[:] = True
        raw, some = low.tobytes(), sample[new]
        self._learn(distinct[new], [(raw[a:b], o) for a, b, o in zip(first[some].tolist(), stop[some].tolist(), odd[some].tolist())])
        place = self.places[np.searchsorted(self.hashes, distinct)][codes]
        begin = self.bounds[place]
        counts = self.bounds[place + 1] - begin
        ends = np.cumsum(counts)
        source = np.repeat(begin - (ends - counts), counts)
        source += np.arange(len(source))
        return self.ids[source], np.concatenate([[0], ends])[np.searchsorted(first, offsets)]


class Windows:
    """Open windows by remaining room, under a segment tree of counts; the tightest that fits is found by descent."""

    def __init__(self, room: int):
        self.leaves = 1 << room.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(room + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room of at least ``size``."""
        count, node = self.count, size + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of each piece, and the number of windows; no piece is longer than ``window``."""
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, used = Windows(window), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        found = tree.take(size)
        if found is None:
            room, at, used = window, used, used + 1
        else:
            room, at = found
        number[k], offset[k] = at, window - room
        if room > size:
            tree.add(room - size, at)
    return number, offset, used


@dataclass(frozen=True)
class PackParams:
    """``group_tokens`` bounds what a task holds: its documents are packed in groups of about that many tokens, four
    bytes each; a longer document is a group of its own."""

    tokenizer: str
    window: int = 2048
    end_id: int = 1
    group_tokens: int = 4_000_000


SCHEMA = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


class _Group:
    """The documents that are packed together: one array of ids that grows, and each document's id and size."""

    def __init__(self, p: PackParams):
        self.p, self.ids, self.held = p, np.empty(0, np.int32), 0
        self.names: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []

    def add(self, names: pa.Array, ids: np.ndarray, at: np.ndarray) -> None:
        """Append documents, each followed by the end id."""
        counts = np.diff(at) + 1
        total = int(counts.sum())
        if self.held + total > len(self.ids):
            grown = np.empty(max(self.held + total, min(2 * len(self.ids), self.p.group_tokens)), np.int32)
            grown[: self.held] = self.ids[: self.held]
            self.ids = grown
        part = self.ids[self.held : self.held + total]
        last = np.cumsum(counts) - 1
        inner = np.ones(total, bool)
        inner[last] = False
        part[inner], part[last] = ids, self.p.end_id
        self.held += total
        self.names.append(names)
        self.sizes.append(counts)

    def flush(self, first: int) -> Iterator[pa.RecordBatch]:
        """Cut, place and emit the documents, windows numbered from ``first``; returns the next number."""
        if not self.sizes:
            return first
        window = self.p.window
        sizes, names = np.concatenate(self.sizes), pa.concat_arrays(self.names)
        at = np.concatenate([[0], np.cumsum(sizes)])
        pieces = -(-sizes // window)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        start = (np.arange(len(doc)) - (np.cumsum(pieces) - pieces)[doc]) * window
        total = sizes[doc]
        length = np.minimum(window, total - start)
        number, offset, used = best_fit_decreasing(length, window)
        ends = np.cumsum(length)
        s = 0
        while s < len(doc):
            e = max(s + 1, int(np.searchsorted(ends, ends[s] - length[s] + _BATCH_IDS, side="right")))
            steps = np.concatenate([[0], np.cumsum(length[s:e])]).astype(np.int32)
            lo = int(at[doc[s]] + start[s])
            ids = pa.ListArray.from_arrays(pa.array(steps), pa.array(self.ids[lo : lo + int(steps[-1])]))
            columns = [names.take(pa.array(doc[s:e])), pa.array(start[s:e]), pa.array(length[s:e]), ids, pa.array(total[s:e]), pa.array(first + number[s:e]), pa.array(offset[s:e])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            s = e
        self.names, self.sizes, self.held = [], [], 0
        return first + used


def _pack(p: PackParams, spec: bytes, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(zlib.decompress(spec).decode())
        first = TaskContext.get().partitionId() << 40
        group = _Group(p)
        done = finish or (lambda batch: batch)

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal first
            parts = group.flush(first)
            while True:
                try:
                    batch = next(parts)
                except StopIteration as end:
                    first = end.value
                    return
                yield done(batch)

        for batch in batches:
            for i, j in slices(batch.column(1), _SLICE):
                group.add(batch.column(0).slice(i, j - i), *words.encode(batch.column(1).slice(i, j - i)))
                if group.held >= p.group_tokens:
                    yield from emit()
        yield from emit()

    return run


def pack_documents(docs: DataFrame, params: PackParams, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = SCHEMA) -> DataFrame:
    """Tokenise ``docs(doc_id, text, ...)`` and pack them into sequences of at most ``window`` ids.

    Returns one row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.  A document's ids
    end with ``end_id``; one longer than a window is first cut into full windows, and what remains is placed by
    best fit, longest first; pieces of equal length keep the order of their rows.  Null and empty texts are the end
    id alone.  Repeated rows and repeated or null ids are packed each for itself; an empty table gives no rows; extra
    columns are ignored; a text of any length is tokenised whole, its ids held by one task.

    Tasks pack what they tokenise, so nothing is shuffled; each group of ``group_tokens`` leaves at most a few
    windows unfilled.  ``finish`` maps each output batch inside the task (to ``schema``), for callers that need
    only something derived from the ids.
    """
    spec = zlib.compress(Path(params.tokenizer).read_bytes())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, _pack(params, spec, finish), schema)
