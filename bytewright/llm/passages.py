"""Substring dedup: repeated-phrase automata over word sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .common import discard, settle
from .textkit import U, gram_hashes, mix, slices, text_buffers, word_hashes, word_spans


@dataclass(frozen=True)
class PassageParams:
    """A passage is ``window`` words.  Its anchor is the phrase of ``phrase`` words in it that has the least hash (the first
    of equal ones), the same in every document.  ``shard_bytes`` of text share an automaton."""

    window: int = 50
    phrase: int = 8
    shard_bytes: int = 2 << 20

    @property
    def run(self) -> int:
        return self.window - self.phrase + 1


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value of each run of ``width``, by doubling."""
    out, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = out[: len(out) - step], out[step:]
        out = np.where(values[right] < values[left], right, left)
        have += step
    return out


@dataclass
class Words:
    """The words of some rows, joined by single spaces: ``joined`` has one before the first and after each word."""

    joined: bytes
    begin: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def text(self, lo: int, hi: int) -> bytes:
        return self.joined[self.begin[lo] : self.begin[hi] - 1] if lo < hi else b""


def words_of(column: pa.Array) -> Words:
    data, offsets = text_buffers(column)
    starts, ends, bounds = word_spans(data, offsets)
    sizes = ends - starts
    begin = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
    narrow = np.int32 if len(data) < 1 << 30 else np.int64
    source = np.repeat((starts - begin[:-1]).astype(narrow), sizes + 1) + np.arange(1, begin[-1], dtype=narrow)
    padded = np.append(data, np.uint8(32))
    joined = np.full(int(begin[-1]), 32, np.uint8)
    joined[1:] = padded[source]
    joined[begin[1:] - 1] = 32
    return Words(joined.tobytes(), begin, bounds, word_hashes(data, starts, ends))


def segments(words: Words, p: PassageParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one row that have the same anchor: first window, number of windows, the anchor's place and
    its hash.  Windows never cross rows; a row shorter than a window has none."""
    none = np.zeros(0, np.int64)
    if len(words.hashes) < p.window:
        return none, none, none, np.zeros(0, U)
    grams = gram_hashes(words.hashes, p.phrase, seed=9)
    inside = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    long = np.flatnonzero(np.diff(words.bounds) >= p.window)
    np.add.at(inside, words.bounds[long], 1)
    np.add.at(inside, words.bounds[long + 1] - p.window + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[: len(grams) - p.run + 1])
    if not len(windows):
        return none, none, none, np.zeros(0, U)
    anchor = _first_least(grams, p.run)[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    return windows[first], np.diff(np.append(first, len(windows))), anchor[first], grams[anchor[first]]


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _rows(words: Words, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.bounds, places, side="right") - 1


def _find_anchors(p: PassageParams):
    """Per document the hashes of its anchors, and the digest of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1), 1 << 20):
                words = words_of(batch.column(1).slice(i, j - i))
                at, _, _, hashes = segments(words, p)
                steps = np.searchsorted(_rows(words, at), np.arange(j - i + 1)).astype(np.int32)
                whole = [hashlib.sha256(words.text(a, b)).digest() for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(words.bounds)), pa.array(whole, pa.binary()), pa.ListArray.from_arrays(pa.array(steps), pa.array(hashes.view(np.int64)))],
                    names=["doc_id", "tag", "n_words", "whole", "phrases"],
                )

    return run


def _locate(p: PassageParams):
    """Compile the recurring phrases of a shard of documents and stream the documents through the automaton.

    Emits the runs of windows whose anchor was located, with the digest of their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for batch in batches:
            for i, j in slices(batch.column(1), p.shard_bytes):
                part = batch.slice(i, j - i)
                words = words_of(part.column(1))
                at, count, anchor, hashes = segments(words, p)
                row = _rows(words, at)
                known, lists = part.column(3).flatten().to_numpy(), part.column(3).offsets.to_numpy()
                owner = np.repeat(np.arange(j - i), np.diff(lists))
                wanted = np.isin(_keyed(hashes, row), _keyed(known.view(U), owner))
                at, count, anchor, hashes, row = (x[wanted] for x in (at, count, anchor, hashes, row))
                if not len(at):
                    continue
                machine = ahocorasick.Automaton()
                for phrase in {words.text(a, a + p.phrase) for a in anchor.tolist()}:
                    machine.add_word(f" {phrase.decode('latin-1')} ", len(phrase) + 2)
                machine.make_automaton()
                found = np.fromiter((last + 2 - size for last, size in machine.iter(words.joined.decode("latin-1"))), np.int64)
                seen = np.isin(words.begin[anchor], found)
                at, count, hashes, row = (x[seen] for x in (at, count, hashes, row))
                digests = [_digest(words.text(a, a + n - 1 + p.window)) for a, n in zip(at.tolist(), count.tolist())]
                picked = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(digests, pa.binary()), part.column(0).take(picked), part.column(2).take(picked), pa.array((at - words.bounds[row]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["phrase", "segment", "doc_id", "tag", "at", "n"],
                )

    return run


def _keyed(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(hashes + row.astype(U) * U(0x9E3779B97F4A7C15))


def _windows(p: PassageParams):
    """The digest of the text of each window in the given runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1), 1 << 20):
                part = batch.slice(i, j - i)
                words = words_of(part.column(1))
                row, at = _spans(part.column(3))
                first = words.bounds[row] + at[0]
                count = at[1]
                every = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                owner = np.repeat(row, count)
                for s in range(0, len(every), 1 << 16):
                    some, rows = every[s : s + (1 << 16)], owner[s : s + (1 << 16)]
                    picked = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_digest(words.text(w, w + p.window)) for w in some.tolist()], pa.binary()), part.column(0).take(picked), part.column(2).take(picked), pa.array((some - words.bounds[rows]).astype(np.int32))],
                        names=["window", "doc_id", "tag", "at"],
                    )

    return run


def _spans(column: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Row, first window and number of windows of all runs in a list column."""
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    flat = column.flatten()
    return row, (flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64))


def _remove(p: PassageParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1), 1 << 20):
                part = batch.slice(i, j - i)
                words = words_of(part.column(1))
                row, (at, count) = _spans(part.column(3))
                edge = np.zeros(len(words.hashes) + 1, dtype=np.int64)
                np.add.at(edge, words.bounds[row] + at, 1)
                np.add.at(edge, words.bounds[row] + at + count - 1 + p.window, -1)
                gone = np.cumsum(edge)[:-1] > 0
                raw = np.frombuffer(words.joined, np.uint8)[1:]
                mask = np.repeat(~gone, np.diff(words.begin))
                left = raw[mask].tobytes()
                upto = np.concatenate([[0], np.cumsum(np.diff(words.begin) * ~gone)])[words.bounds]
                texts = [left[a : b - 1].decode() if a < b else "" for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
                removed = np.concatenate([[0], np.cumsum(gone)])[words.bounds]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(words.bounds)), pa.array(np.diff(removed)), pa.array(texts, pa.string())], names=["doc_id", "whole", "n_words", "n_removed", "text"])

    return run


@dataclass
class PassageResult:
    """``cleaned``: ``doc_id, whole, n_words, n_removed, text`` of the first document of each word sequence, where it loses
    words: its remaining words joined by one space.  ``whole``: ``doc_id, n_words, whole, copied`` of every row: the SHA-256
    of its words, and whether a smaller doc_id has the same words, so that nothing is left of it."""

    cleaned: DataFrame
    whole: DataFrame


def remove_repeated_passages(docs: DataFrame, params: PassageParams = PassageParams()) -> PassageResult:
    """Remove each word that a window of ``window`` words covers which also starts in a document of smaller doc_id.

    Words are unchanged; windows are judged on the input.  Null and empty texts have no words; a null doc_id owns
    nothing and loses nothing; rows that repeat a doc_id never take words from each other and each get a row; texts of any
    length are taken whole; an empty table gives no rows; extra columns are ignored.

    Steps: anchors (one pass) -> of equal word sequences only the first document goes on -> anchors of two documents or
    more -> the documents that hold them, each shard's phrases compiled to an automaton that its documents run through
    -> runs of windows around a located anchor, by the digest of their text; all but the first document with a run lose
    it -> where a phrase has different runs, their windows, by digest, from the first document of each run -> covered
    words.  Phrase hashes only choose what is compared; what is removed is decided by 128-bit digests of the words.

    A passage that a third of all documents share is one row an anchor and document, summed map-side and joined with
    splitting; only documents with different surroundings are looked at window by window.
    """
    p = params
    made: list[DataFrame] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        made.append(settle(df, tag))
        return made[-1]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("text"))
    found = keep(map_arrow(rows, _find_anchors(p), "doc_id long, tag long, n_words long, whole binary, phrases array<long>"), "pas-anchors")
    long = F.col("n_words") >= p.window
    owners = keep(found.where(long & F.col("doc_id").isNotNull()).groupBy("whole").agg(F.min("doc_id").alias("owner")), "pas-owners")
    whole = found.select("doc_id", "n_words", "whole").join(owners, "whole", "left")
    whole = settle(whole.select("doc_id", "n_words", "whole", F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False)).alias("copied")), "pas-whole")
    first = found.where(long).join(owners, "whole").where("doc_id = owner").select("doc_id", "whole", "tag", "phrases").dropDuplicates(["doc_id", "whole"])
    uses = keep(first.select("doc_id", "whole", "tag", F.explode(F.array_distinct("phrases")).alias("phrase")), "pas-uses")
    # The sides that hot phrases, runs and windows are joined with are tables, so that AQE can split a hot partition.
    repeated = keep(uses.groupBy("phrase").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("phrase"), "pas-repeated")
    # From here on a document is its id and the tag of its text.
    per_doc = uses.join(repeated, "phrase").groupBy("doc_id", "whole", "tag").agg(F.collect_list("phrase").alias("phrases"))
    shards = rows.join(per_doc, ["doc_id", "tag"]).select("doc_id", "text", "tag", "phrases", "whole").dropDuplicates(["doc_id", "tag"])
    shards = keep(shards, "pas-shards")

    runs = keep(map_arrow(shards.drop("whole"), _locate(p), "phrase long, segment binary, doc_id long, tag long, at int, n int"), "pas-runs")
    firsts = keep(runs.groupBy("phrase", "segment").agg(F.min("doc_id").alias("owner")), "pas-firsts")
    differ = keep(firsts.groupBy("phrase").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.count("*").alias("c")).where("c > 1 AND lo < hi").select("phrase"), "pas-differ")
    judged = runs.join(firsts, ["phrase", "segment"])
    later = judged.where("doc_id > owner").select("doc_id", "tag", F.struct("at", "n").alias("span"))
    checked = judged.where("doc_id = owner").join(differ, "phrase").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    checked = shards.select("doc_id", "text", "tag").join(checked, ["doc_id", "tag"]).select("doc_id", "text", "tag", "spans")
    windows = keep(map_arrow(checked, _windows(p), "window binary, doc_id long, tag long, at int"), "pas-windows")
    firsts = windows.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi")).where("owner < hi").select("window", "owner")
    firsts = keep(firsts, "pas-window-firsts")
    single = windows.join(firsts, "window").where("doc_id > owner").select("doc_id", "tag", F.struct("at", F.lit(1).alias("n")).alias("span"))
    gone = later.unionAll(single).groupBy("doc_id", "tag").agg(F.collect_list("span").alias("spans"))
    cleaned = shards.drop("phrases").join(gone, ["doc_id", "tag"]).select("doc_id", "text", "whole", "spans")
    cleaned = settle(map_arrow(cleaned, _remove(p), "doc_id long, whole binary, n_words long, n_removed long, text string"), "pas-cleaned")
    discard(*made)
    return PassageResult(cleaned, whole)


def passage_digests(result: PassageResult) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``, one row per input row."""
    less = result.cleaned.select("doc_id", "whole", "n_removed", F.sha2("text", 256).alias("kept"))
    out = result.whole.join(less, ["doc_id", "whole"], "left")
    nothing = F.sha2(F.lit(""), 256)
    removed = F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    kept = F.when(F.col("copied"), nothing).otherwise(F.coalesce("kept", F.lower(F.hex("whole"))))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)
), own AS (
  SELECT t, min(doc_id) AS owner FROM win GROUP BY t
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN own USING (t) WHERE owner < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept, count(*) AS n FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p
  WHERE gone.p IS NULL GROUP BY words.doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
