"""Embedding near-dedup by collision counting on one-dimensional projections."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .common import discard, settle
from .components import class_components, class_nodes, connected_components


@dataclass(frozen=True)
class CollisionParams:
    """``cosine``: the link threshold.  ``miss``: the chance, per stage, that a pair at the threshold is lost.

    ``projections`` lines are sorted inside a block and a pair collides on a line when the query's window of
    ``window`` threshold distances holds the other; the count a pair must reach follows from ``miss``.
    Blocks come from keys of several quantised lines (cells ``cell`` wide); lines per key grow with the logarithm
    of the largest label, so that unrelated rows rarely meet, and the number of keys follows from ``miss``.
    ``block_rows`` bounds a task's block: larger buckets are split into pairs of sub-blocks.
    """

    cosine: float = 0.98
    projections: int = 24
    window: float = 1.5
    cell: float = 1.0
    miss: float = 1e-6
    block_rows: int = 8192
    seed: int = 77

    @property
    def distance(self) -> float:
        return math.sqrt(2.0 - 2.0 * self.cosine)

    @property
    def required(self) -> int:
        """The largest count that a pair at the threshold reaches with probability 1 - miss."""
        p, n = math.erf(self.window / math.sqrt(2.0)), self.projections
        tail = 0.0
        for k in range(n + 1):
            tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if tail > self.miss:
                return k
        return n

    def layout(self, rows: int) -> tuple[int, int]:
        """Lines per key and number of keys for a label of ``rows`` rows."""
        near = 1.0 - self.distance * math.sqrt(2 / math.pi) / self.cell
        far = 0.27 * self.cell
        lines = min(24, max(4, math.ceil(math.log(16.0 * max(rows, 1)) / -math.log(far))))
        return lines, math.ceil(math.log(self.miss) / math.log1p(-(near**lines)))


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components as doubles, n + 1 bounds, and which rows are vectors: not null, empty or zero, and finite throughout."""
    wide = column.cast(pa.large_list(pa.float64()))
    offsets = wide.offsets.to_numpy()
    inner = wide.values.slice(offsets[0], offsets[-1] - offsets[0])
    flat = inner.to_numpy(zero_copy_only=False)
    bounds = offsets - offsets[0]
    good = np.isfinite(flat)
    if inner.null_count:
        good &= np.asarray(inner.is_valid())
    sizes = np.diff(bounds)
    bad = np.concatenate([[0], np.cumsum(~good)])
    some = np.concatenate([[0], np.cumsum(flat != 0)])
    valid = np.asarray(column.is_valid())
    return flat, bounds, valid & (sizes > 0) & (bad[bounds[1:]] == bad[bounds[:-1]]) & (some[bounds[1:]] > some[bounds[:-1]])


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest entry first keeps extreme values from overflowing."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, bounds, usable = _usable(batch.column(1))
        usable &= np.asarray(batch.column(2).is_valid())
        raw = (flat + 0.0).tobytes()
        out = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if ok else None for a, b, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), usable.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "embedding", "digest"])


def _lines(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, count]).standard_normal((dim, count))


def _keys(p: CollisionParams, lines: int, tables: int):
    """Per vector one 32-bit cell key a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds, _ = _usable(batch.column(2))
            sizes = np.diff(bounds)
            for dim in np.unique(sizes).tolist():
                every = np.flatnonzero(sizes == dim)
                for s in range(0, len(every), 2048):
                    at = every[s : s + 2048]
                    unit = _unit(flat[bounds[at][:, None] + np.arange(dim)])
                    shift = np.random.default_rng([p.seed, dim]).random(lines * tables) * p.cell
                    cells = np.floor((unit @ _lines(dim, lines * tables, p.seed) + shift) / p.cell).astype(np.int64).view(np.uint64)
                    keys = np.empty((len(at), tables), dtype=np.int32)
                    with np.errstate(over="ignore"):
                        for t in range(tables):
                            h = np.full(len(at), t * 0x9E3779B9 + dim, dtype=np.uint64)
                            for c in range(lines):
                                h = (h ^ cells[:, t * lines + c]) * np.uint64(0x9FB21C651E98DF25)
                                h ^= h >> np.uint64(29)
                            keys[:, t] = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    pick = pa.array(at, pa.int64())
                    steps = pa.array(np.arange(0, (len(at) + 1) * tables, tables, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(pick) for c in (0, 1, 3, 2)), pa.ListArray.from_arrays(steps, pa.array(keys.ravel()))],
                        names=["rep", "label", "copies", "embedding", "keys"],
                    )

    return run


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        nxt = root.copy()
        np.minimum.at(nxt, a, low)
        np.minimum.at(nxt, b, low)
        nxt = nxt[nxt]
        if np.array_equal(nxt, root):
            return root
        root = nxt


def _windows(p: CollisionParams, unit: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line and row its rank among all rows, sorted by block and projection, and the ranks its window spans."""
    values = unit @ _lines(unit.shape[1], p.projections, p.seed + 1)
    reach = p.window * p.distance
    values += block[:, None] * (2.0 * np.abs(values).max(initial=1.0) + 4.0 * reach)
    shape = values.T.shape
    rank, lo, hi = (np.empty(shape, np.int32) for _ in range(3))
    for c in range(p.projections):
        order = np.argsort(values[:, c], kind="stable")
        ranked = values[order, c]
        rank[c, order] = np.arange(len(order))
        lo[c] = np.searchsorted(ranked, values[:, c] - reach, side="left")
        hi[c] = np.searchsorted(ranked, values[:, c] + reach, side="right")
    return rank, lo, hi


#: Tables whose keys are compared before the lines are counted: near pairs nearly always share one of them.
_EARLY = 8


def _pair_blocks(p: CollisionParams, rows: pa.Table, block: np.ndarray) -> pa.RecordBatch:
    """Link counts and roots of whole blocks; ``block`` numbers them in row order.

    All blocks go through NumPy together.  The partners of a row are a range: in a block of one part the rows after
    it, in a block of two the other part.
    """
    n = rows.num_rows
    t, part, left, right, rep, copies = (rows.column(c).to_numpy() for c in ("t", "part", "pa", "pb", "rep", "copies"))
    flat, bounds, _ = _usable(rows.column("embedding").combine_chunks())
    dim = int(bounds[1])
    unit = _unit(flat.reshape(n, dim))
    before = rows.column("keys").combine_chunks()
    keys, key_at = before.values.to_numpy(), before.offsets.to_numpy()
    stop = np.searchsorted(block, block, side="right")
    # Rows of a block come sorted by part, the left part first.
    second = np.searchsorted(block * 2 + (part != left), block * 2 + 1, side="left")
    here = np.arange(n)
    begin = np.where(left == right, here + 1, np.where(part == left, second, stop))
    counts = np.maximum(stop - begin, 0)
    rank, lo, hi = _windows(p, unit, block)
    links, roots = np.zeros(n, np.int64), np.arange(n)
    upto = np.cumsum(counts)

    def unseen(i: np.ndarray, j: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Less the pairs that share the key of an earlier table, from ``first`` up to ``last``."""
        live = np.arange(len(i))
        kept = np.ones(len(i), bool)
        for k in range(first, last):
            live = live[kept[live] & (t[i[live]] > k)]
            if not len(live):
                break
            kept[live] = keys[key_at[i[live]] + k] != keys[key_at[j[live]] + k]
        return i[kept], j[kept]

    s = 0
    while s < n:
        e = max(s + 1, int(np.searchsorted(upto, upto[s] - counts[s] + _PAIRS, side="right")))
        for lower in range(0, int(counts[s:e].max(initial=0)), _PAIRS):
            some = np.minimum(counts[s:e] - lower, _PAIRS).clip(0)
            i = np.repeat(here[s:e], some)
            j = np.arange(len(i)) + np.repeat(begin[s:e] + lower - (np.cumsum(some) - some), some)
            i, j = unseen(i, j, 0, _EARLY)
            found = np.zeros(len(i), np.uint8)
            for c in range(p.projections):
                at = rank[c, j]
                found += (at >= lo[c, i]) & (at < hi[c, i])
            i, j = i[found >= p.required], j[found >= p.required]
            i, j = unseen(i, j, _EARLY, int(t.max()))
            for k in range(0, len(i), 1 << 14):
                u, v = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                near = np.einsum("ij,ij->i", unit[u], unit[v]) >= p.cosine
                u, v = u[near], v[near]
                links += np.bincount(u, copies[v], n).astype(np.int64) + np.bincount(v, copies[u], n).astype(np.int64) if len(u) else 0
                a, b = roots[u], roots[v]
                if (a != b).any():
                    roots = _local_roots(n, a[a != b], b[a != b])[roots]
        s = e
    touched = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(rep[touched]), pa.array(links[touched]), pa.array(rep[roots[touched]])], names=["rep", "links", "other"])


#: Pairs looked at together.
_PAIRS = 1 << 18
_BLOCK = ("lh", "t", "key", "pa", "pb")


def _blocks(p: CollisionParams):
    """Rows come sorted by block; whole blocks are taken from the stream, many small ones at a time."""

    def numbered(rows: pa.Table) -> np.ndarray:
        cut = np.zeros(rows.num_rows, bool)
        for name in _BLOCK:
            values = rows.column(name).to_numpy()
            cut[1:] |= values[1:] != values[:-1]
        return np.cumsum(cut)

    def of_one_length(rows: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = pc.list_value_length(rows.column("embedding")).to_numpy()
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            if len(at) > 1:
                yield _pair_blocks(p, rows.take(pa.array(at)) if len(at) < len(sizes) else rows, block[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                held.append(batch.slice(s, 4096))
                rows = pa.Table.from_batches(held)
                block = numbered(rows)
                whole = int(np.searchsorted(block, block[-1]))
                if whole:
                    yield from of_one_length(rows.slice(0, whole).combine_chunks(), block[:whole])
                    held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from of_one_length(rows, numbered(rows))

    return run


def embedding_duplicates(vectors: DataFrame, params: CollisionParams = CollisionParams()) -> DataFrame:
    """Link the vectors of ``vectors(vec_id, embedding, label, ...)`` with equal labels and cosine >= the threshold.

    Returns one row per input row: ``vec_id, n_links, component_id, kept``.  A null label, or a vector that is null,
    empty, zero or has a null or non-finite component, links with nothing; vectors of different lengths do not
    compare, and lengths have no bound.  Equal vectors of a label are collapsed first and count as links of each other.
    Repeated rows each get a row and count as links of each other too; a pair exactly at the threshold (a tie) links; a
    null vec_id links with nothing; a vec_id that is repeated with other vectors stands for several; an empty table gives no rows; extra columns are ignored.  No pair is emitted: blocks
    return link counts and one edge per linked row to its block's root.

    A row travels once for each key that others share and once for each part of a bucket above ``block_rows``, with the
    keys of earlier tables: a pair is counted under the first key it shares, and dropped under others before its lines
    are counted.
    """
    p = params
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    kind = rows.schema["embedding"].dataType.simpleString()
    made: list[DataFrame] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        made.append(settle(df, tag))
        return made[-1]

    rows = settle(map_arrow(rows, _digests, f"vec_id long, label string, embedding {kind}, digest binary"), "emb-rows")
    usable = rows.where("digest IS NOT NULL AND vec_id IS NOT NULL")
    classes = keep(usable.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "emb-classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    lines, tables = p.layout(most)
    named, repeated = class_nodes(classes, ["label", "digest"], keep)
    reps = usable.select("vec_id", "label", "digest", "embedding").join(named.withColumnRenamed("rep", "vec_id"), ["label", "digest", "vec_id"])
    reps = reps.dropDuplicates(["label", "digest"]).select(F.col("node").alias("rep"), "label", "embedding", "copies")
    keyed = map_arrow(reps, _keys(p, lines, tables), f"rep long, label string, copies long, embedding {kind}, keys array<int>")
    keyed = keep(keyed.withColumn("lh", F.xxhash64("label")).drop("label"), "emb-keyed")
    single = keyed.select("rep", "lh", F.posexplode("keys").alias("t", "key"))
    buckets = single.groupBy("lh", "t", "key").agg(F.count("*").alias("c")).where("c > 1").select("lh", "t", "key", F.ceil(F.col("c") / p.block_rows).cast("int").alias("parts"))
    buckets = keep(buckets, "emb-buckets")
    members = single.join(buckets, ["lh", "t", "key"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # Each row meets every part of its bucket once: a block is a pair of parts.
    blocks = members.select("lh", "t", "key", "rep", "part", F.expr("explode(sequence(0, parts - 1))").alias("q"))
    blocks = blocks.select("lh", "t", "key", "rep", F.least("part", "q").alias("pa"), F.greatest("part", "q").alias("pb"), "part")
    full = blocks.join(keyed.drop("lh"), "rep").select(*_BLOCK, "part", "rep", "copies", "embedding", F.slice("keys", F.lit(1), F.col("t")).alias("keys"))
    full = full.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, F.col("part") != F.col("pa"))
    found = keep(map_arrow(full, _blocks(p), "rep long, links long, other long"), "emb-found")
    labels = connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counted = found.groupBy(F.col("rep").alias("node")).agg(F.sum("links").alias("links"))
    named = class_components(named.join(counted, "node", "left"), labels, repeated)
    named = settle(named.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"), "emb-named")
    discard(labels, *made)
    out = rows.select("vec_id", "label", "digest").join(named, ["label", "digest"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.node
), comp AS (
  SELECT node, min(c) AS component_id FROM reach GROUP BY node
), n AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON node = vec_id LEFT JOIN n ON a = vec_id
"""
