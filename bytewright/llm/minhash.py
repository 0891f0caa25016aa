"""MinHash near-dedup with tensored banding and exact confirmation."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .common import discard, settle
from .components import class_components, class_nodes, connected_components
from .textkit import U, mix, shingles, slices, text_buffers, word_hashes, word_spans

#: Text worked on at a time.
_SLICE = 2 << 20


@dataclass(frozen=True)
class NearDupParams:
    """``collections`` small hash collections of ``width`` minhashes; a table key joins two collections.

    16 collections of 3 give 120 tables of six minhashes from 48 minhashes instead of 720.  A pair at Jaccard s
    is missed only if fewer than two collections agree: 6.4e-6 at s = 0.85.
    """

    shingle_words: int = 5
    collections: int = 16
    width: int = 3
    percent: int = 85


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _signatures(p: NearDupParams):
    gen = np.random.default_rng(20240229)
    odd = gen.integers(0, 1 << 63, p.collections * p.width, dtype=np.uint64) * U(2) + U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, tags = batch.column(0), batch.column(1), batch.column(2)
            for i, j in slices(texts, _SLICE):
                data, offsets = text_buffers(texts.slice(i, j - i))
                starts, ends, bounds = word_spans(data, offsets)
                grams, at = shingles(word_hashes(data, starts, ends, lower=True), bounds, p.shingle_words)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                tuples = np.zeros((j - i, p.collections), dtype=U)
                if len(full):
                    with np.errstate(over="ignore"):
                        for c in range(p.collections):
                            acc = np.full(len(full), c + 1, dtype=U)
                            for w in range(p.width):
                                low = np.minimum.reduceat(grams * odd[c * p.width + w], at[full])
                                acc = mix(acc * U(0x9FB21C651E98DF25) + low)
                            tuples[full, c] = acc
                digests = [_digest(grams[at[q] : at[q + 1]]) if sizes[q] else None for q in range(j - i)]
                flat = pa.array(tuples.view(np.int64).ravel())
                step = pa.array(np.arange(0, (j - i + 1) * p.collections, p.collections, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), tags.slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(step, flat)],
                    names=["doc_id", "tag", "n_shingles", "digest", "tuples"],
                )

    return run


def _sets(p: NearDupParams):
    """The shingles of the rows whose digest is the wanted one, under the name of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, want, names = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            for i, j in slices(texts, _SLICE):
                data, offsets = text_buffers(texts.slice(i, j - i))
                starts, ends, bounds = word_spans(data, offsets)
                grams, at = shingles(word_hashes(data, starts, ends, lower=True), bounds, p.shingle_words)
                keep = [q for q in range(j - i) if _digest(grams[at[q] : at[q + 1]]) == want[i + q]]
                rows = [grams[at[q] : at[q + 1]].tobytes() for q in keep]
                yield pa.RecordBatch.from_arrays(
                    [names.slice(i, j - i).take(pa.array(keep, pa.int64())), pa.array([len(r) // 8 for r in rows], pa.int64()), pa.array(rows, pa.binary())],
                    names=["rep", "n", "grams"],
                )

    return run


def _explode_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        values, counts = np.frombuffer(data, dtype=np.int64), np.diff(offsets) // 8
        owners = np.repeat(batch.column(0).to_numpy(), counts)
        for s in range(0, len(values), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(values[s : s + (1 << 17)]), pa.array(owners[s : s + (1 << 17)])], names=["gram", "rep"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (left, right) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(left.as_buffer(), dtype=U), np.frombuffer(right.as_buffer(), dtype=U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int(np.count_nonzero(y[at] == x))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            chosen = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity.  The unique side joins first, so that the hub of a star
    meets rows that already carry their bytes and AQE can split its partition."""
    left = sets.select(F.col("rep").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("rep").alias("b"), F.col("grams").alias("gb"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "ga", "gb")
    return map_arrow(rows, _confirm(percent), "a long, b long")


def _prefix_pairs(rest: DataFrame, sets: DataFrame, percent: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Pairs of ``rest(rep, n, comp)`` in different components that can still reach the similarity.

    Shingles are ordered by how many of these documents hold them, rarest first.  After the first shingle that a set of
    n and one of m >= n share, at places i and j, at most min(n - i, m - j) can be common; so the smaller set is found by its
    first n - 2sn/(1 + s) shingles and the larger one by its first m - sm, and sizes meet only in bands s apart.  Documents
    on one template that differ too much have rare shingles in front, no place in the short prefix, and meet nobody.
    """
    grams = map_arrow(sets.join(rest.select("rep"), "rep").select("rep", "grams"), _explode_grams, "gram long, rep long")
    common = keep(grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"), "dup-common")
    own = W.partitionBy("rep")
    placed = grams.join(common, "gram").join(rest, "rep")
    placed = placed.withColumn("at", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "gram")) - 1)
    placed = placed.where(f"100 * (n - at) >= {percent} * n").withColumn("band", F.floor(F.log("n") / (math.log(100 / percent) * 1.000001)).cast("int"))
    front = keep(placed.select("gram", "band", "rep", "n", "comp", "at"), "dup-front")
    small = front.where(f"{100 + percent} * (n - at) >= {2 * percent} * n")
    x = small.select("gram", "band", F.col("rep").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac"), F.col("at").alias("aa"))
    y = front.select("gram", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bc"), F.col("at").alias("ba"))
    on = (x["gram"] == y["gram"]) & (x["band"] == y["band"])
    on &= F.expr(f"(an < bn OR an = bn AND a < b) AND ac <> bc AND {100 + percent} * least(an - aa, bn - ba) >= {percent} * (an + bn)")
    return x.join(y, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """Group the documents of ``docs(doc_id, text, ...)`` whose word shingles are similar.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept, tag, digest``.  Two documents are linked when
    100 * |A intersect B| >= percent * |A union B|; ``component_id`` is the smallest doc_id reachable.  ``tag`` is
    ``xxhash64(text)`` and ``digest`` that of the shingle set: they tell rows of one doc_id apart.

    Null and empty texts have no shingles and link with nothing.  Equal sets are collapsed first (a group of copies
    costs one representative, whatever its size).  Repeated rows each get a row; an id that is repeated with different
    texts stands for several documents, each with its own links; extra columns are ignored; a null doc_id is never a
    representative unless its whole group has none; texts of any length are taken whole; an empty table gives no rows.

    Steps: signatures (one pass, text never shuffled) -> tuples that occur twice -> representatives with two shared
    tuples -> their full sets -> an exact upper bound from shingles nobody else has -> per table key a star around
    the member with the fewest such shingles -> confirm -> components -> an exact prefix join of what a key still has
    in different components -> components.
    """
    p = params
    made: list[DataFrame] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        made.append(settle(df, tag))
        return made[-1]

    pruned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = map_arrow(pruned.withColumn("tag", F.xxhash64("text")), _signatures(p), "doc_id long, tag long, n_shingles long, digest binary, tuples array<long>")
    meta = settle(signed, "dup-meta")
    # Copies shrink to one row a task before the shuffle.
    usable = meta.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    owners = keep(usable.groupBy("digest").agg(F.min(F.struct("doc_id", "tuples")).alias("m")).select("digest", F.col("m.doc_id").alias("rep"), "m.tuples"), "dup-owners")
    named, repeated = class_nodes(owners, ["digest"], keep)
    reps = named.select(F.col("rep").alias("doc_id"), F.col("node").alias("rep"), "digest", "tuples")
    named = named.drop("tuples")

    single = reps.select("rep", F.explode("tuples").alias("k"))
    # Sides that a hot key is joined with are tables: only then does AQE see two exchanges and split the partition.
    shared = keep(single.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k"), "dup-shared")
    chosen = single.join(shared, "k").groupBy("rep").agg(F.sort_array(F.collect_list("k")).alias("ks")).where(F.size("ks") > 1)
    chosen = keep(chosen, "dup-chosen")

    wanted = reps.join(chosen.select("rep"), "rep").select(F.col("doc_id").alias("wanted"), "rep", "digest")
    carried = pruned.join(wanted, F.col("doc_id") == F.col("wanted")).select("text", "digest", "rep")
    sets = keep(map_arrow(carried, _sets(p), "rep long, n long, grams binary").dropDuplicates(["rep"]), "dup-sets")
    alone = map_arrow(sets.select("rep", "grams"), _explode_grams, "gram long, rep long")
    alone = alone.groupBy("gram").agg(F.min("rep").alias("rep"), F.max("rep").alias("hi")).where("rep = hi").groupBy("rep").agg(F.count("*").alias("own"))
    # A partner holds at most the v = n - own shingles that others have too.
    sized = sets.select("rep", "n").join(alone, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("v"))
    sized = sized.where(f"{100 + p.percent} * v >= {p.percent} * (n + v)")
    ks = chosen.join(sized, "rep")
    keys = ks.select("rep", "n", "v", F.expr("explode(flatten(transform(ks, (x, i) -> transform(slice(ks, i + 2, size(ks)), y -> xxhash64(x, y)))))").alias("key"))
    keys = keep(keys, "dup-keys")

    # Per key the member with the fewest own shingles is the hub; ties go to the smallest id.
    hubs = keys.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("v")).alias("own"), F.col("rep").alias("hub"), F.col("n").alias("hn"), F.col("v").alias("hv"))).alias("h"), F.count("*").alias("c")).where("c > 1").select("key", "h.hub", "h.hn", "h.hv")
    hubs = keep(hubs, "dup-hubs")
    bound = "{m} * least(v, {v}) >= {q} * (n + {n})"
    star = keys.join(hubs, "key").where("hub <> rep").where(bound.format(m=100 + p.percent, q=p.percent, v="hv", n="hn"))
    pairs = keep(star.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "dup-star")
    links = keep(_verified(pairs, sets, p.percent), "dup-links")
    first = connected_components(links)

    # Keys that still hold different components: their members are joined exactly, by prefix and position.
    placed = keys.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    split = keep(split, "dup-split")
    rest = keep(placed.join(split, "key").select("rep", "n", "comp").distinct(), "dup-rest")
    more = _prefix_pairs(rest, sets, p.percent, keep).join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    extra = keep(_verified(more, sets, p.percent), "dup-more")
    labels = first
    if extra.limit(1).count():
        labels = connected_components(links.unionAll(extra))
        made.append(first)
    found = settle(class_components(named, labels, repeated).select("digest", "component"), "dup-found")
    discard(labels, *made)

    out = meta.select("doc_id", "tag", "n_shingles", "digest").join(found.withColumnRenamed("digest", "d2"), F.col("digest") == F.col("d2"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "tag", "digest")


def first_of_each(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` less near-duplicates: of each group the row of the smallest doc_id stays.

    Rows without a doc_id stay, once per text.  Rows that repeat an id with another text are judged by their own text.
    """
    found = near_duplicates(docs, params)
    named = found.where("doc_id IS NOT NULL")
    left_over = named.where("NOT kept").select("doc_id", "tag")
    # One id with two spellings of one shingle set: the text of the smaller tag stays.
    ties = named.where("kept AND digest IS NOT NULL").groupBy("doc_id", "digest").agg(F.min("tag").alias("least"), F.max("tag").alias("most")).where("least < most")
    spelled = named.where("kept").join(ties, ["doc_id", "digest"]).where("tag > least").select("doc_id", "tag")
    gone = settle(left_over.unionAll(spelled).distinct().select("doc_id", F.col("tag").alias("__text_tag")), "dup-gone")
    rows = docs.withColumn("__text_tag", F.xxhash64(F.col("text").cast("string")))
    return rows.join(gone, ["doc_id", "__text_tag"], "left_anti").dropDuplicates(["doc_id", "__text_tag"]).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), u AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS shared FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (an + bn - shared)
), reach AS (
  SELECT doc_id AS node, doc_id AS c FROM s UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.node
), comp AS (
  SELECT node, min(c) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp ON node = doc_id
"""
