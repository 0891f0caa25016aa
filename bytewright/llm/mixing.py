"""Mixing sources to target weights: exponential keys, epochs, selection by narrowing bins.  DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_broadcast, discard, settle

WORD = r"[^\x20\x09-\x0D]+"
JUNK = r"[#$%&*!|~^<>{}=\\]"
_BINS = 256


@dataclass(frozen=True)
class MixParams:
    """``weights`` go to the sources in code point order (null last), repeating; the mix has ``share`` times all
    words and no source more than ``most_epochs`` times its own.  ``broadcast_sources`` bounds the per-source
    table that is broadcast; beyond it the table is joined by a shuffle.  At most about ``edge_rows`` rows of a source are
    sorted in one task."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most_epochs: int = 2
    broadcast_sources: int = 2000
    edge_rows: int = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_quality(text: Column) -> Column:
    """1, 0.5 or 0.25 by the share of symbol characters."""
    text = F.coalesce(text, F.lit(""))
    share = F.regexp_count(text, F.lit(JUNK)) / F.greatest(F.length(text), F.lit(1))
    return F.when(share < 0.01, 1.0).when(share < 0.05, 0.5).otherwise(0.25)


def with_keys(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """Add ``_src, _size, _rank, _tie``: the source (never null), the words, the sampling rank, a tie-break.

    The rank is the exponential key -ln(u) / quality, with u from a digest of the doc_id (of the text where that is
    null): taking documents by ascending rank is weighted sampling without replacement, and reruns agree.
    """
    tie = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), tie).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return docs.withColumns(
        {
            "_src": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")),
            "_size": word_count(F.col("text")),
            "_rank": -F.log(u) / (text_quality(F.col("text")) if quality is None else quality),
            "_tie": tie,
        }
    )


def _with_weights(sizes: DataFrame, p: MixParams, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Deal the weights to the sources in order.  Sources are ranked by range partition: a task ranks its own range, and
    only the number of sources in each range is summed in one place."""
    order = [F.when(F.col("_src") == "", 1).otherwise(0), F.col("_src")]
    ranged = keep(sizes.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranged")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy("range").orderBy(*order)) - 1 + F.col("start")
    weights = F.array(*[F.lit(float(w)) for w in p.weights])
    weight = F.element_at(weights, (F.pmod(place, F.lit(len(p.weights))) + 1).cast("int"))
    # There are as many starts as range partitions.
    return ranged.join(F.broadcast(starts), "range").withColumn("weight", weight).withColumn("cap", (F.col("source_size") * p.most_epochs).cast("double")).drop("range", "start")


def source_targets(sizes: DataFrame, p: MixParams, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """From ``_src, source_size, ...``: add ``target, epochs, rest`` by water-filling.

    The level rises from the even share; sources below it are closed at their cap until none is.  Each round is one sum
    over the sources, of which two numbers come to the driver.
    """
    ranked = keep(_with_weights(sizes, p, keep), "mix-weights")
    ratio = F.col("cap") / F.col("weight")
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, closed = (float(total) * p.share / weight if weight else 0.0), 0
    while weight:
        under = ratio < F.lit(level)
        count, full, weight = ranked.agg(F.count(F.when(under, 1)), F.sum(F.when(under, F.col("cap"))), F.sum(F.when(~under, F.col("weight")))).first()
        if count == closed:
            break
        closed, level = count, ((float(total) * p.share - full) / weight if weight else math.inf)
    target = F.when(ratio >= F.lit(level), F.least(F.lit(level) * F.col("weight"), F.col("cap"))).otherwise(F.col("cap"))
    out = ranked.withColumn("target", target).drop("weight", "cap")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    out = out.withColumn("epochs", epochs)
    return out.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))


def mixing_plan(keyed: DataFrame, params: MixParams = MixParams()) -> tuple[DataFrame, int]:
    """Per source ``_src, source_size, target, epochs, last, part``, and the number of sources.

    A document is taken ``epochs`` times, and once more if its (rank, doc_id, tie) is below ``last``; of ``last``
    itself ``part`` words more are taken, which is what the epochs and the run before it leave of the target.

    The end of the run is found by rounds: the ranks of a source fall into 256 bins of even width, the bin where the running
    words pass the rest is found from the sums, and its rows go to the next round, until no bin holds more than
    ``edge_rows``.  Only those are sorted, so a source with a third of all rows is never sorted or summed in one task,
    whatever the qualities.
    """
    p = params
    made: list[DataFrame] = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        made.append(settle(df, tag))
        return made[-1]

    sizes = keep(keyed.groupBy("_src").agg(F.sum("_size").alias("source_size"), F.min("_rank").alias("lo"), F.max("_rank").alias("hi")), "mix-sizes")
    count = sizes.count()
    targets = keep(source_targets(sizes, p, keep), "mix-targets")
    cuts = targets.select("_src", "rest", "lo", (F.col("hi") - F.col("lo")).alias("width"))
    rows, most, stuck = keyed.select("_src", "_size", "_rank", "doc_id", "_tie"), None, 0
    while most is None or most > p.edge_rows and stuck < 3:
        # The place in its bin range is monotone in the rank, so a row past a border by rounding falls into the last bin.
        place = F.floor((F.col("_rank") - F.col("lo")) * (F.lit(float(_BINS)) / F.col("width")))
        bin_ = F.when(F.col("width") > 0, F.least(F.greatest(place, F.lit(0)), F.lit(_BINS - 1))).otherwise(F.lit(0))
        placed = rows.join(bounded_broadcast(cuts, count, p.broadcast_sources), "_src").withColumn("bin", bin_)
        sums = placed.groupBy("_src", "bin").agg(F.sum("_size").alias("words"), F.count("*").alias("n"))
        run = sums.withColumn("upto", F.sum("words").over(W.partitionBy("_src").orderBy("bin"))).join(cuts, "_src").where("upto > rest")
        first = run.groupBy("_src").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "n", "rest", "lo", "width")).alias("b"))
        step = F.col("b.width") / _BINS
        cuts = keep(first.select("_src", F.col("b.bin").alias("at"), (F.col("b.rest") - F.col("b.before")).alias("rest"), F.col("b.n").alias("n"), F.col("b.lo").alias("old_lo"), F.col("b.width").alias("old_width"), (F.col("b.lo") + F.col("b.bin") * step).alias("lo"), step.alias("width")), "mix-cuts")
        largest = cuts.agg(F.max("n")).first()[0] or 0
        stuck = stuck + 1 if largest == most else 0
        most = largest
        chosen = bounded_broadcast(cuts.select("_src", "at", F.col("old_lo").alias("lo"), F.col("old_width").alias("width")), count, p.broadcast_sources)
        rows = keep(rows.join(chosen, "_src").withColumn("bin", bin_).where("bin = at").select("_src", "_size", "_rank", "doc_id", "_tie"), "mix-rows")
        cuts = cuts.select("_src", "rest", "lo", "width")
    edge = rows.join(bounded_broadcast(cuts.select("_src", F.col("rest").alias("left")), count, p.broadcast_sources), "_src")
    edge = edge.groupBy("_src", "left", "_rank", "doc_id", "_tie").agg(F.sum("_size").alias("words"), F.count("*").alias("equal"))
    exact = W.partitionBy("_src").orderBy("_rank", "doc_id", "_tie").rowsBetween(W.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.coalesce(F.sum("words").over(exact), F.lit(0))).where("before + words > left AND before <= left")
    last = edge.select("_src", F.struct("_rank", "doc_id", "_tie").alias("last"), F.floor((F.col("left") - F.col("before")) / F.col("equal")).cast("long").alias("part"))
    out = settle(targets.select("_src", "source_size", "target", "epochs").join(last, "_src", "left"), "mix-plan")
    discard(*made)
    return out, count


def apply_plan(keyed: DataFrame, plan: DataFrame, count: int, params: MixParams = MixParams()) -> DataFrame:
    """Add ``source_size, target, times, extra`` to the keyed rows; nothing but the small plan moves."""
    joined = keyed.join(bounded_broadcast(plan, count, params.broadcast_sources), "_src")
    own = F.struct("_rank", "doc_id", "_tie")
    joined = joined.withColumn("times", F.col("epochs") + F.when(own < F.col("last"), 1).otherwise(0))
    return joined.withColumn("extra", F.when(own.eqNullSafe(F.col("last")), F.col("part")).otherwise(F.lit(0)))


def mix_sources(docs: DataFrame, params: MixParams = MixParams(), quality: Column | None = None) -> DataFrame:
    """Sample ``docs(doc_id, text, source, ...)`` so that each source's words come near its target.

    Returns ``doc_id, size, source_size, target, taken``, one row per input row.  Complete epochs come first; the
    rest is an Efraimidis-Spirakis sample without replacement by document quality, whose last document is taken in
    part.  Null and empty texts have size 0; a null source is a source of its own, the last in order; equal rows
    share their fate; equal ranks (ties) go by doc_id, then by the text's digest; a text of any length counts whole; an
    empty table gives none.  No document is taken more than twice by default.
    """
    keyed = with_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source"), quality)
    keyed = settle(keyed.select("doc_id", "_src", "_size", "_rank", "_tie"), "mix-keyed")
    plan, count = mixing_plan(keyed, params)
    out = apply_plan(keyed, plan, count, params)
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("times") + F.col("extra")).alias("taken"))


def repeat_documents(docs: DataFrame, params: MixParams = MixParams(), quality: Column | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns; texts are not shuffled.

    Documents stay whole: the one that a source would take in part is taken once more if that part is at least half of
    it.
    """
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "source")
    keyed = with_keys(row, quality)
    small = settle(keyed.select("doc_id", "_src", "_size", "_rank", "_tie"), "mix-keyed")
    plan, count = mixing_plan(small, params)
    discard(small)
    out = apply_plan(keyed, plan, count, params)
    times = F.col("times") + F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("_size")), 1).otherwise(0)
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), k AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS src,
    CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(t) AS tie,
    CASE WHEN j < 0.01 THEN 1.0 WHEN j < 0.05 THEN 0.5 ELSE 0.25 END::DOUBLE AS w,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(t))), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM (SELECT *, len(regexp_extract_all(t, '[#$%&*!|~^<>{}=\\\\]'))::DOUBLE / greatest(length(t), 1) AS j FROM d)
), r AS (
  SELECT doc_id, src, size, tie, -ln(u) / w AS rank FROM k
), s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY src
), s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY src = '', src) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
    (2 * source_size)::DOUBLE AS cap FROM s
), s2 AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM s1 WINDOW b AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT *, cap / weight >= level AS open, max(CASE WHEN cap / weight >= level THEN level END) OVER () AS final FROM s2
), s4 AS (
  SELECT src, source_size, CASE WHEN open THEN least(final * weight, cap) ELSE cap END AS target FROM s3
), s5 AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM s4
), g AS (
  SELECT r.src, rank, doc_id, tie, sum(size) AS words, count(*) AS equal, any_value(size) AS size,
    any_value(source_size) AS source_size, any_value(target) AS target, any_value(epochs) AS epochs,
    any_value(target - epochs * source_size) AS rest
  FROM r JOIN s5 USING (src) GROUP BY ALL
), o AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY src ORDER BY rank, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g
), p AS (
  SELECT *, CASE WHEN before + words <= rest THEN size WHEN before <= rest THEN CAST(floor((rest - before) / equal) AS BIGINT) ELSE 0 END AS extra FROM o
)
SELECT r.doc_id, r.size, source_size, target, CAST(r.size * epochs + extra AS BIGINT) AS taken
FROM r JOIN p ON r.src = p.src AND r.rank = p.rank AND r.doc_id IS NOT DISTINCT FROM p.doc_id AND r.tie = p.tie
"""
