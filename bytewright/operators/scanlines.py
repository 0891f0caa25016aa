"""Scanlines as rows of byte arrays: filters, inverse filters, heuristics and the choice among them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..codecs import png
from ..runtime import map_arrow

FILTERS = ("none", "sub", "up", "average", "paeth")


def _shifted(line: Column, step: int) -> Column:
    """The line moved right by ``step`` bytes, zeros first."""
    return F.concat(F.array(*[F.lit(0)] * step), F.slice(line, F.lit(1), F.greatest(F.size(line) - step, F.lit(0))))


def filtered(kind: int, line: Column, above: Column, step: int) -> Column:
    """The line (array of ints 0 to 255) under filter 0 to 4, with higher-order functions only."""
    if kind == 0:
        return line
    left = _shifted(line, step)
    if kind == 1:
        return F.zip_with(line, left, lambda x, a: F.pmod(x - a, F.lit(256)))
    if kind == 2:
        return F.zip_with(line, above, lambda x, b: F.pmod(x - b, F.lit(256)))
    if kind == 3:
        guess = F.zip_with(left, above, lambda a, b: F.shiftright(a + b, 1))
        return F.zip_with(line, guess, lambda x, g: F.pmod(x - g, F.lit(256)))
    corner = _shifted(above, step)
    sides = F.zip_with(F.zip_with(left, above, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), corner, lambda s, c: F.struct(s["a"].alias("a"), s["b"].alias("b"), c.alias("c")))

    def predicted(s: Column) -> Column:
        a, b, c = s["a"], s["b"], s["c"]
        pa_, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
        return F.when((pa_ <= pb) & (pa_ <= pc), a).when(pb <= pc, b).otherwise(c)

    return F.zip_with(line, F.transform(sides, predicted), lambda x, g: F.pmod(x - g, F.lit(256)))


def with_above(lines: DataFrame, by: list[str], y: str, line: str) -> DataFrame:
    """Add ``above``: the line before, or zeros."""
    before = F.lag(line).over(W.partitionBy(*by).orderBy(y))
    return lines.withColumn("above", F.coalesce(before, F.transform(F.col(line), lambda _: F.lit(0))))


def minimum_sum(line: Column, kind: int) -> Column:
    """The sum of bytes taken as distances from 0; unfiltered bytes count as they are."""
    value = (lambda x: x) if kind == 0 else (lambda x: F.when(x < 128, x).otherwise(255 - x))
    return F.aggregate(F.transform(line, value), F.lit(0).cast("long"), lambda a, x: a + x)


def distinct_bytes(line: Column, kind: int) -> Column:
    """Distinct byte values, the filter type among them."""
    return F.size(F.array_distinct(F.concat(F.array(F.lit(kind)), line))).cast("long")


def distinct_bigrams(line: Column, kind: int) -> Column:
    """Distinct adjacent pairs, beginning with the filter type."""
    typed = F.concat(F.array(F.lit(kind)), line)
    pairs = F.zip_with(F.slice(typed, F.lit(1), F.size(typed) - 1), line, lambda a, b: a * 256 + b)
    return F.size(F.array_distinct(pairs)).cast("long")


def _entropies(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bits per byte of each ``filter, f``, the filter type counted as one of the line's bytes; from byte counts."""
    each = rows.select(*keys, "filter", F.explode(F.concat(F.array("filter"), "f")).alias("_v"))
    counts = each.groupBy(*keys, "filter", "_v").agg(F.count("*").alias("n"))
    sums = counts.groupBy(*keys, "filter").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("w"))
    return sums.select(*keys, "filter", (F.log2("t") - F.col("w") / F.col("t")).alias("score"))


MEASURES = {"minsum": minimum_sum, "distinct_bytes": distinct_bytes, "distinct_bigrams": distinct_bigrams, "entropy": None}


def filter_scores(lines: DataFrame, by: list[str], y: str, line: str, step: int, measure: str) -> DataFrame:
    """One row per line and filter: ``by, y, filter, score``."""
    rows = with_above(lines, by, y, line)
    score = MEASURES[measure]
    if score is None:
        every = F.array(*[F.struct(F.lit(k).alias("filter"), filtered(k, F.col(line), F.col("above"), step).alias("f")) for k in range(5)])
        return _entropies(rows.select(*by, y, F.explode(every).alias("_o")).select(*by, y, "_o.filter", "_o.f"), [*by, y])
    options = F.array(*[F.struct(F.lit(k).alias("filter"), score(filtered(k, F.col(line), F.col("above"), step), k).alias("score")) for k in range(5)])
    return rows.select(*by, y, F.explode(options).alias("_o")).select(*by, y, "_o.filter", "_o.score")


def best_filter(scores: DataFrame, by: list[str], y: str) -> DataFrame:
    """The filter of least score per line; ties go to the lowest type."""
    best = F.min(F.struct("score", "filter"))
    return scores.groupBy(*by, y).agg(best.alias("_b")).select(*by, y, F.col("_b.filter").alias("filter"), F.col("_b.score").alias("score"))


def unfiltered(lines: DataFrame, by: list[str], y: str, kind: str, line: str, step: int) -> DataFrame:
    """Undo filters, line after line of each image: ``by, y, line``.

    The average and Paeth filters are recurrences over all earlier bytes, so an image is one group.
    """
    key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in by])
    rows = lines.select(key.alias("_key"), F.col(y).cast("long").alias("y"), F.col(kind).cast("int").alias("kind"), F.col(line).cast("array<int>").alias("line"))

    def undo(table: pa.Table) -> pa.Table:
        table = table.sort_by("y")
        raw = [np.array(v, np.uint8) for v in table.column("line").to_pylist()]
        data = b"".join(bytes([k]) + v.tobytes() for k, v in zip(table.column("kind").to_pylist(), raw))
        out = png.unfilter(data, len(raw[0]), len(raw), step)
        return pa.table({"key": table.column("_key"), "y": table.column("y"), "line": pa.array([r.astype(np.int32) for r in out], pa.list_(pa.int32()))})

    from ..runtime import ship

    ship(lines.sparkSession)
    return rows.groupBy("_key").applyInArrow(undo, "key string, y long, line array<int>")


def encode_images(images: DataFrame, key: str, width: str, samples: str, strategy: str = "minsum") -> DataFrame:
    """PNG files from RGBA samples (array of 4 * width * height ints): ``key, png, color, depth, colors, intact``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, w, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                image = png.Image(cell.values.to_numpy().astype(np.uint16).reshape(-1, w, 4))
                mode = png.choose_mode(image)
                made = png.encode(image, mode, strategy)
                rows.append((name, made, mode.color, mode.depth, len(png.color_statistics(image)["colors"]), png.same_image(png.decode(made), image)))
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["key", "png", "color", "depth", "colors", "intact"])

    rows = images.select(F.col(key).cast("string"), F.col(width).cast("int"), F.col(samples).cast("array<int>"))
    return map_arrow(rows, run, "key string, png binary, color int, depth int, colors long, intact boolean")
