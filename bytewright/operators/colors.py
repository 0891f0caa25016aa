"""Pixels as rows: colour statistics, palettes and colour modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C


def color_counts(pixels: DataFrame, by: list[str]) -> DataFrame:
    """``by, r, g, b, a, n``: how popular each colour is."""
    return pixels.groupBy(*by, "r", "g", "b", "a").agg(F.count("*").alias("n"))


def color_summary(pixels: DataFrame, by: list[str]) -> DataFrame:
    """What decides an image's colour mode, from its colours: clear pixels count as one, and 257 stands for more."""
    counts = color_counts(pixels, by)
    gray = (F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))
    rgba = F.when(F.col("a") == 0, 0).otherwise(((F.col("r") * 256 + F.col("g")) * 256 + F.col("b")) * 256 + F.col("a"))
    seen = counts.withColumns({"_gray": gray, "_rgba": rgba})
    return seen.groupBy(*by).agg(
        F.sum("n").alias("pixels"),
        F.least(F.lit(257), F.countDistinct("_rgba")).cast("long").alias("colors"),
        F.every("_gray").alias("gray"),
        F.every(F.col("a") == 255).alias("opaque"),
        F.max(F.when(F.col("_gray"), C.required_bits(F.col("r"))).otherwise(8)).cast("long").alias("bits"),
    )


def chosen_mode(colors: Column, gray: Column, opaque: Column, bits: Column, pixels: Column) -> tuple[Column, Column]:
    """(colour type, depth) of the smallest lossless mode of 8-bit pixels without a colour key."""
    depth = F.when(colors <= 2, 1).when(colors <= 4, 2).when(colors <= 16, 4).otherwise(8)
    direct = F.when(gray, 8).otherwise(24) + F.when(opaque, 0).otherwise(8)
    as_gray = gray & opaque & ((colors > 256) | (depth >= bits))
    palette = (colors <= 256) & (colors * 32 + pixels * depth < pixels * direct)
    kind = F.when(as_gray, 0).when(palette, 3).when(gray & ~opaque, 4).when(gray, 0).when(opaque, 2).otherwise(6)
    size = F.when(as_gray, bits).when(palette, depth).otherwise(8)
    return kind.cast("int"), size.cast("int")


def indexed(pixels: DataFrame, palette: DataFrame, by: list[str]) -> DataFrame:
    """Pixels with the index of their colour in ``palette(by, r, g, b, a, idx)``."""
    return pixels.join(palette, [*by, "r", "g", "b", "a"])


def palette_rows(counts: DataFrame, by: list[str], key: Column, descending: bool = False) -> DataFrame:
    """Add ``idx``: the place of each colour, clear ones first, then by ``key``, ties by value."""
    order = [F.when(F.col("a") < 255, 0).otherwise(1), key.desc() if descending else key.asc(), "r", "g", "b", "a"]
    return counts.withColumn("idx", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)


def neighbour_pairs(indexes: DataFrame, by: list[str], x: str, y: str, idx: str) -> DataFrame:
    """``by, i, j, n``: how often two entries stand side by side or above each other, i <= j."""
    across = F.lead(idx).over(W.partitionBy(*by, y).orderBy(x))
    down = F.lead(idx).over(W.partitionBy(*by, x).orderBy(y))
    both = indexes.select(*by, F.col(idx).alias("i"), across.alias("_across"), down.alias("_down"))
    both = both.select(*by, "i", F.explode(F.array("_across", "_down")).alias("j")).where("j IS NOT NULL")
    return both.groupBy(*by, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.count("*").alias("n"))
