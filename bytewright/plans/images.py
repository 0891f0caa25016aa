"""Driver tables as images: an embedding's bytes are a scanline or sixteen pixels, a part is a coloured pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table


def quantised(column: str = "embedding") -> Column:
    """A vector with entries from -1 to 1 as bytes."""
    return F.transform(column, lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int"))


SQL_PIXELS = """
q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(floor((x::DOUBLE + 1) * 127.5), 0), 255) AS BIGINT) // 64 * 85) AS v FROM embeddings),
pixels AS (SELECT vec_id, i AS at, i % 4 AS x, i // 4 AS y, v[4 * i + 1] AS r, v[4 * i + 2] AS g, v[4 * i + 3] AS b, CASE WHEN v[4 * i + 4] > 85 THEN 255 ELSE 0 END AS a
  FROM (SELECT vec_id, v, unnest(range(0, len(v) // 4)) AS i FROM q))
"""


def coarse(column: str = "embedding") -> Column:
    """Sixteen RGBA pixels with four levels a colour and alpha on or off."""
    levels = F.transform(quantised(column), lambda x: (F.floor(x / 64) * 85).cast("int"))
    return F.transform(levels, lambda v, i: F.when(i % 4 == 3, F.when(v > 85, 255).otherwise(0)).otherwise(v))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", coarse().alias("v"))
    rows = rows.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.floor(F.size("v") / 4).cast("int") - 1)).alias("at"))
    sample = lambda k: F.get("v", F.col("at") * 4 + k).cast("long")
    return rows.select("vec_id", "at", (F.col("at") % 4).alias("x"), F.floor(F.col("at") / 4).alias("y"), sample(0).alias("r"), sample(1).alias("g"), sample(2).alias("b"), sample(3).alias("a"))


def part_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_size") % 8).alias("image"), (F.col("p_partkey") * 37 % 256).alias("r"), (F.col("p_partkey") * 11 % 256).alias("g"), (F.col("p_size") * 5 % 256).cast("long").alias("b"), F.when(F.col("p_partkey") % 9 == 0, 128).otherwise(255).cast("long").alias("a"))
