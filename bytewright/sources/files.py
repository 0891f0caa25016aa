"""Files as rows: scanning, sniffing and eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..options import Options

MOST_BYTES = 1_200_000_000
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def existing(spark: SparkSession, paths: list[str]) -> tuple[list[str], int]:
    """The paths that exist, on whatever file system, and a status of 1 if any does not."""
    found = []
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            found.append(path)
    return found, int(len(found) < len(paths))


def scan_files(spark: SparkSession, paths: list[str], options: Options = Options()) -> DataFrame:
    """One row per file: ``path, modificationTime, length, content``.

    Directories are listed one level deep, or wholly with ``recurse``; a path given twice is read twice.  ``length``
    filters reach the scan, and ``content`` is not read unless it is used.
    """
    found, _ = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], FILE_SCHEMA)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(options.recurse).lower())
    once = list(dict.fromkeys(found))
    out = reader.load(once)
    for path in once:
        for _ in range(found.count(path) - 1):
            out = out.unionAll(reader.load(path))
    return out


def eligible(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Add ``kind``: what is done with a file (``gzip``, ``png``, ``jpeg`` or nothing), gzip before images."""
    by_name = C.format_by_extension(F.col("path"))
    kind = F.when(F.lit(options.gzip), "gzip").when((by_name == "png") & F.lit(options.png), "png").when((by_name == "jpeg") & F.lit(options.jpeg), "jpeg")
    return files.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("status", F.when(F.col("length") >= MOST_BYTES, "too big").when((F.col("length") == 0) & (F.col("kind") == "gzip"), "empty").otherwise("ready"))


def sniff(files: DataFrame) -> DataFrame:
    """Add ``format`` by magic bytes, the gzip class and the gzip and PNG header fields."""
    data = F.col("content")
    kind = C.detect_format(data)
    return files.withColumns({"format": kind, "gzip_class": C.gzip_class(data), "gzip": F.when(kind == "gzip", C.gzip_fields(data)), "png": F.when(kind == "png", C.png_fields(data))})
