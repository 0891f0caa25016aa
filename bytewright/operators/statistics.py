"""Byte statistics of files: Arrow kernels count inside a file, DataFrame operators combine and decide."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import map_arrow


def as_bytes(column: str) -> Column:
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def _buffer(cell) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.uint8) if cell.is_valid else np.zeros(0, np.uint8)


def _long_rows(names: list[str], one):
    """A kernel that turns each file into rows of its key and integer columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts = [], []
            for k, cell in enumerate(batch.column(1)):
                columns = one(_buffer(cell))
                keys.append(np.full(len(columns[0]), k))
                parts.append(columns)
            if keys:
                at = pa.array(np.concatenate(keys).astype(np.int64))
                values = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *values], names=["key", *names])

    return run


def byte_counts(files: DataFrame, key: str, content: str) -> DataFrame:
    """``key, byte, n``: the byte histogram of each file; absent bytes have no row."""

    def one(data: np.ndarray):
        n = np.bincount(data, minlength=256)
        used = np.flatnonzero(n)
        return used, n[used]

    rows = files.select(F.col(key).cast("string").alias("key"), as_bytes(content).alias("data"))
    return map_arrow(rows, _long_rows(["byte", "n"], one), "key string, byte long, n long")


def bigram_counts(files: DataFrame, key: str, content: str) -> DataFrame:
    """``key, first, second, n`` of adjacent bytes."""

    def one(data: np.ndarray):
        pairs, n = np.unique(data[:-1].astype(np.int64) << 8 | data[1:], return_counts=True) if len(data) > 1 else (np.zeros(0, np.int64),) * 2
        return pairs >> 8, pairs & 255, n

    rows = files.select(F.col(key).cast("string").alias("key"), as_bytes(content).alias("data"))
    return map_arrow(rows, _long_rows(["first", "second", "n"], one), "key string, first long, second long, n long")


def distinct_counts(files: DataFrame, key: str, content: str) -> DataFrame:
    """``key, bytes, bigrams``: how many different bytes and adjacent pairs each file has, from one reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single, double = [], []
            for cell in batch.column(1):
                data = _buffer(cell)
                single.append(len(np.unique(data)))
                double.append(len(np.unique(data[:-1].astype(np.int32) << 8 | data[1:])) if len(data) > 1 else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(single, pa.int64()), pa.array(double, pa.int64())], names=["key", "bytes", "bigrams"])

    rows = files.select(F.col(key).cast("string").alias("key"), as_bytes(content).alias("data"))
    return map_arrow(rows, run, "key string, bytes long, bigrams long")


def run_counts(files: DataFrame, key: str, content: str) -> DataFrame:
    """``key, length, n``: how many runs of equal bytes of each length a file has."""

    def one(data: np.ndarray):
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.flatnonzero(np.diff(data)) + 1
        return np.unique(np.diff(np.concatenate([[0], edge, [len(data)]])), return_counts=True)

    rows = files.select(F.col(key).cast("string").alias("key"), as_bytes(content).alias("data"))
    return map_arrow(rows, _long_rows(["length", "n"], one), "key string, length long, n long")


def checksums(files: DataFrame, key: str, content: str) -> DataFrame:
    """``key, size, crc32, adler32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [c.as_buffer() for c in batch.column(1)]
            columns = [[len(c) for c in cells], [zlib.crc32(c) for c in cells], [zlib.adler32(c) for c in cells]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["key", "size", "crc32", "adler32"])

    rows = files.select(F.col(key).cast("string").alias("key"), as_bytes(content).alias("data"))
    return map_arrow(rows, run, "key string, size long, crc32 long, adler32 long")


def entropy(counts: DataFrame, by: str = "key", n: str = "n") -> DataFrame:
    """``by, total, entropy``: bits per symbol from counts, without a second pass over them.

    -sum(p log p) is log(total) - sum(n log n) / total, so both sums are combined map-side.
    """
    sums = counts.groupBy(by).agg(F.sum(n).alias("total"), F.sum(F.col(n) * F.log2(n)).alias("weighted"))
    return sums.select(by, "total", (F.log2("total") - F.col("weighted") / F.col("total")).alias("entropy"))


def symbol_costs(counts: DataFrame, by: list[str], n: str = "n", cap: float = 15.0) -> DataFrame:
    """Add ``bits``: what a symbol costs by its share in its group, at most ``cap``."""
    total = F.sum(n).over(W.partitionBy(*by))
    return counts.withColumn("bits", F.least(F.lit(cap), F.greatest(F.lit(0.0), F.log2(total) - F.log2(n))))


def fixed_literal_bits(counts: DataFrame, by: str) -> DataFrame:
    """``by, bits``: the size of a fixed block of literals alone: header, end code, 8 or 9 bits a byte."""
    each = F.col("n") * F.when(F.col("byte") < 144, 8).otherwise(9)
    return counts.groupBy(by).agg((F.sum(each) + 10).alias("bits"))


def blend(a: DataFrame, b: DataFrame, keys: list[str], share: float, value: str = "n") -> DataFrame:
    """(1 - share) * a + share * b per symbol; a missing symbol counts 0."""
    left, right = a.withColumnRenamed(value, "_a"), b.withColumnRenamed(value, "_b")
    both = left.join(right, keys, "full")
    return both.select(*keys, ((1 - share) * F.coalesce("_a", F.lit(0)) + share * F.coalesce("_b", F.lit(0))).alias(value))


def overlaps(entries: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Entries that begin before the previous one (by start) has ended."""
    before = F.lag(end).over(W.partitionBy(by).orderBy(start, end))
    return entries.withColumn("previous_end", before).where(F.col("previous_end") > F.col(start))


def islands(values: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal consecutive values in order: ``by, value, first, length``."""
    all_rows = F.row_number().over(W.partitionBy(*by).orderBy(order))
    same = F.row_number().over(W.partitionBy(*by, value).orderBy(order))
    return values.withColumn("_g", all_rows - same).groupBy(*by, value, "_g").agg(F.min(order).alias("first"), F.count("*").alias("length")).drop("_g")


def absent_names(wanted: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """The wanted rows whose name is not present in any case."""
    return wanted.join(present.select(F.lower(name).alias("_n")).distinct(), F.lower(wanted[name]) == F.col("_n"), "left_anti")


def least_unused(values: DataFrame, value: str) -> DataFrame:
    """``value``: the smallest number from 0 on that does not occur: the first gap in order.

    A number is followed by a gap if its successor is absent; only these candidates meet in one aggregate.
    """
    used = values.select(F.col(value).cast("long").alias("v")).where("v >= 0").distinct()
    candidates = used.select((F.col("v") + 1).alias("v")).unionAll(values.sparkSession.range(1).select(F.col("id").alias("v")))
    return candidates.join(used, "v", "left_anti").agg(F.min("v").alias(value))
