"""Candidates per file, the smallest valid one, and what it saves."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import containers, deflate, jpeg, png
from ..options import Options
from ..runtime import map_arrow
from ..sources.archives import BROKEN
from .statistics import as_bytes

STRATEGIES = {"default": zlib.Z_DEFAULT_STRATEGY, "filtered": zlib.Z_FILTERED, "rle": zlib.Z_RLE, "huffman": zlib.Z_HUFFMAN_ONLY, "fixed": zlib.Z_FIXED}
#: A gzip member around a raw stream, without a name.
GZIP_FRAME = 18


def deflate_candidates(files: DataFrame, key: str, content: str, levels: tuple[int, ...] = (1, 6, 9), strategies: tuple[str, ...] = ("default",)) -> DataFrame:
    """``key, candidate, before, after`` per file, zlib level and strategy.  Sizes leave the task, bytes do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = []
                for name, data in zip(batch.column(0).slice(k, 256).to_pylist(), batch.column(1).slice(k, 256).to_pylist()):
                    for strategy in strategies:
                        for level in levels:
                            c = zlib.compressobj(level, zlib.DEFLATED, -15, 9, STRATEGIES[strategy])
                            rows.append((name, f"{strategy}-{level}", len(data), len(c.compress(data)) + len(c.flush()) + GZIP_FRAME))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "candidate", "before", "after"])

    rows = files.select(F.col(key).cast("string").alias("key"), as_bytes(content).alias("data"))
    return map_arrow(rows, run, "key string, candidate string, before long, after long")


def smallest(candidates: DataFrame, by: list[str]) -> DataFrame:
    """One row per file: the candidate of least size, ties by name; the stored form if none is smaller."""
    best = candidates.groupBy(*by).agg(F.max("before").alias("before"), F.min(F.struct("after", "candidate")).alias("b"))
    small = F.col("b.after") < F.col("before")
    return best.select(*by, "before", F.when(small, F.col("b.after")).otherwise(F.col("before")).alias("after"), F.when(small, F.col("b.candidate")).otherwise("stored").alias("candidate"))


def savings(results: DataFrame, by: list[str]) -> DataFrame:
    """``files, bytes, saved, pct`` over ``before`` and ``after``; ``note`` where nothing was read or it grew."""
    out = results.groupBy(*by).agg(F.count("*").alias("files"), F.coalesce(F.sum("before"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.col("before") - F.col("after")), F.lit(0)).alias("saved"))
    pct = F.round(F.when(F.col("bytes") > 0, 100.0 * F.col("saved") / F.col("bytes")).otherwise(0.0), 4)
    note = F.when(F.col("files") == 0, "no compatible files").when(F.col("saved") < 0, "result is bigger").otherwise("")
    return out.withColumns({"pct": pct, "note": note})


_RESULT = "path string, kind string, before long, after long, status string, content binary"
_RESULT_TYPES = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())


def _results(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(_RESULT_TYPES)], names=["path", "kind", "before", "after", "status", "content"])


def optimize_files(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Rewrite each file of ``files(path, content, kind)``: ``path, kind, before, after, status, content``.

    Results are decoded and compared before they count; a file that fails is a row with its reason.  With
    ``mt_file`` the files are dealt over that many tasks; with ``mt_deflate`` those that ``optimize_gzip_in_blocks`` takes
    are for the caller to leave out.
    """
    o = options

    def one(path: str, data: bytes, kind: str) -> tuple[bytes, str]:
        if o.zip or data[:4] == b"PK\3\4":
            return containers.zip_optimize(data, o.level, o.strict, passes=o.iterations, rounds=o.twice), ""
        if kind == "gzip":
            return containers.gzip_optimize(data, o.level, o.strict, path, o.iterations, o.twice)
        if kind == "png":
            return png.optimize(data, o.level, o.strict, o.strip, o.reuse, o.all_filters, o.palette_sort, o.iterations, o.twice, o.all_filters_brute, o.all_filters_cheap), ""
        return jpeg.optimize(data, o.level, o.progressive, o.strip, o.autorotate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, cell, kind in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = cell.as_py() or b""
                try:
                    made, status = one(path, data, kind)
                except BROKEN as e:
                    made, status = data, f"error: {e}"
                status = status or ("smaller" if len(made) < len(data) else "kept")
                rows.append((path, kind, len(data), len(made), status, made))
                held += len(made)
                if held >= 4 << 20 or len(rows) >= 1024:
                    yield _results(rows)
                    rows, held = [], 0
            if rows:
                yield _results(rows)

    picked = files.select("path", "content", "kind")
    return map_arrow(picked.repartition(o.mt_file) if o.mt_file else picked, run, _RESULT)


def optimize_gzip_in_blocks(files: DataFrame, options: Options = Options(), master: int = 1_000_000) -> DataFrame:
    """``optimize_files`` for gzip output, a large file's master blocks in tasks of their own.

    Each block is coded with the 32 KiB before it as its window and ends at a byte border; the blocks of a file are
    joined in order, and the result is inflated and compared.
    """
    o = options

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = cell.as_py() or b""
                name, mtime, reason, content, known = os.path.basename(path), 0, None, data, containers.gzip_classify(data)
                try:
                    if not data:
                        reason = "empty"
                    elif known == "error" or known == "extras" and o.strict:
                        reason = "refused"
                    elif known != "none":
                        content, members = containers.gunzip(data)
                        name, mtime = members[0].name, members[0].mtime
                except BROKEN as e:
                    reason = f"error: {e}"
                blocks = range(0, len(content), master) if reason is None else [0]
                for at in blocks:
                    piece = content[max(0, at - deflate.WINDOW) : at + master] if reason is None else data
                    values = (path, at, min(at, deflate.WINDOW), at + master >= len(content), len(data), reason or ("created" if known == "none" else "smaller"), zlib.crc32(content), len(content), name, mtime, piece)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()))], names=names)

    names = ["path", "at", "window", "last", "before", "status", "crc", "size", "name", "mtime", "data"]
    schema = "path string, at long, window long, last boolean, before long, status string, crc long, size long, name string, mtime long, data binary"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for window, last, status, cell in zip(*(batch.column(c).to_pylist() for c in (2, 3, 5, 10))):
                good = status in ("created", "smaller")
                out.append(deflate.deflate(cell[window:], o.level, master, o.iterations, o.twice, cell[:window], last) if good else cell)
            yield pa.RecordBatch.from_arrays([*batch.columns[:10], pa.array(out, pa.binary())], names=names)

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        first = {n: table.column(n)[0].as_py() for n in names[:10]}
        body, status = b"".join(table.column("data").to_pylist()), first["status"]
        if status in ("created", "smaller"):
            made = containers.gzip_frame(body, first["crc"], first["size"], first["name"], first["mtime"])
            if zlib.crc32(containers.gunzip(made)[0]) != first["crc"]:
                raise ValueError(f"{first['path']} does not decode")
            status = status if status == "created" or len(made) < first["before"] else "kept"
        else:
            made = body
        return pa.Table.from_batches([_results([(first["path"], "gzip", first["before"], first["before"] if status == "kept" else len(made), status, None if status == "kept" else made)])])

    pieces = map_arrow(files.select("path", "content"), cut, schema)
    coded = map_arrow(pieces.repartition("path", "at"), code, schema)
    joined = coded.groupBy("path").applyInArrow(join, _RESULT)
    kept = files.select(F.col("path").alias("_path"), F.col("content").alias("_content"))
    back = joined.join(kept, F.col("path") == F.col("_path"), "left")
    return back.select("path", "kind", "before", "after", "status", F.coalesce("content", "_content").alias("content"))


def overall_status(results: DataFrame) -> DataFrame:
    """``code``: the bitwise or of the files' codes, 1 for an error."""
    code = F.when(F.col("status").startswith("error") | F.col("status").isin("refused", "empty", "too big"), 1).otherwise(0)
    return results.agg(F.coalesce(F.bit_or(code), F.lit(0)).alias("code"))


def block_plan(files: DataFrame, key: str, content: str, level: int = 3) -> DataFrame:
    """How this encoder would cut each file: ``key, block, tokens, bytes, literals, matches, fixed_bits, dynamic_bits``.

    The matches of many small files are searched together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = deflate.LEVELS[level]
        for batch in batches:
            names, cells = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            s = 0
            while s < len(cells):
                e, held = s, 0
                while e < len(cells) and (e == s or held + len(cells[e]) <= 1 << 20):
                    held, e = held + len(cells[e]), e + 1
                data, bounds = b"".join(cells[s:e]), np.concatenate([[0], np.cumsum([len(c) for c in cells[s:e]])])
                matches = deflate.Matches(data, p.chain, bounds)
                rows = []
                for name, lo, hi in zip(names[s:e], bounds[:-1].tolist(), bounds[1:].tolist()):
                    tokens = deflate.optimal_tokens(data, matches, p.passes, lo, hi)
                    cuts = [0, *deflate.split_points(tokens, p.least_split), len(tokens)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        part = tokens[a:b]
                        litlen, dist = deflate.histogram(part)
                        extra, found = deflate.extra_bits(part), int((part.distance > 0).sum())
                        rows.append((name, k, len(part), int(part.sizes.sum()), len(part) - found, found, 3 + extra + deflate.fixed_bits(litlen, dist), 3 + extra + deflate.block_lengths(litlen, dist, p.search)[0]))
                kinds = (pa.string(), *[pa.int64()] * 7)
                fields = ["key", "block", "tokens", "bytes", "literals", "matches", "fixed_bits", "dynamic_bits"]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=fields)
                s = e

    rows = files.select(F.col(key).cast("string").alias("key"), as_bytes(content).alias("data"))
    return map_arrow(rows, run, "key string, block long, tokens long, bytes long, literals long, matches long, fixed_bits long, dynamic_bits long")


def huffman_codes(counts: DataFrame, by: str, symbol: str, n: str, limit: int = 15) -> DataFrame:
    """``by, symbol, n, length, code`` of an optimal length-limited code per group; a group is one alphabet."""
    from ..codecs.huffman import canonical_codes, limited_lengths
    from ..runtime import ship

    ship(counts.sparkSession)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("symbol")
        symbols, freq = table.column("symbol").to_pylist(), table.column("n").to_pylist()
        full = [0] * (max(symbols) + 1)
        for s, f in zip(symbols, freq):
            full[s] += f
        lengths = limited_lengths(full, limit)
        codes = canonical_codes(lengths)
        used = [s for s, f in enumerate(full) if f]
        return pa.table({"grp": pa.array([table.column("grp")[0].as_py()] * len(used)), "symbol": pa.array(used, pa.int64()), "n": pa.array([full[s] for s in used], pa.int64()), "length": pa.array([lengths[s] for s in used], pa.int64()), "code": pa.array([codes[s] for s in used], pa.int64())})

    rows = counts.select(F.col(by).cast("string").alias("grp"), F.col(symbol).cast("long").alias("symbol"), F.col(n).cast("long").alias("n"))
    return rows.groupBy("grp").applyInArrow(build, "grp string, symbol long, n long, length long, code long")
