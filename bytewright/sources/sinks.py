"""Writing results: never larger, verified, and through a temporary name."""

from __future__ import annotations

import os
import stat
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow


def never_larger(results: DataFrame, or_equal: bool = False) -> DataFrame:
    """The rows whose ``after`` is below ``before`` (or equal); created files are kept whatever their size."""
    small = F.col("after") <= F.col("before") if or_equal else F.col("after") < F.col("before")
    return results.where(small | (F.col("status") == "created"))


def replace_file(path: str, content: bytes, times: tuple[float, float] | None = None) -> None:
    """Write beside the target, check what was written, then rename over it; ``times`` (atime, mtime) are restored.

    A file that nobody may write is left alone; another keeps its permissions.
    """
    mode = stat.S_IMODE(os.stat(path).st_mode) if os.path.exists(path) else None
    if mode is not None and not mode & (stat.S_IWUSR | stat.S_IWGRP | stat.S_IWOTH):
        raise PermissionError(f"{path} is read-only")
    temporary = f"{path}.tmp"
    with open(temporary, "xb") as out:
        out.write(content)
    with open(temporary, "rb") as back:
        if zlib.crc32(back.read()) != zlib.crc32(content):
            os.unlink(temporary)
            raise OSError(f"write of {path} failed")
    if mode is not None:
        os.chmod(temporary, mode)
    os.replace(temporary, path)
    if times:
        os.utime(path, times)


def write_files(results: DataFrame, keep_time: bool = False) -> DataFrame:
    """Replace each ``path`` (a file system all executors mount) by ``content``; returns ``path, written, error``.

    Nothing is written until the result is evaluated; a failed file is a row, not a failed job.
    """
    rows = results.select("path", "content", "modificationTime" if "modificationTime" in results.columns else F.lit(None).cast("timestamp").alias("modificationTime"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content, moment in zip(*(batch.column(c).to_pylist() for c in range(3))):
                local = path.removeprefix("file://").removeprefix("file:")
                try:
                    replace_file(local, content, (moment.timestamp(),) * 2 if keep_time and moment else None)
                    out.append((path, True, None))
                except OSError as e:
                    out.append((path, False, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate((pa.string(), pa.bool_(), pa.string()))], names=["path", "written", "error"])

    return map_arrow(rows, run, "path string, written boolean, error string")


def write_table(results: DataFrame, path: str) -> None:
    """The default sink: a table of results with their bytes; refuses to replace one."""
    results.write.mode("errorifexists").parquet(path)
