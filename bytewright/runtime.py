"""Running this package's Python on the executors."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that no path needs to be set on them."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}_code.zip")
    Path(target).write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


#: Most bytes of an Arrow batch that goes to a kernel.  Spark's default of 64 MB is held several times over: by the JVM, by
#: the pipe and by the worker.
BATCH_BYTES = 8 << 20
#: Resident memory, in pages of 4 KiB, from which a worker gives memory back at the end of a task: little above what one
#: with nothing to do has.
_MANY_PAGES = (136 << 20) // 4096


def _give_back() -> None:
    """Return freed memory to the system: workers live on after a task and share an executor's limit."""
    try:
        with open("/proc/self/statm") as f:
            if int(f.read().split()[1]) < _MANY_PAGES:
                return
        gc.collect()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, unless it states a bound itself."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def tidy(function):
    """An Arrow kernel that gives its memory back when its task ends."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            _give_back()

    return run


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand and batches bounded in bytes."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(tidy(function), schema)
