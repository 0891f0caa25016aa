"""A watched folder: the batch plan over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.recompress import optimize_files
from ..options import Options
from ..sources.files import FILE_SCHEMA, eligible


def arriving_files(spark: SparkSession, folder: str, options: Options = Options(), files_per_trigger: int = 1000) -> DataFrame:
    """A stream of new files; each is seen once."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("recursiveFileLookup", str(options.recurse).lower()).load(folder)


def watch(spark: SparkSession, folder: str, results: str, checkpoint: str, options: Options = Options(), once: bool = False) -> StreamingQuery:
    """Optimise files of ``folder`` as they come and append the results as a table.

    The checkpoint makes a restarted query go on where it stopped, and the file sink writes each batch once.
    """
    stream = optimize_files(eligible(arriving_files(spark, folder, options), options), options)
    writer = stream.writeStream.format("parquet").option("path", results).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
