"""``python -m bytewright [flags] inputs``: optimise files in place, where executors mount them."""

from __future__ import annotations

import os
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codecs import containers
from .operators.recompress import optimize_files, optimize_gzip_in_blocks, overall_status
from .options import Options, parse_args
from .plans.report import report
from .runtime import map_arrow, ship
from .sources.files import eligible, existing, scan_files
from .sources.sinks import never_larger, write_files

USAGE = "bytewright [-1..-9] [-strip] [-progressive] [-autorotate[=force]] [-recurse] [-gzip] [-zip] [-keep] [-quiet] [--strict] [--reuse] [--allfilters] [--allfilters-b] [--allfilters-c] [--pal_sort=N] [--mt-deflate[=N]] [--mt-file[=N]] [--disable-png] [--disable-jpg] file..."


def make_zip(spark: SparkSession, inputs: list[str], options: Options) -> str:
    """Put files and directories into one archive, beside the first of them or into it if it is one.

    Tasks read and compress the files; the driver lists names and appends entries as they come, one at a time.
    """
    first = inputs[0]
    old = open(first, "rb").read() if os.path.isfile(first) else b""
    append = old[:4] == b"PK\3\4"
    target = first if append else os.path.splitext(first.rstrip("/"))[0] + ".zip"
    if not append and os.path.exists(target):
        raise FileExistsError(target)
    names: list[tuple[str, str | None]] = []
    for path in inputs[append:]:
        top = os.path.dirname(path.rstrip("/"))
        for folder, _, found in os.walk(path) if os.path.isdir(path) else [(os.path.dirname(path), [], [os.path.basename(path)])]:
            if not found and not os.listdir(folder):
                names.append((os.path.relpath(folder, top or ".") + "/", None))
            names += [(os.path.relpath(os.path.join(folder, n), top or "."), os.path.join(folder, n)) for n in sorted(found)]
    entries, base = containers.zip_entries(old) if append else ([], 0)
    seen = {e.name.lower() for e in entries}
    for name, _ in names:
        if not containers.valid_archive_name(name) or name.encode().lower() in seen:
            raise containers.FormatError(f"name: {name}")
        seen.add(name.encode().lower())
    with open(target + ".tmp", "xb") as out:
        stream = containers.ZipStream(out.write, old[:base])
        for e in entries:
            stream.add(containers.zip_optimize_entry(e, options.level, options.strict, 0, options.iterations, options.twice))
        for row in packed_entries(spark, names, options).toLocalIterator():
            stream.add(containers.ZipEntry(row.name.encode(), row.method, 0, 0, 0x21, row.crc32, 0, row.size, 0, data=bytes(row.data), external=0x10 if row.name.endswith("/") else 0))
        stream.finish()
    os.replace(target + ".tmp", target)
    return target


def packed_entries(spark: SparkSession, names: list[tuple[str, str | None]], options: Options) -> DataFrame:
    """``name, method, crc32, size, data`` of each file in order, read and compressed by the task that has it."""
    o = options

    def run(batches):
        for batch in batches:
            for name, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                content = b""
                if path is not None:
                    with open(path, "rb") as f:
                        content = f.read()
                e = containers.zip_optimize_entry(containers.zip_entry(name, content, 1), o.level, o.strict, 0, o.iterations, o.twice)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((name, pa.string()), (e.method, pa.int32()), (e.crc32, pa.int64()), (e.size, pa.int64()), (e.data, pa.binary()))], names=["name", "method", "crc32", "size", "data"])

    rows = spark.createDataFrame([(k, n, p and os.path.abspath(p)) for k, (n, p) in enumerate(names)], "k long, name string, path string")
    return map_arrow(rows, run, "name string, method int, crc32 long, size long, data binary")


def main(argv: list[str]) -> int:
    options, inputs, messages = parse_args(argv)
    for line in messages:
        print(line)
    if options.help or not inputs:
        print(USAGE)
        return 0
    spark = SparkSession.builder.appName("bytewright").getOrCreate()
    ship(spark)
    if options.zip:
        print(make_zip(spark, inputs, options))
        return 0
    paths = [os.path.abspath(p) if "://" not in p else p for p in inputs]
    _, missing = existing(spark, paths)
    if options.arithmetic:
        print("--arithmetic: JPEG files are coded with Huffman codes")
    ready = eligible(scan_files(spark, paths, options), options)
    chosen = ready.where("status = 'ready'")
    in_blocks = F.lit(bool(options.mt_deflate)) & (F.col("kind") == "gzip")
    results = optimize_files(chosen.where(~in_blocks), options).unionAll(optimize_gzip_in_blocks(chosen.where(in_blocks), options)).cache()
    code = overall_status(results).first().code | missing
    created = F.when(F.col("status") == "created", F.concat("path", F.lit(".gz"))).otherwise(F.col("path"))
    times = ready.select("path", "modificationTime").dropDuplicates(["path"])
    changed = never_larger(results).unionAll(results.where("status = 'turned'")).dropDuplicates(["path"])
    failed = write_files(changed.join(times, "path").withColumn("path", created), options.keep).agg(F.count("error").alias("n")).first().n
    code |= int(failed > 0)
    if not options.quiet:
        print(report(results))
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
