"""Queries over files, containers, codes, parses and images, with SQL that knows the results by another way."""

from __future__ import annotations

import gzip
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..codecs import containers, deflate, huffman, jpeg, png
from ..functions import columns as C
from ..operators import colors, recompress
from ..operators.statistics import as_bytes
from ..options import Options, level_options, parse_args
from ..runtime import map_arrow
from ..sources import archives, files, sinks
from ..streaming.watch import watch
from .images import SQL_PIXELS, coarse, part_colors, pixels
from .registry import query, shared_folder, table


def _kernel(one, fields: list[tuple[str, pa.DataType]]):
    """A kernel that makes any number of rows of each row's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                rows = [r for values in zip(*(c.to_pylist() for c in part.columns)) for r in one(*values)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, (_, k) in enumerate(fields)], names=[n for n, _ in fields])

    return run


# Files


@query(
    """
    SELECT n_regionkey AS region, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(n_name) + 1) AS BIGINT) AS bytes, CAST(sum(length(n_name) + 1) AS BIGINT) AS loaded
    FROM nation GROUP BY n_regionkey
    """
)
def scanned_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as a folder of files for each region, scanned recursively and loaded whole."""
    path = shared_folder(spark, "folders")
    table(spark, sf_dir, "nation").select("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(path)
    found = files.scan_files(spark, [path], Options(recurse=True))
    region = F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int")
    lines = F.size(F.split(F.col("content").cast("string"), "\n")) - 1
    return found.groupBy(region.alias("region")).agg(F.sum(lines).cast("long").alias("lines"), F.sum("length").alias("bytes"), F.sum(F.length("content")).cast("long").alias("loaded"))


@query(
    """
    SELECT n_regionkey AS region, CAST(sum(length(n_name) + 1) * CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END AS BIGINT) AS bytes, 1 AS missing
    FROM nation GROUP BY n_regionkey
    """
)
def scanned_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same folders as arguments, listed flat: one is named twice and read twice, one does not exist."""
    path = shared_folder(spark, "arguments")
    table(spark, sf_dir, "nation").select("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(path)
    regions = [r.n_regionkey for r in table(spark, sf_dir, "nation").select("n_regionkey").distinct().collect()]
    inputs = [f"{path}/n_regionkey={k}" for k in [*regions, 1]] + [f"{path}/none"]
    _, missing = files.existing(spark, inputs)
    found = files.scan_files(spark, inputs)
    return found.groupBy(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int").alias("region")).agg(F.sum("length").alias("bytes")).withColumn("missing", F.lit(missing))


_SQL_FILES = """
f AS (SELECT o_orderkey AS id, o_custkey % 4 * 400000000 AS length, CASE o_orderkey % 9 WHEN 0 THEN 'png' WHEN 1 THEN 'PNG' WHEN 2 THEN 'jpg' WHEN 3 THEN 'JPEG' WHEN 4 THEN 'Jpg'
  WHEN 5 THEN 'jpeg' WHEN 6 THEN 'gz' WHEN 7 THEN 'txt' ELSE 'JPG' END AS ext FROM orders),
k AS (SELECT *, CASE WHEN ext IN ('png', 'PNG') THEN 'png' WHEN ext IN ('jpg', 'JPG', 'jpeg', 'JPEG') THEN 'jpeg' END AS by_name FROM f)
"""


@query(
    f"""
    WITH {_SQL_FILES}
    SELECT id, 'images' AS run, by_name AS kind, CASE WHEN length >= 1200000000 THEN 'too big' ELSE 'ready' END AS status FROM k WHERE by_name IS NOT NULL
    UNION ALL SELECT id, 'gzip', 'gzip', CASE WHEN length >= 1200000000 THEN 'too big' WHEN length = 0 THEN 'empty' ELSE 'ready' END FROM k
    UNION ALL SELECT id, 'no png', by_name, CASE WHEN length >= 1200000000 THEN 'too big' ELSE 'ready' END FROM k WHERE by_name = 'jpeg'
    """
)
def eligible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is done with files of all kinds and sizes under three sets of options."""
    endings = F.array(*[F.lit(e) for e in ("png", "PNG", "jpg", "JPEG", "Jpg", "jpeg", "gz", "txt", "JPG")])
    orders = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("a.b/file."), F.element_at(endings, (F.col("o_orderkey") % 9 + 1).cast("int")))
    listed = orders.select(F.col("o_orderkey").alias("id"), path.alias("path"), (F.col("o_custkey") % 4 * 400_000_000).cast("long").alias("length"))
    runs = {"images": Options(), "gzip": Options(gzip=True), "no png": Options(png=False)}
    parts = [files.eligible(listed, o).select("id", F.lit(name).alias("run"), "kind", "status") for name, o in runs.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(
    """
    SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gzip' WHEN 3 THEN 'zip' ELSE 'unknown' END AS format,
      CASE page_id % 6 WHEN 2 THEN 'gzip' ELSE 'none' END AS gzip_class, coalesce(url, '') <> '' AND url NOT LIKE '/%' AND NOT contains(url, ':') AND NOT contains(url, chr(92)) AS valid_name
    FROM pages
    """
)
def sniffed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by magic bytes before the page's own, and whether its url could name an archive entry."""
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("89504E470D0A1A0A", "FFD8FFE0", "1F8B0800000000000203", "504B0304", "1F8B", "89504E47")])
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.element_at(heads, (F.col("page_id") % 6 + 1).cast("int")), F.lit(b"-"), as_bytes("html")).alias("content"))
    found = files.sniff(rows)
    return found.select("page_id", "format", "gzip_class", C.valid_archive_name(F.coalesce("url", F.lit(""))).alias("valid_name"))


_GZIP_CASES = ("plain", "stored", "extra", "reserved", "truncated", "checksum", "empty", "comment")


def _gzip_case(doc: int, text: str | None):
    """One of eight kinds of gzip input, and what both ways of rewriting make of it."""
    data, case = (text or "").encode(), _GZIP_CASES[doc % 8]
    c = zlib.compressobj(0, zlib.DEFLATED, -15)
    frame = containers.gzip_frame(c.compress(data) + c.flush(), zlib.crc32(data), len(data))
    made = {
        "plain": data,
        "stored": frame,
        "extra": frame[:3] + b"\x04" + frame[4:10] + b"\x02\0zz" + frame[10:],
        "reserved": frame[:3] + b"\x20" + frame[4:],
        "truncated": frame[:-3],
        "checksum": frame[:-8] + bytes([frame[-8] ^ 1]) + frame[-7:],
        "empty": b"",
        "comment": frame[:3] + b"\x10" + frame[4:10] + b"note\0" + frame[10:],
    }[case]
    for strict in (False, True):
        out, status = containers.gzip_optimize(made, 2, strict, "name.txt")
        good = status in ("created", "smaller", "kept")
        yield doc, strict, case, status, containers.gunzip(out)[0] if good else None


@query(
    """
    SELECT doc_id, strict, kase AS "case", CASE kase WHEN 'plain' THEN CASE WHEN t = '' THEN 'empty' ELSE 'created' END WHEN 'stored' THEN 'smaller' WHEN 'extra' THEN CASE WHEN strict THEN 'refused' ELSE 'smaller' END
        WHEN 'comment' THEN CASE WHEN strict THEN 'refused' ELSE 'smaller' END WHEN 'reserved' THEN 'refused' WHEN 'empty' THEN 'empty' ELSE 'error: ' || kase END AS status,
      CASE WHEN kase = 'plain' AND t <> '' OR kase = 'stored' OR kase IN ('extra', 'comment') AND NOT strict THEN md5(t) END AS digest
    FROM (SELECT doc_id, coalesce(text, '') AS t, ['plain', 'stored', 'extra', 'reserved', 'truncated', 'checksum', 'empty', 'comment'][doc_id % 8 + 1] AS kase FROM documents), (VALUES (false), (true)) s(strict)
    """
)
def gzip_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight kinds of gzip input, sound and broken, under both policies: the status, and the digest of what is inside."""
    fields = [("doc_id", pa.int64()), ("strict", pa.bool_()), ("case", pa.string()), ("status", pa.string()), ("content", pa.binary())]
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    made = map_arrow(docs, _kernel(_gzip_case, fields), "doc_id long, strict boolean, case string, status string, content binary")
    return made.select("doc_id", "strict", "case", "status", F.md5("content").alias("digest"))


def _zip_entry(key: int, html: str | None) -> tuple[containers.ZipEntry, str]:
    content = (html or "").encode()
    name, case = f"p/{key}.html".encode(), key % 7
    base = dict(flags=0, time=0, date=0x21, crc32=zlib.crc32(content), compressed_size=0, size=len(content), offset=0)
    packed = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packed.compress(content) + packed.flush()
    made = {
        0: lambda: containers.ZipEntry(name, 0, data=content, **base),
        1: lambda: containers.ZipEntry(name, 8, data=body, **base),
        2: lambda: containers.ZipEntry(name, 8, data=body, **(base | {"flags": 1})),
        3: lambda: containers.ZipEntry(name, 8, data=body, **(base | {"crc32": base["crc32"] ^ 1})),
        4: lambda: containers.ZipEntry(name, 12, data=body, **base),
        5: lambda: containers.ZipEntry(name, 8, data=b"\x03\0", **(base | {"crc32": 0, "size": 0})),
        6: lambda: containers.ZipEntry(name, 8, data=b"\x01\x02\0\xfd\xff" + b"ab", **(base | {"crc32": zlib.crc32(b"ab"), "size": 2})),
    }
    return made[case](), name.decode()


@query(
    """
    SELECT CAST(page_id // 500 AS VARCHAR) AS archive, 'p/' || page_id || '.html' AS name, CAST(CASE page_id % 7 WHEN 0 THEN 0 WHEN 4 THEN 12 WHEN 5 THEN 0 WHEN 6 THEN 0 ELSE 8 END AS INTEGER) AS method,
      CAST(CASE page_id % 7 WHEN 5 THEN 0 WHEN 6 THEN 2 ELSE octet_length(encode(coalesce(html, ''))) END AS BIGINT) AS size, page_id % 7 NOT IN (2, 3, 4) AS intact, page_id % 7 = 2 AS encrypted, NULL::VARCHAR AS error
    FROM pages
    """
)
def zip_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of stored, deflated, encrypted, corrupt, foreign, empty and tiny entries behind a prefix, rewritten."""

    def build(batch: pa.Table) -> pa.Table:
        rows = sorted(zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()))
        made = containers.zip_write([_zip_entry(k, h)[0] for k, h in rows], b"prefix")
        return pa.table({"archive": pa.array([batch.column("archive")[0].as_py()], pa.string()), "zip": pa.array([made], pa.binary())})

    def rewrite(archive: str, data: bytes):
        yield archive, containers.zip_optimize(data, 2)

    pages = table(spark, sf_dir, "pages").select(F.expr("cast(page_id div 500 AS string)").alias("archive"), F.col("page_id").cast("long"), "html")
    # The package reaches the executors with the next kernel.
    built = map_arrow(pages.groupBy("archive").applyInArrow(build, "archive string, zip binary"), _kernel(rewrite, [("archive", pa.string()), ("zip", pa.binary())]), "archive string, zip binary")
    return archives.zip_entries(built, "archive", "zip").select("archive", "name", "method", "size", "intact", "encrypted", "error")


def _nested(key: int, html: str | None):
    """A page in an archive in an archive, rewritten with and without a look inside."""
    content = (html or "").encode()
    loose = lambda name, data: containers.zip_write([containers.ZipEntry(name, 8, 0, 0, 0x21, zlib.crc32(data), 0, len(data), 0, data=zlib.compress(data, 0)[2:-4])])
    inner = loose(b"page.html", content)
    outer = loose(b"inner.zip", inner)
    for strict in (False, True):
        made = containers.zip_optimize(outer, 2, strict)
        held = containers.zip_content(containers.zip_entries(made)[0][0])
        back = containers.zip_entries(held)[0][0]
        yield key, strict, containers.zip_content(back), held == inner, len(made) < len(outer)


@query("SELECT page_id, strict, md5(coalesce(html, '')) AS digest, strict AS untouched, true AS smaller FROM pages, (VALUES (false), (true)) s(strict)")
def nested_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in archives in archives: only without ``strict`` is the inner one rewritten."""
    fields = [("page_id", pa.int64()), ("strict", pa.bool_()), ("content", pa.binary()), ("untouched", pa.bool_()), ("smaller", pa.bool_())]
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "html")
    made = map_arrow(pages, _kernel(_nested, fields), "page_id long, strict boolean, content binary, untouched boolean, smaller boolean")
    return made.select("page_id", "strict", F.md5("content").alias("digest"), "untouched", "smaller")


def _gzip_file(doc: int, text: str | None):
    data = (text or "").encode()
    packed = gzip.compress(data, 1, mtime=0)
    yield f"{doc}.txt", "gzip", [data, packed, packed[:-2], b"", packed[:3] + b"\x40" + packed[4:]][doc % 5]


@query(
    """
    WITH f AS (SELECT CASE WHEN doc_id % 5 = 3 OR doc_id % 5 = 0 AND coalesce(text, '') = '' THEN 'empty' WHEN doc_id % 5 = 0 THEN 'created' WHEN doc_id % 5 = 1 THEN 'rewritten' WHEN doc_id % 5 = 2 THEN 'error: truncated' ELSE 'refused' END AS status,
      octet_length(encode(coalesce(text, ''))) AS n, doc_id FROM documents)
    SELECT status, CAST(count(*) AS BIGINT) AS files, 1 AS overall, CAST(sum(CASE WHEN doc_id % 5 = 0 THEN n WHEN doc_id % 5 = 3 THEN 0 END) AS BIGINT) AS bytes FROM f GROUP BY status
    """
)
def rewrite_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as gzip input of five kinds through the per-file rewrite: files of each status, and the status of the run."""
    fields = [("path", pa.string()), ("kind", pa.string()), ("content", pa.binary())]
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    results = recompress.optimize_files(map_arrow(docs, _kernel(_gzip_file, fields), "path string, kind string, content binary"), Options(level=2, gzip=True))
    status = F.when(F.col("status").isin("smaller", "kept"), "rewritten").otherwise(F.col("status"))
    known = F.when(status.isin("created", "empty"), F.col("before"))
    totals = results.groupBy(status.alias("status")).agg(F.count("*").alias("files"), F.sum(known).alias("bytes"))
    return totals.crossJoin(F.broadcast(recompress.overall_status(results).select(F.col("code").cast("int").alias("overall"))))


@query(
    """
    WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS key, octet_length(encode(coalesce(text, ''))) AS n, length(coalesce(text, '')) AS c FROM documents),
    k AS (SELECT key, n, unnest([{'a': c, 'k': 'chars'}, {'a': (n + 6) // 7 * 6, 'k': 'packed'}, {'a': n + 1, 'k': 'framed'}, {'a': c, 'k': 'again'}]) AS x FROM s),
    b AS (SELECT key, n, min(ROW(x.a, x.k)) AS b FROM k GROUP BY key, n)
    SELECT key, CAST(n AS BIGINT) AS before, CAST(least(b[1], n) AS BIGINT) AS after, CASE WHEN b[1] < n THEN b[2] ELSE 'stored' END AS candidate FROM b
    """
)
def smallest_of_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest of four candidates of known sizes, ties by name, stored if none is smaller."""
    docs = table(spark, sf_dir, "documents")
    n, c = F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), F.length(F.coalesce("text", F.lit(""))).cast("long")
    sizes = {"chars": c, "packed": F.floor((n + 6) / 7) * 6, "framed": n + 1, "again": c}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("candidate"), v.cast("long").alias("after")) for k, v in sizes.items()]))
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), n.alias("before"), each.alias("x")).select("key", "before", "x.candidate", "x.after")
    return recompress.smallest(rows, ["key"]).select("key", "before", "after", "candidate")


# Arguments, and what they change.
_ARGUMENTS = {
    "-strip": "strip=True",
    "-s": "strip=True",
    "-": "strip=True",
    "-prog": "progressive=True",
    "-autorotate=force": "autorotate=1",
    "-a": "autorotate=2",
    "-rec": "recurse=True",
    "-gzip": "gzip=True",
    "-zip": "gzip=True,zip=True",
    "-q": "quiet=True",
    "-keep": "keep=True",
    "--disable-png": "png=False",
    "--disable-jpeg": "jpeg=False",
    "--strict": "strict=True",
    "--reuse": "reuse=True",
    "--allfilters": "all_filters=True",
    "--allfilters-b": "all_filters=True,all_filters_brute=True",
    "--pal_sort=77": "palette_sort=77",
    "--pal_sort=999": "palette_sort=120",
    "--mt-deflate=3": "mt_deflate=3",
    "--mt-file=2": "mt_file=2",
    "-7": "level=7",
    "-0": "level=1",
    "-20015": "iterations=15,level=9,twice=2",
    "--bogus": "unknown flag: --bogus",
    "a file": "input: a file",
}


def _parsed(key: int, argument: str):
    options, inputs, messages = parse_args([argument])
    plain = Options(strict=False)
    changed = [f"{k}={v}" for k, v in sorted(vars(options).items()) if getattr(plain, k) != v]
    yield key, argument, ",".join([*changed, *(f"input: {i}" for i in inputs), *(m for m in messages if m.startswith("unknown"))])


@query(f"SELECT o_orderkey AS key, [{', '.join(repr(a) for a in _ARGUMENTS)}][o_orderkey % {len(_ARGUMENTS)} + 1] AS argument, [{', '.join(repr(v) for v in _ARGUMENTS.values())}][o_orderkey % {len(_ARGUMENTS)} + 1] AS changes FROM orders")
def parsed_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each argument of a command line changes."""
    argument = F.element_at(F.array(*[F.lit(a) for a in _ARGUMENTS]), (F.col("o_orderkey") % len(_ARGUMENTS) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long"), argument)
    return map_arrow(rows, _kernel(_parsed, [("key", pa.int64()), ("argument", pa.string()), ("changes", pa.string())]), "key long, argument string, changes string")


@query(
    """
    SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(octet_length(encode(coalesce(n_name, '')))) AS BIGINT) AS bytes, string_agg(md5(n_name), ',' ORDER BY md5(n_name)) AS digests FROM nation
    """
)
def watched_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations arrive as files of their own; a stream makes gzip files of them, each once."""
    folder, results, checkpoint = (shared_folder(spark, n) for n in ("arriving", "watched", "state"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nations.repartition("n_nationkey").write.partitionBy("n_nationkey").option("lineSep", "|").text(folder)
    for _ in range(2):
        stream = watch(spark, folder, results, checkpoint, Options(gzip=True, recurse=True, level=2), once=True)
        stream.awaitTermination()
    back = archives.gzip_contents(spark.read.parquet(results).select("path", "content"))
    name = F.rtrim(F.col("content").cast("string"), F.lit("|"))
    return back.agg(F.count("*").alias("files"), F.sum(F.octet_length(name)).cast("long").alias("bytes"), F.array_join(F.sort_array(F.collect_list(F.md5(name.cast("binary")))), ",").alias("digests"))


@query(
    """
    SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN n_name || n_name ELSE n_name || '+' END AS content, CAST(1000000000 + n_nationkey AS BIGINT) AS modified FROM nation
    """
)
def written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as files, then over them what is smaller, and what was made anew; times are kept."""
    path = shared_folder(spark, "written")
    os.makedirs(path.removeprefix("file://"), exist_ok=True)
    n = table(spark, sf_dir, "nation")
    target = F.concat(F.lit(path + "/"), F.col("n_nationkey"), F.lit(".txt"))
    moment = F.timestamp_seconds(F.col("n_nationkey") + 1_000_000_000)
    rows = n.select(target.alias("path"), F.concat("n_name", "n_name").cast("binary").alias("content"), moment.alias("modificationTime"))
    sinks.write_files(rows, keep_time=True).agg(F.count("written")).first()
    case = F.col("n_nationkey") % 3
    text = F.when(case == 0, F.col("n_name")).when(case == 1, F.concat("n_name", "n_name", "n_name")).otherwise(F.concat("n_name", F.lit("+")))
    status = F.when(case == 2, "created").otherwise("kept")
    again = n.select(target.alias("path"), text.cast("binary").alias("content"), moment.alias("modificationTime"), (2 * F.length("n_name")).alias("before"), F.length(text).alias("after"), status.alias("status"))
    sinks.write_files(sinks.never_larger(again), keep_time=True).agg(F.count("written")).first()
    back = spark.read.format("binaryFile").load(path)
    key = n.schema["n_nationkey"].dataType
    return back.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast(key).alias("n_nationkey"), F.col("content").cast("string").alias("content"), F.unix_timestamp("modificationTime").alias("modified"))


# Codes


_SQL_LANG_BYTES = "SELECT lang AS grp, byte, count(*) AS n FROM (SELECT lang, unnest(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS byte FROM documents) GROUP BY ALL"


def _merged_bits(limit: int) -> str:
    """Package-merge in SQL: the cost of an optimal code of at most ``limit`` bits."""
    return f"""SELECT grp, CAST(list_sum(row[1:2 * len(w) - 2]) AS BIGINT) AS bits FROM (
      WITH RECURSIVE m AS (SELECT grp, list_sort(list(n)) AS w, list_sort(list(n)) AS row, 1 AS k FROM c GROUP BY grp
        UNION ALL SELECT grp, w, list_sort(list_concat(w, list_transform(range(1, len(row) // 2 + 1), lambda i: row[2 * i - 1] + row[2 * i]))), k + 1 FROM m WHERE k < {limit})
      SELECT * FROM m WHERE k = {limit})"""


@query(
    f"""
    WITH c AS ({_SQL_LANG_BYTES}), a AS ({_merged_bits(15)}), b AS ({_merged_bits(8)})
    SELECT a.grp, CAST((SELECT count(*) FROM c WHERE c.grp = a.grp) AS BIGINT) AS symbols, a.bits AS bits_15, b.bits AS bits_8, 32768 AS kraft_15, 32768 AS kraft_8 FROM a JOIN b ON a.grp = b.grp
    """
)
def limited_code_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each language's bytes cost in optimal codes of at most 15 and 8 bits, and how full the codes are."""
    from .catalog import byte_histogram

    counts = byte_histogram(spark, sf_dir)
    parts = []
    for limit in (15, 8):
        codes = recompress.huffman_codes(counts, "key", "byte", "n", limit)
        parts.append(codes.groupBy("grp").agg(F.count("*").alias("symbols"), F.sum(F.col("n") * F.col("length")).alias(f"bits_{limit}"), F.sum(F.pow(F.lit(2.0), 15 - F.col("length"))).cast("int").alias(f"kraft_{limit}")))
    return parts[0].join(parts[1].drop("symbols"), "grp")


def _order_lengths(key: int, quantities: list[int]):
    """Code lengths from the quantities of an order's lines; their canonical codes, and the lengths through run symbols."""
    lengths = [q % 16 for q in quantities for _ in range(1 + q % 5)]
    codes = huffman.canonical_codes(lengths)
    for even in (False, True):
        back: list[int] = []
        for symbol, extra in huffman.rle_code_lengths(lengths, even=even):
            back += [back[-1]] * (extra + 3) if symbol == 16 else [0] * (extra + (3 if symbol == 17 else 11)) if symbol > 16 else [symbol]
        yield key, even, codes, back, len(lengths), huffman.two_distance_codes([*lengths, 0, 0])


@query(
    """
    WITH o AS (SELECT l_orderkey AS k, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS q FROM lineitem GROUP BY l_orderkey),
    l AS (SELECT k, list_transform(flatten(list_transform(q, lambda x: list_transform(range(0, 1 + x % 5), lambda y: x % 16))), lambda z: CAST(z AS INTEGER)) AS lengths FROM o),
    s AS (SELECT k, unnest(lengths) AS n, generate_subscripts(lengths, 1) AS i FROM l),
    c AS (SELECT k, i, n, CASE WHEN n > 0 THEN coalesce(sum(CASE WHEN n > 0 THEN 32768 >> n ELSE 0 END) OVER (PARTITION BY k ORDER BY n, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT >> (15 - n) ELSE 0 END AS code FROM s)
    SELECT l.k AS l_orderkey, even, codes, lengths AS back, CAST(len(lengths) AS BIGINT) AS n,
      list_transform(list_concat(lengths, [0, 0]), lambda n, i: CAST(CASE WHEN n = 0 AND i <= 2 AND len(list_filter(lengths, lambda m: m > 0)) + CASE WHEN i = 2 AND lengths[1] = 0 THEN 1 ELSE 0 END < 2 THEN 1 ELSE n END AS INTEGER)) AS patched
    FROM l JOIN (SELECT k, list(CAST(code AS BIGINT) ORDER BY i) AS codes FROM c GROUP BY k) x ON x.k = l.k, (VALUES (false), (true)) e(even)
    """
)
def canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical codes of code lengths taken from orders, and the lengths themselves after run-length coding."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"))
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("k")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    fields = [("l_orderkey", pa.int64()), ("even", pa.bool_()), ("codes", pa.list_(pa.int64())), ("back", pa.list_(pa.int32())), ("n", pa.int64()), ("patched", pa.list_(pa.int32()))]
    return map_arrow(orders.select("k", "lines.q"), _kernel(_order_lengths, fields), "l_orderkey long, even boolean, codes array<bigint>, back array<int>, n long, patched array<int>")


@query("SELECT o_orderkey, CAST(least(greatest(n % 10000, 1), 9) AS INTEGER) AS level, CAST(CASE WHEN n % 10000 > 9 THEN n % 10000 END AS INTEGER) AS iterations, CAST(n // 10000 AS INTEGER) AS twice FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 12 ELSE o_orderkey END AS n FROM orders)")
def level_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What level numbers of any size stand for."""

    def one(key: int, number: int):
        found = level_options(number)
        yield key, found["level"], found.get("iterations"), found["twice"]

    number = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 12).otherwise(F.col("o_orderkey")).cast("long")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", number.alias("n"))
    key = rows.schema["o_orderkey"].dataType.simpleString()
    fields = [("o_orderkey", pa.int64() if key == "bigint" else pa.int32()), ("level", pa.int32()), ("iterations", pa.int32()), ("twice", pa.int32())]
    return map_arrow(rows, _kernel(one, fields), f"o_orderkey {key}, level int, iterations int, twice int")


# Parses


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one text, its turns in order."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.array_join("t.text", "\n").alias("text"))


_SQL_TALKS = "t AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS text FROM conversations GROUP BY conv_id)"


def _expanded(tokens: deflate.Tokens) -> bytes:
    out = bytearray()
    for value, distance in zip(tokens.value.tolist(), tokens.distance.tolist()):
        if not distance:
            out.append(value)
        else:
            for _ in range(value):
                out.append(out[-distance])
    return bytes(out)


def _parses(key: int, text: str):
    """The text behind the tokens of three parses: lazy, cheapest, and cheapest over all distances after splitting short matches."""
    data = text.encode()
    matches = deflate.Matches(data, 16)
    lazy = deflate.lazy_tokens(data, matches)
    best = deflate.optimal_tokens(data, matches, 1)
    every = deflate.optimal_tokens(data, deflate.Matches(data, 64, every=True), 1)
    _, x, y = deflate.block_lengths(*deflate.histogram(every), 0)
    plain = deflate.cheaper_literals(every, data, x, y)
    for name, tokens in (("lazy", lazy), ("cheapest", best), ("every", every), ("literals", plain)):
        litlen, _ = deflate.histogram(tokens)
        yield key, name, _expanded(tokens), int(tokens.sizes.sum()), sum(litlen) - 1 == len(tokens)


@query(
    f"""
    WITH {_SQL_TALKS} SELECT conv_id, parse, md5(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, true AS counted
    FROM t, (VALUES ('lazy'), ('cheapest'), ('every'), ('literals')) p(parse)
    """
)
def parse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as literals and matches by four parses, expanded again."""
    fields = [("conv_id", pa.int64()), ("parse", pa.string()), ("content", pa.binary()), ("bytes", pa.int64()), ("counted", pa.bool_())]
    found = map_arrow(_talks(spark, sf_dir), _kernel(_parses, fields), "conv_id long, parse string, content binary, bytes long, counted boolean")
    return found.select("conv_id", "parse", F.md5("content").alias("digest"), "bytes", "counted")


def _deflated(key: int, text: str):
    """A conversation through the encoder at one of its levels, in small master blocks, and back."""
    data, level = text.encode(), (1, 2, 3, 4, 5, 9)[key % 6]
    made = deflate.deflate(data, level, master=(1000 if key % 2 else 1_000_000), passes=1 if level > 3 else None, rounds=key % 3 // 2)
    packed = b"\x78\xda" + made + struct.pack(">I", zlib.adler32(data))
    parts = deflate.deflate(data[:500], 2, final=False) + deflate.deflate(data[500:], 2, window=data[:500])
    yield key, level, zlib.decompress(packed), deflate.inflate(parts), deflate.inflate(deflate.best_deflate(data, 2))


@query(f"WITH {_SQL_TALKS} SELECT conv_id, CAST([1, 2, 3, 4, 5, 9][conv_id % 6 + 1] AS INTEGER) AS level, md5(text) AS digest, md5(text) AS parts, md5(text) AS best FROM t")
def deflate_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations through this package's encoder at six levels, whole and in parts, inflated by zlib."""
    fields = [("conv_id", pa.int64()), ("level", pa.int32()), ("whole", pa.binary()), ("parts", pa.binary()), ("best", pa.binary())]
    found = map_arrow(_talks(spark, sf_dir), _kernel(_deflated, fields), "conv_id long, level int, whole binary, parts binary, best binary")
    return found.select("conv_id", "level", F.md5("whole").alias("digest"), F.md5("parts").alias("parts"), F.md5("best").alias("best"))


@query("SELECT CAST(item_id AS VARCHAR) AS path, md5(coalesce(text, '')) AS digest, 'created' AS status, 1 AS members FROM benchmark")
def gzip_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as gzip files whose blocks were coded in tasks of their own, and read back."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), as_bytes("text").alias("content"))
    made = recompress.optimize_gzip_in_blocks(items, Options(level=3, mt_deflate=1), master=64)
    back = archives.gzip_contents(made.select("path", "content"))
    return back.join(made.select("path", "status"), "path").select("path", F.md5("content").alias("digest"), "status", "members")


@query("WITH b AS (SELECT CAST(item_id AS VARCHAR) AS path, ord_bytes FROM (SELECT item_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS ord_bytes FROM benchmark)), t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_concat([n], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc) SELECT path, xor(list_reduce(list_concat([4294967295::BIGINT], ord_bytes), lambda c, x: xor(crc[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8)), 4294967295::BIGINT) AS crc32 FROM b, t")
def crc32_of_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of every benchmark passage."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.crc32(as_bytes("text")).alias("crc32"))


# Images


def _every_mode(key: int, samples: list[int]):
    """An image of one of the fifteen modes, interlaced or not, decoded, and after a strict rewrite at one of two levels."""
    modes = [(c, d) for c, depths in png.DEPTHS.items() for d in depths]
    color, depth = modes[key % len(modes)]
    channels, width = png.CHANNELS[color], 4
    height = len(samples) // (width * channels)
    values = np.array(samples[: height * width * channels], np.uint32).reshape(height, width, channels)
    values = (values * 257 if depth == 16 else values >> (8 - depth)).astype(np.uint16)
    interlace = key // len(modes) % 2
    h = png.Header(width, height, depth, color, interlace)
    body = b""
    for (x, y, dx, dy), (w, n) in zip(png.ADAM7 if interlace else ((0, 0, 1, 1),), h.passes()):
        if w and n:
            body += png.apply_filters(png.pack_samples(values[y::dy, x::dx], depth), h.pixel_bytes, [k % 5 for k in range(n)])
    parts = [png.SIGNATURE, png.write_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlace))]
    if color == 3:
        parts.append(png.write_chunk(b"PLTE", bytes(v for i in range(1 << depth) for v in (i, 255 - i, i // 2))))
    parts.append(png.write_chunk(b"tEXt", b"Comment\0" + str(key).encode()))
    data = b"".join([*parts, png.write_chunk(b"IDAT", zlib.compress(body)), png.write_chunk(b"IEND", b"")])
    image = png.decode(data)
    again = png.decode(png.optimize(data, 1 + key % 3))
    sums = lambda i: [int(v) for v in (i.pixels.astype(np.int64) * (1 if i.deep else 257)).sum(axis=(0, 1))]
    yield key, color, depth, bool(interlace), height, sums(image), sums(again), len(png.filter_types(data)), [t.text for t in png.texts(data)]


_SQL_QUANTISED = "list_transform(embedding, lambda x: CAST(least(greatest(floor((x::DOUBLE + 1) * 127.5), 0), 255) AS BIGINT))"


@query(
    f"""
    WITH modes AS (SELECT [0, 0, 0, 0, 0, 2, 2, 3, 3, 3, 3, 4, 4, 6, 6] AS cs, [1, 2, 4, 8, 16, 8, 16, 1, 2, 4, 8, 8, 16, 8, 16] AS ds),
    v AS (SELECT vec_id, cs[vec_id % 15 + 1] AS color, ds[vec_id % 15 + 1] AS depth, vec_id // 15 % 2 = 1 AS interlaced, {_SQL_QUANTISED} AS q FROM embeddings, modes),
    c AS (SELECT *, CASE color WHEN 2 THEN 3 WHEN 4 THEN 2 WHEN 6 THEN 4 ELSE 1 END AS ch FROM v),
    h AS (SELECT *, len(q) // (4 * ch) AS height FROM c),
    s AS (SELECT *, list_transform(q[1:height * 4 * ch], lambda x: CASE WHEN color = 3 THEN x >> (8 - depth) WHEN depth >= 8 THEN x * 257 ELSE (x >> (8 - depth)) * (65535 // ((1 << depth) - 1)) END) AS s FROM h),
    p AS (SELECT *, height * 4 AS px FROM s),
    r AS (SELECT *, CASE
        WHEN color = 3 THEN [257 * list_sum(s), 257 * list_sum(list_transform(s, lambda x: 255 - x)), 257 * list_sum(list_transform(s, lambda x: x // 2)), px * 65535]
        WHEN color = 0 THEN [list_sum(s), list_sum(s), list_sum(s), px * 65535]
        WHEN color = 4 THEN [list_sum(list_transform(range(0, px), lambda i: s[2 * i + 1])), list_sum(list_transform(range(0, px), lambda i: s[2 * i + 1])), list_sum(list_transform(range(0, px), lambda i: s[2 * i + 1])), list_sum(list_transform(range(0, px), lambda i: s[2 * i + 2]))]
        WHEN color = 2 THEN [list_sum(list_transform(range(0, px), lambda i: s[3 * i + 1])), list_sum(list_transform(range(0, px), lambda i: s[3 * i + 2])), list_sum(list_transform(range(0, px), lambda i: s[3 * i + 3])), px * 65535]
        ELSE [list_sum(list_transform(range(0, px), lambda i: s[4 * i + 1])), list_sum(list_transform(range(0, px), lambda i: s[4 * i + 2])), list_sum(list_transform(range(0, px), lambda i: s[4 * i + 3])), list_sum(list_transform(range(0, px), lambda i: s[4 * i + 4]))] END AS sums FROM p)
    SELECT vec_id, CAST(color AS INTEGER) AS color, CAST(depth AS INTEGER) AS depth, interlaced, CAST(height AS BIGINT) AS height, list_transform(sums, lambda x: CAST(x AS BIGINT)) AS sums, list_transform(sums, lambda x: CAST(x AS BIGINT)) AS rewritten,
      CAST(CASE WHEN NOT interlaced THEN height ELSE 2 * ((height + 7) // 8) - ((height + 7) // 8) + (height + 3) // 8 + (height + 3) // 4 + (height + 1) // 4 + (height + 1) // 2 + height // 2 END AS BIGINT) AS lines, [CAST(vec_id AS VARCHAR)] AS comments
    FROM r
    """
)
def png_every_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of every colour type and depth, interlaced or not, under all filters: decoded, rewritten and decoded again."""
    from .images import quantised

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), quantised().alias("samples"))
    sums = pa.list_(pa.int64())
    fields = [("vec_id", pa.int64()), ("color", pa.int32()), ("depth", pa.int32()), ("interlaced", pa.bool_()), ("height", pa.int64()), ("sums", sums), ("rewritten", sums), ("lines", pa.int64()), ("comments", pa.list_(pa.string()))]
    return map_arrow(rows, _kernel(_every_mode, fields), "vec_id long, color int, depth int, interlaced boolean, height long, sums array<bigint>, rewritten array<bigint>, lines long, comments array<string>")


def _loose(key: int, samples: list[int]):
    """An RGBA file whose pixels are stored, not compressed, in chunks of up to 40 bytes."""
    image = png.Image(np.array(samples, np.uint16).reshape(-1, 4, 4))
    whole = png.chunks(png.encode(image, png.Mode(6, 8), "0", lambda raw: zlib.compress(raw, 0)))
    stream = b"".join(c.data for c in whole if c.kind == b"IDAT")
    cut = [png.write_chunk(b"IDAT", stream[k : k + 40]) for k in range(0, len(stream), 40)]
    yield key, png.SIGNATURE + png.write_chunk(b"IHDR", whole[0].data) + b"".join(cut) + png.write_chunk(b"IEND", b"")


@query(
    """
    SELECT CAST(vec_id AS VARCHAR) AS path, CAST(s AS BIGINT) AS idat, CAST((s + 39) // 40 AS BIGINT) AS n_chunks, CAST(1 AS BIGINT) AS merged
    FROM (SELECT vec_id, len(embedding) // 16 * 17 + 11 AS s FROM embeddings)
    """
)
def png_idat_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compressed size of images in many chunks, and how many chunks are left when they are joined."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), coarse().alias("samples"))
    made = map_arrow(rows, _kernel(_loose, [("path", pa.int64()), ("content", pa.binary())]), "path long, content binary")
    joined = map_arrow(made, _kernel(lambda path, data: [(path, png.strip(data))], [("path", pa.int64()), ("content", pa.binary())]), "path long, content binary")
    merged = archives.png_idat_sizes(joined).select("path", F.col("n_chunks").alias("merged"))
    return archives.png_idat_sizes(made).join(merged, "path")


def _reduced(key: int, samples: list[int]):
    """A 16-bit RGBA file of the pixels, rewritten at level 1."""
    px = np.array(samples, np.uint16).reshape(-1, 4, 4)
    wide = png.Image(px.astype(np.uint32).astype(np.uint16) * np.uint16(257), True)
    data = png.encode(wide, png.Mode(6, 16))
    made = png.optimize(data, 1)
    h = png.header(made)
    back = png.decode(made).pixels // (257 if h.depth == 16 else 1)
    stats = png.color_statistics(png.Image(px))
    yield key, h.color, len(stats["colors"]), [int(v) for v in back.reshape(-1)], len(made) < len(data)


@query(
    f"""
    WITH {SQL_PIXELS}, s AS (
      SELECT vec_id, count(*) AS px, count(DISTINCT ((r * 256 + g) * 256 + b) * 256 + a) AS colors, bool_and(r = g AND g = b) AS gray, bool_and(a = 255) AS opaque, list([r, g, b, a] ORDER BY "at") AS p FROM pixels GROUP BY vec_id)
    SELECT vec_id, CAST(colors AS BIGINT) AS colors, list_transform(flatten(p), lambda x: CAST(x AS INTEGER)) AS pixels, true AS smaller FROM s
    """
)
def png_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images stored as 16-bit RGBA and reduced: depth, alpha and palette change, pixels do not."""
    fields = [("vec_id", pa.int64()), ("color", pa.int32()), ("colors", pa.int64()), ("pixels", pa.list_(pa.int32())), ("smaller", pa.bool_())]
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), coarse().alias("samples"))
    return map_arrow(rows, _kernel(_reduced, fields), "vec_id long, color int, colors long, pixels array<int>, smaller boolean").drop("color")


_STRATEGIES = (*png.STRATEGIES, "given", *png.BRUTE, *png.CHEAP, "palettes")


def _filtered(key: int, lines: list[list[int]]):
    """An image under every filter strategy, and rewritten with other palettes, decoded again."""
    px = np.array(lines, np.uint16).reshape(len(lines), -1, 4)
    image = png.Image(px, filters=[k % 5 for k in range(len(lines))])
    for name in _STRATEGIES:
        if name == "palettes":
            made = png.optimize(png.encode(image, png.Mode(6, 8)), 2, palette_sort=12)
        else:
            made = png.encode(image, png.Mode(6, 8), name)
        back = png.decode(made)
        yield key, name, ",".join(map(str, back.pixels.reshape(-1).tolist())), back.filters == image.filters if name == "given" else len(back.filters) == len(lines)


@query(
    f"""
    WITH q AS (SELECT vec_id, list_transform({_SQL_QUANTISED}, lambda x: x // 64 * 85) AS v FROM embeddings),
    c AS (SELECT vec_id, list_transform(v[1:len(v) // 4 * 4], lambda x, i: CASE WHEN i % 4 = 0 THEN CASE WHEN x > 85 THEN 255 ELSE 0 END ELSE x END) AS v FROM q),
    i AS (SELECT CAST(vec_id // 16 AS BIGINT) AS image, md5(array_to_string(flatten(list(v ORDER BY vec_id)), ',')) AS digest FROM c GROUP BY image)
    SELECT image, strategy, digest, true AS filters FROM i, (SELECT unnest([{", ".join(f"'{s}'" for s in _STRATEGIES)}]) AS strategy)
    """
)
def png_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of up to sixteen lines under every filter strategy, decoded again."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("cast(vec_id div 16 AS BIGINT)").alias("image"), F.struct("vec_id", coarse().alias("v")).alias("line"))
    images = rows.groupBy("image").agg(F.sort_array(F.collect_list("line")).alias("lines")).select("image", "lines.v")
    fields = [("image", pa.int64()), ("strategy", pa.string()), ("pixels", pa.string()), ("filters", pa.bool_())]
    return map_arrow(images, _kernel(_filtered, fields), "image long, strategy string, pixels string, filters boolean").select("image", "strategy", F.md5(F.col("pixels").cast("binary")).alias("digest"), "filters")


def _hidden(key: int, samples: list[int]):
    image = png.Image(np.array(samples, np.uint16).reshape(-1, 4, 4))
    for how in png.HIDDEN[:3]:
        yield key, how, [int(v) for v in png.clean_alpha(image, how).pixels.reshape(-1)]


@query(
    f"""
    WITH {SQL_PIXELS}, f AS (SELECT *, [r, g, b] AS c, last_value(CASE WHEN a > 0 THEN [r, g, b] END IGNORE NULLS) OVER (PARTITION BY vec_id, y ORDER BY x) AS l, last_value(CASE WHEN a > 0 THEN [r, g, b] END IGNORE NULLS) OVER (PARTITION BY vec_id, x ORDER BY y) AS u FROM pixels),
    e AS (SELECT vec_id, "at", how, a, CASE WHEN a > 0 THEN c WHEN how = 'black' THEN [0, 0, 0] WHEN how = 'sub' THEN coalesce(l, [0, 0, 0]) ELSE coalesce(u, [0, 0, 0]) END AS c FROM f, (VALUES ('black'), ('sub'), ('up')) h(how))
    SELECT vec_id, how, list_transform(flatten(list(list_append(c, a) ORDER BY "at")), lambda x: CAST(x AS INTEGER)) AS pixels FROM e GROUP BY vec_id, how
    """
)
def hidden_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear pixels made black, or filled from the left or from above."""
    fields = [("vec_id", pa.int64()), ("how", pa.string()), ("pixels", pa.list_(pa.int32()))]
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), coarse().alias("samples"))
    return map_arrow(rows, _kernel(_hidden, fields), "vec_id long, how string, pixels array<int>")


_SQL_PALETTE = "k AS (SELECT DISTINCT vec_id, r, g, b, a FROM pixels), i AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN a < 255 THEN 0 ELSE 1 END, r * 65536 + g * 256 + b, r, g, b, a) - 1 AS idx FROM k)"


@query(
    f"""
    WITH {SQL_PIXELS}, {_SQL_PALETTE}
    SELECT vec_id, list(CAST(idx AS BIGINT) ORDER BY "at") AS indexes, CAST(max(idx) + 1 AS BIGINT) AS used FROM pixels JOIN i USING (vec_id, r, g, b, a) GROUP BY vec_id
    """
)
def palette_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels as indexes into their image's palette, looked up and turned back, and how many entries are used."""
    px = pixels(spark, sf_dir)
    palette = colors.palette_rows(colors.color_counts(px, ["vec_id"]), ["vec_id"], C.rgb_key(F.col("r"), F.col("g"), F.col("b")))
    found = colors.indexed(px, palette, ["vec_id"])
    return found.groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "idx"))), lambda p: p["idx"].cast("long")).alias("indexes"), (F.max("idx") + 1).cast("long").alias("used"))


def _chained(image: int, entries: list[dict]):
    palette = tuple(tuple(e[c] for c in "rgba") for e in entries)
    order = png.nearest_palette(palette)
    yield image, " ".join("/".join(map(str, c)) for c in order)


@query(
    """
    WITH RECURSIVE c AS (SELECT DISTINCT p_size % 8 AS image, p_partkey * 37 % 256 // 32 * 32 AS r, p_partkey * 11 % 256 // 64 * 64 AS g, p_size * 5 % 256 AS b, 255 AS a FROM part),
    s AS (SELECT image, list([r, g, b, a] ORDER BY r, g, b, a) AS p FROM c GROUP BY image),
    w AS (SELECT image, [p[1]] AS done, p[2:] AS todo FROM s
      UNION ALL SELECT image, list_append(done, todo[n]), list_concat(todo[1:n - 1], todo[n + 1:]) FROM (
        SELECT *, list_position(list_transform(todo, lambda x: (x[1] - done[-1][1]) ** 2 + (x[2] - done[-1][2]) ** 2 + (x[3] - done[-1][3]) ** 2), list_min(list_transform(todo, lambda x: (x[1] - done[-1][1]) ** 2 + (x[2] - done[-1][2]) ** 2 + (x[3] - done[-1][3]) ** 2))) AS n
        FROM w WHERE len(todo) > 0))
    SELECT CAST(image AS BIGINT) AS image, array_to_string(list_transform(done, lambda x: array_to_string(x, '/')), ' ') AS palette FROM w WHERE len(todo) = 0
    """
)
def nearest_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes as chains from each colour to the nearest that is left."""
    p = table(spark, sf_dir, "part")
    level = lambda c, n: (F.floor(c / n) * n).cast("int")
    entries = p.select((F.col("p_size") % 8).cast("long").alias("image"), level(F.col("p_partkey") * 37 % 256, 32).alias("r"), level(F.col("p_partkey") * 11 % 256, 64).alias("g"), (F.col("p_size") * 5 % 256).cast("int").alias("b"), F.lit(255).alias("a")).distinct()
    images = entries.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("r", "g", "b", "a"))).alias("entries"))
    fields = [("image", pa.int64()), ("palette", pa.string())]
    return map_arrow(images, _kernel(_chained, fields), "image long, palette string")


def _priorities() -> dict[str, Column]:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return {"popularity": F.col("n"), "rgb": C.rgb_key(r, g, b), "yuv": r * 299 + g * 587 + b * 114, "msb": C.msb_key(r, g, b)}


def _sql_grid() -> str:
    parts = []
    msb = " + ".join(f"(((({c} >> {bit}) & 1)) << {3 * bit + 2 - k})" for bit in range(8) for k, c in enumerate(("r", "g", "b")))
    keys = {"popularity": "n", "rgb": "r * 65536 + g * 256 + b", "yuv": "r * 299 + g * 587 + b * 114", "msb": msb}
    clear = {"ignore": "0", "first": "CASE WHEN a < 255 THEN 0 ELSE 1 END", "last": "CASE WHEN a < 255 THEN 1 ELSE 0 END"}
    for name, key in keys.items():
        for place, first in clear.items():
            for way in ("ASC", "DESC"):
                parts.append(f"SELECT image, '{name}' AS priority, '{place}' AS transparency, '{way}' AS direction, r, g, b, a, row_number() OVER (PARTITION BY image ORDER BY {first}, {key} {way}, r {way}, g {way}, b {way}, a {way}) - 1 AS idx FROM k")
    colors_ = "c AS (SELECT CAST(p_size % 8 AS BIGINT) AS image, CAST(p_partkey * 37 % 256 AS BIGINT) AS r, CAST(p_partkey * 11 % 256 AS BIGINT) AS g, CAST(p_size * 5 % 256 AS BIGINT) AS b, CAST(CASE WHEN p_partkey % 9 = 0 THEN 128 ELSE 255 END AS BIGINT) AS a FROM part), k AS (SELECT *, count(*) AS n FROM c GROUP BY ALL)"
    return f"WITH {colors_} " + " UNION ALL ".join(parts)


@query(_sql_grid())
def palette_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted palettes of each image: by four keys, with clear entries first, last or in place, both ways."""
    counts = colors.color_counts(part_colors(spark, sf_dir).select(*[F.col(c).cast("long").alias(c) for c in ("image", "r", "g", "b", "a")]), ["image"])
    clear = {"ignore": F.lit(0), "first": F.when(F.col("a") < 255, 0).otherwise(1), "last": F.when(F.col("a") < 255, 1).otherwise(0)}
    places, ranked = [], counts
    for name, key in _priorities().items():
        for place, first in clear.items():
            for way in ("ASC", "DESC"):
                order = [x.asc() if way == "ASC" else x.desc() for x in (key, F.col("r"), F.col("g"), F.col("b"), F.col("a"))]
                column = f"_{len(places)}"
                ranked = ranked.withColumn(column, (F.row_number().over(W.partitionBy("image").orderBy(first, *order)) - 1).cast("long"))
                places.append(F.struct(F.lit(name).alias("priority"), F.lit(place).alias("transparency"), F.lit(way).alias("direction"), F.col(column).alias("idx")))
    every = ranked.withColumn("_o", F.explode(F.array(*places)))
    return every.select("image", "_o.priority", "_o.transparency", "_o.direction", "r", "g", "b", "a", "_o.idx")


def _broken(key: int, samples: list[int]):
    """A sound image and six ways to break it, with the reason a decoder gives."""
    image = png.Image(np.array(samples, np.uint16).reshape(-1, 4, 4))
    data = png.encode(image, png.Mode(6, 8))
    at = data.index(b"IDAT")
    cases = {
        0: data,
        1: b"x" + data[1:],
        2: data[: at + 6],
        3: data[:20] + b"\xff" + data[21:],
        4: data[: at + 5] + bytes([data[at + 5] ^ 1]) + data[at + 6 :],
        5: data[:33] + png.write_chunk(b"IDAT", zlib.compress(b"\0" * 3)) + png.write_chunk(b"IEND", b""),
        6: data[:8] + png.write_chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 3, 2, 0, 0, 0)) + data[33:],
    }
    try:
        png.decode(cases[key % 7])
        reason = None
    except png.PngError as e:
        reason = e.code
    made = png.Image(image.pixels, extra=[(1, png.Chunk(b"acTL", b"\0" * 8))] if key % 2 else [(1, png.Chunk(b"tIME", b"\0" * 7)), (2, png.Chunk(b"zTXt", b"k\0\0" + zlib.compress(b"note " * 9, 1)))])
    kept = png.optimize(png.encode(made, png.Mode(6, 8)), 1)
    left = {c.kind for c in png.chunks(png.strip(kept))}
    yield key, reason, [t.text for t in png.texts(kept)], b"acTL" in left, bool(left & {b"tIME", b"zTXt"})


@query(
    """
    SELECT vec_id, [NULL, 'signature', 'truncated', 'header crc', 'chunk crc', 'data size', 'colour mode'][vec_id % 7 + 1] AS reason,
      CASE WHEN vec_id % 2 = 1 THEN [] ELSE [repeat('note ', 9)] END AS texts, vec_id % 2 = 1 AS animated, false AS described FROM embeddings
    """
)
def png_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why broken images do not decode; that texts survive a rewrite, animations are left alone, and what a strip drops."""
    fields = [("vec_id", pa.int64()), ("reason", pa.string()), ("texts", pa.list_(pa.string())), ("animated", pa.bool_()), ("described", pa.bool_())]
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), coarse().alias("samples"))
    return map_arrow(rows, _kernel(_broken, fields), "vec_id long, reason string, texts array<string>, animated boolean, described boolean")


def _jpeg_of(samples: list[int], key: int) -> jpeg.Jpeg:
    """Coefficients from -64 to 63 in a gray image of 8 by 8 pixels per 64 samples, side by side; every fourth has colour."""
    values = np.array(samples, np.int32) // 2 - 64
    blocks = values[: len(values) // 64 * 64].reshape(1, -1, 64)
    count = 3 if key % 4 == 0 else 1
    parts = [jpeg.Component(k + 1, 1, 1, 0, blocks=blocks.copy() if k == 0 else blocks[:, ::-1].copy()) for k in range(count)]
    segments = [(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), (0xFE, b"comment"), (0xE1, b"Exif\0\0II*\0\x08\0\0\0\1\0\x12\1\3\0\1\0\0\0" + bytes([key % 8 + 1]) + b"\0\0\0\0\0\0\0")]
    image = jpeg.Jpeg(8 * blocks.shape[1], 8, {0: tuple(range(1, 65))}, parts, segments)
    image.lay_out()
    return image


def _recoded(key: int, samples: list[int]):
    image = _jpeg_of(samples, key)
    for form in (False, True):
        first = jpeg.write(image, not form)
        made, status = jpeg.optimize(first, 3, progressive=form, strip=key % 2 == 1)
        back = jpeg.read(made)
        yield key, form, len(back.components), [int(v) for v in back.components[0].blocks.reshape(-1)], len(back.segments), len(made) <= len(first)


@query(
    f"""
    WITH v AS (SELECT vec_id, list_transform({_SQL_QUANTISED}, lambda x: CAST(x // 2 - 64 AS INTEGER)) AS q FROM embeddings)
    SELECT vec_id, progressive, CAST(CASE WHEN vec_id % 4 = 0 THEN 3 ELSE 1 END AS BIGINT) AS components, q[1:len(q) // 64 * 64] AS coefficients, CAST(CASE WHEN vec_id % 2 = 1 THEN 1 ELSE 3 END AS BIGINT) AS segments, true AS smaller
    FROM v, (VALUES (false), (true)) p(progressive)
    """
)
def jpeg_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients written as a JPEG file in one form, optimised in the other, with and without metadata, and read back."""
    from .images import quantised

    fields = [("vec_id", pa.int64()), ("progressive", pa.bool_()), ("components", pa.int64()), ("coefficients", pa.list_(pa.int32())), ("segments", pa.int64()), ("smaller", pa.bool_())]
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), quantised().alias("samples"))
    return map_arrow(rows, _kernel(_recoded, fields), "vec_id long, progressive boolean, components long, coefficients array<int>, segments long, smaller boolean")


def _turned(key: int, samples: list[int]):
    image = _jpeg_of(samples[:64], key)
    made, status = jpeg.optimize(jpeg.write(image), 3, strip=True, autorotate=2)
    back = jpeg.read(made)
    natural = back.components[0].blocks[0, 0][jpeg.NATURAL]
    yield key, containers.exif_orientation(jpeg.write(image)), [int(v) for v in natural], "turned" if status == "turned" else "as it was", containers.exif_orientation(made)


@query(
    f"""
    WITH z AS (SELECT list(CAST(8 * v + u AS BIGINT) ORDER BY v + u, CASE WHEN (v + u) % 2 = 1 THEN v ELSE u END) AS zig FROM (SELECT unnest(range(0, 8)) AS v), (SELECT unnest(range(0, 8)) AS u)),
    q AS (SELECT vec_id, CAST(vec_id % 8 + 1 AS INTEGER) AS o, list_transform({_SQL_QUANTISED}, lambda x: x // 2 - 64)[1:64] AS s FROM embeddings),
    n AS (SELECT vec_id, o, list_transform(range(0, 64), lambda k: s[list_position(zig, k)]) AS m FROM q, z)
    SELECT vec_id, o AS orientation, list_transform(range(0, 64), lambda k: CAST(m[CASE WHEN o >= 5 THEN k % 8 * 8 + k // 8 ELSE k END + 1] * CASE WHEN o IN (2, 3, 6, 7) AND k % 2 = 1 THEN -1 ELSE 1 END * CASE WHEN o IN (3, 4, 7, 8) AND k // 8 % 2 = 1 THEN -1 ELSE 1 END AS INTEGER)) AS coefficients,
      CASE WHEN o = 1 THEN 'as it was' ELSE 'turned' END AS status, 0 AS left_over FROM n
    """
)
def jpeg_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JPEG files turned as their orientation asks, in the coefficients alone."""
    from .images import quantised

    fields = [("vec_id", pa.int64()), ("orientation", pa.int32()), ("coefficients", pa.list_(pa.int32())), ("status", pa.string()), ("left_over", pa.int32())]
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), quantised().alias("samples"))
    return map_arrow(rows, _kernel(_turned, fields), "vec_id long, orientation int, coefficients array<int>, status string, left_over int")
