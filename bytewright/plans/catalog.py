"""Queries over byte statistics, scanlines, codes, containers and names, with their SQL.

A text, a page or a turn stands for a file; an embedding, quantised to bytes, for a scanline or sixteen pixels.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import containers
from ..functions import columns as C
from ..operators import colors, recompress, scanlines, statistics
from ..runtime import map_arrow
from ..sources import archives
from .images import SQL_PIXELS, coarse, part_colors, pixels, quantised
from .registry import ORACLE_SQL, QUERIES, query, table

_SQL_BYTES = "unnest(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)))"


# Savings


@query()
def savings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Savings per language if every text were stored as its best DEFLATE candidate."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws(":", "lang", F.col("doc_id").cast("string")).alias("key"), "text")
    best = recompress.smallest(recompress.deflate_candidates(docs, "key", "text"), ["key"])
    return recompress.savings(best.withColumn("lang", F.substring_index("key", ":", 1)), ["lang"])


@query(
    """
    SELECT lang, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes,
      CAST(sum(octet_length(encode(text)) - length(text)) AS BIGINT) AS saved,
      round(100.0::DOUBLE * CAST(sum(octet_length(encode(text)) - length(text)) AS BIGINT) / CAST(sum(octet_length(encode(text))) AS BIGINT), 4) AS pct, '' AS note
    FROM documents GROUP BY lang
    """
)
def savings_of_single_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report for a candidate of known size: one byte per character."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("lang", F.octet_length("text").cast("long").alias("before"), F.length("text").cast("long").alias("after"))
    return recompress.savings(sized, ["lang"])


@query()
def gzip_best_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest of twelve gzip candidates per text, stored if none is smaller."""
    found = recompress.deflate_candidates(table(spark, sf_dir, "documents"), "doc_id", "text", (1, 6, 9), ("default", "filtered", "rle", "huffman"))
    return recompress.smallest(found, ["key"])


# Byte statistics


@query(f"SELECT lang AS key, byte, count(*) AS n FROM (SELECT lang, {_SQL_BYTES} AS byte FROM documents) GROUP BY ALL")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = statistics.byte_counts(table(spark, sf_dir, "documents"), "lang", "text")
    return counts.groupBy("key", "byte").agg(F.sum("n").alias("n"))


@query(
    f"""
    SELECT key, CAST(sum(n) AS BIGINT) AS total, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS entropy
    FROM (SELECT key, byte, count(*) AS n FROM (SELECT CAST(doc_id AS VARCHAR) AS key, {_SQL_BYTES} AS byte FROM documents) GROUP BY ALL) GROUP BY key
    """
)
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = statistics.byte_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return statistics.entropy(counts).withColumn("entropy", F.round("entropy", 4))


@query(
    f"""
    WITH b AS (SELECT doc_id, list(byte ORDER BY i) AS l FROM (
      SELECT doc_id, {_SQL_BYTES} AS byte, generate_subscripts(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), 1) AS i FROM documents) GROUP BY doc_id)
    SELECT CAST(doc_id AS VARCHAR) AS key, CAST(len(list_distinct(l)) AS BIGINT) AS bytes,
      CAST(len(list_distinct(list_transform(range(1, len(l)), lambda i: l[i] * 256 + l[i + 1]))) AS BIGINT) AS bigrams
    FROM b
    """
)
def distinct_bytes_and_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.distinct_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.where("bytes > 0")


@query(
    f"""
    WITH b AS (SELECT doc_id, {_SQL_BYTES} AS byte, generate_subscripts(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), 1) AS i FROM documents),
    g AS (SELECT doc_id, byte, i - row_number() OVER (PARTITION BY doc_id, byte ORDER BY i) AS island FROM b),
    r AS (SELECT doc_id, byte, island, count(*) AS length FROM g GROUP BY ALL)
    SELECT length, count(*) AS n FROM r GROUP BY length
    """
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.run_counts(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("length").agg(F.sum("n").alias("n"))


@query(
    f"""
    SELECT key, byte, n, round(least(15.0, log2(sum(n) OVER (PARTITION BY key)) - log2(n)), 6) AS bits
    FROM (SELECT lang AS key, byte, count(*) AS n FROM (SELECT lang, {_SQL_BYTES} AS byte FROM documents) GROUP BY ALL)
    """
)
def symbol_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.symbol_costs(byte_histogram(spark, sf_dir), ["key"]).withColumn("bits", F.round("bits", 6))


@query(f"SELECT key, CAST(sum(CASE WHEN byte < 144 THEN 8 ELSE 9 END) + 10 AS BIGINT) AS bits FROM (SELECT CAST(doc_id AS VARCHAR) AS key, {_SQL_BYTES} AS byte FROM documents) GROUP BY key")
def fixed_block_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.fixed_literal_bits(statistics.byte_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "key")


@query(
    f"""
    WITH h AS (SELECT odd, byte, count(*) AS n FROM (SELECT doc_id % 2 AS odd, {_SQL_BYTES} AS byte FROM documents) GROUP BY ALL),
    a AS (SELECT byte, n FROM h WHERE odd = 0), b AS (SELECT byte, n FROM h WHERE odd = 1)
    SELECT byte, 0.75::DOUBLE * coalesce(a.n, 0) + 0.25::DOUBLE * coalesce(b.n, 0) AS n FROM a FULL JOIN b USING (byte)
    """
)
def blended_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte histogram of even documents, a quarter of the way towards that of odd ones."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("odd"), "text")
    counts = statistics.byte_counts(docs, "odd", "text").groupBy("key", "byte").agg(F.sum("n").alias("n"))
    part = lambda odd: counts.where(F.col("key") == odd).select("byte", "n")
    return statistics.blend(part("0"), part("1"), ["byte"], 0.25)


@query(
    f"""
    WITH b AS (SELECT doc_id, {_SQL_BYTES} AS byte, generate_subscripts(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), 1) AS i FROM documents),
    s AS (SELECT doc_id, count(*) AS size, sum(byte) AS plain, sum(byte * i) AS placed FROM b GROUP BY doc_id)
    SELECT CAST(doc_id AS VARCHAR) AS key, size, CAST((size + (size + 1) * plain - placed) % 65521 * 65536 + (1 + plain) % 65521 AS BIGINT) AS adler32 FROM s
    """
)
def adler32_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.checksums(table(spark, sf_dir, "documents"), "doc_id", "text").select("key", "size", "adler32")


@query(
    """
    WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
    t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_concat([n], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)
    SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, x: xor(crc[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8)), 4294967295::BIGINT) AS crc32 FROM b, t
    """
)
def crc32_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(statistics.as_bytes("text")).alias("crc32"))


# Scanlines


_SQL_LINES = """
lines AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(least(greatest(floor((x::DOUBLE + 1) * 127.5), 0), 255) AS BIGINT)) AS v FROM embeddings),
pairs AS (SELECT label, vec_id, v, coalesce(lag(v) OVER (PARTITION BY label, vec_id // 64 ORDER BY vec_id), list_transform(v, lambda x: 0)) AS u FROM lines),
sides AS (SELECT label, vec_id, v, u, list_transform(range(1, len(v) + 1), lambda i: CASE WHEN i > 4 THEN v[i - 4] ELSE 0 END) AS l,
  list_transform(range(1, len(v) + 1), lambda i: CASE WHEN i > 4 THEN u[i - 4] ELSE 0 END) AS c FROM pairs),
filtered AS (
  SELECT label, vec_id, 0 AS filter, v AS f FROM sides
  UNION ALL SELECT label, vec_id, 1, list_transform(range(1, len(v) + 1), lambda i: (v[i] - l[i] + 256) % 256) FROM sides
  UNION ALL SELECT label, vec_id, 2, list_transform(range(1, len(v) + 1), lambda i: (v[i] - u[i] + 256) % 256) FROM sides
  UNION ALL SELECT label, vec_id, 3, list_transform(range(1, len(v) + 1), lambda i: (v[i] - (l[i] + u[i]) // 2 + 256) % 256) FROM sides
  UNION ALL SELECT label, vec_id, 4, list_transform(range(1, len(v) + 1), lambda i: (v[i] - CASE
      WHEN abs(u[i] - c[i]) <= abs(l[i] - c[i]) AND abs(u[i] - c[i]) <= abs(l[i] + u[i] - 2 * c[i]) THEN l[i]
      WHEN abs(l[i] - c[i]) <= abs(l[i] + u[i] - 2 * c[i]) THEN u[i] ELSE c[i] END + 256) % 256) FROM sides)
"""
_SQL_SCORES = {
    "minsum": "CAST(list_sum(list_transform(f, lambda x: CASE WHEN filter = 0 OR x < 128 THEN x ELSE 255 - x END)) AS BIGINT)",
    "distinct_bytes": "CAST(len(list_distinct(list_append(f, filter))) AS BIGINT)",
    "distinct_bigrams": "CAST(len(list_distinct(list_transform(range(1, len(f) + 1), lambda i: CASE WHEN i = 1 THEN filter ELSE f[i - 1] END * 256 + f[i]))) AS BIGINT)",
    "entropy": "round(list_sum(list_transform(list_distinct(list_append(f, filter)), lambda x: -(len(list_filter(list_append(f, filter), lambda y: y = x)) / (len(f) + 1.0::DOUBLE)) * log2(len(list_filter(list_append(f, filter), lambda y: y = x)) / (len(f) + 1.0::DOUBLE)))), 9)",
}


def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of images of at most 64 lines: those of a label whose ids follow each other."""
    return table(spark, sf_dir, "embeddings").select("label", F.expr("vec_id div 64").alias("image"), "vec_id", quantised().alias("line"))


IMAGE = ["label", "image"]


@query(f"WITH {_SQL_LINES} SELECT label, vec_id, CAST(filter AS INTEGER) AS filter, {_SQL_SCORES['minsum']} AS score FROM filtered")
def filter_minsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five filters of every line with their minimum sums."""
    return scanlines.filter_scores(scan_lines(spark, sf_dir), IMAGE, "vec_id", "line", 4, "minsum").drop("image")


def _best(measure: str) -> None:
    score = _SQL_SCORES[measure]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scores = scanlines.filter_scores(scan_lines(spark, sf_dir), IMAGE, "vec_id", "line", 4, measure)
        scores = scores.withColumn("score", F.round("score", 9)) if measure == "entropy" else scores
        return scanlines.best_filter(scores, IMAGE, "vec_id").drop("image")

    run.__name__ = f"best_filter_{measure}"
    query(
        f"""
        WITH {_SQL_LINES}, scored AS (SELECT label, vec_id, filter, {score} AS score FROM filtered)
        SELECT label, vec_id, CAST(filter AS INTEGER) AS filter, score FROM scored
        QUALIFY row_number() OVER (PARTITION BY label, vec_id ORDER BY score, filter) = 1
        """
    )(run)


for _measure in scanlines.MEASURES:
    _best(_measure)


@query(f"WITH {_SQL_LINES} SELECT concat_ws(chr(1), CAST(label AS VARCHAR), CAST(vec_id // 64 AS VARCHAR)) AS key, vec_id AS y, list_transform(v, lambda x: CAST(x AS INTEGER)) AS line FROM lines")
def unfilter_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line under its best filter, undone again."""
    lines = scan_lines(spark, sf_dir)
    best = scanlines.best_filter(scanlines.filter_scores(lines, IMAGE, "vec_id", "line", 4, "minsum"), IMAGE, "vec_id")
    both = scanlines.with_above(lines, IMAGE, "vec_id", "line").join(best, [*IMAGE, "vec_id"])
    coded = F.when(F.col("filter") == 0, scanlines.filtered(0, F.col("line"), F.col("above"), 4))
    for k in range(1, 5):
        coded = coded.when(F.col("filter") == k, scanlines.filtered(k, F.col("line"), F.col("above"), 4))
    return scanlines.unfiltered(both.select(*IMAGE, "vec_id", "filter", coded.alias("line")), IMAGE, "vec_id", "filter", "line", 4)


# Symbols and codes


# Fixed values in the SQL: the least length and distance of each symbol of RFC 1951.
@query(
    """
    WITH bases AS (SELECT [3,4,5,6,7,8,9,10,11,13,15,17,19,23,27,31,35,43,51,59,67,83,99,115,131,163,195,227,258] AS b),
    n AS (SELECT 3 + event_id % 256 AS length FROM events)
    SELECT CAST(256 + len(list_filter(b, lambda x: x <= length)) AS INTEGER) AS symbol,
      CAST(CASE WHEN length = 258 OR length < 11 THEN 0 ELSE (len(list_filter(b, lambda x: x <= length)) - 5) // 4 END AS INTEGER) AS extra, count(*) AS n, CAST(min(length) AS BIGINT) AS least, CAST(max(length) AS BIGINT) AS most
    FROM n, bases GROUP BY ALL
    """
)
def deflate_length_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of match lengths taken from events."""
    length = (F.col("event_id") % 256 + 3).cast("long")
    rows = table(spark, sf_dir, "events").select(length.alias("length"))
    return rows.groupBy(C.length_symbol(F.col("length")).alias("symbol"), C.length_extra_bits(F.col("length")).alias("extra")).agg(F.count("*").alias("n"), F.min("length").alias("least"), F.max("length").alias("most"))


@query(
    """
    WITH bases AS (SELECT [1,2,3,4,5,7,9,13,17,25,33,49,65,97,129,193,257,385,513,769,1025,1537,2049,3073,4097,6145,8193,12289,16385,24577] AS b),
    n AS (SELECT 1 + event_id * 7919 % 32768 AS distance FROM events)
    SELECT CAST(len(list_filter(b, lambda x: x <= distance)) - 1 AS INTEGER) AS symbol,
      CAST(greatest((len(list_filter(b, lambda x: x <= distance)) - 3) // 2, 0) AS INTEGER) AS extra, count(*) AS n, CAST(min(distance) AS BIGINT) AS least, CAST(max(distance) AS BIGINT) AS most
    FROM n, bases GROUP BY ALL
    """
)
def deflate_distance_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of match distances taken from events."""
    distance = (F.col("event_id") * 7919 % 32768 + 1).cast("long")
    rows = table(spark, sf_dir, "events").select(distance.alias("distance"))
    return rows.groupBy(C.distance_symbol(F.col("distance")).alias("symbol"), C.distance_extra_bits(F.col("distance")).alias("extra")).agg(F.count("*").alias("n"), F.min("distance").alias("least"), F.max("distance").alias("most"))


@query(
    f"""
    SELECT lang AS grp, count(DISTINCT byte) AS symbols, true AS complete, true AS near_entropy FROM (SELECT lang, {_SQL_BYTES} AS byte FROM documents) GROUP BY lang
    """
)
def huffman_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimal codes of each language's bytes: a full tree, within one bit a symbol of the entropy."""
    codes = recompress.huffman_codes(byte_histogram(spark, sf_dir), "key", "byte", "n")
    sums = codes.groupBy("grp").agg(F.count("*").alias("symbols"), F.sum(F.pow(F.lit(2.0), -F.col("length"))).alias("kraft"), F.sum(F.col("n") * F.col("length")).alias("bits"), F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("w"))
    ideal = F.col("n") * F.log2("n") - F.col("w")
    return sums.select("grp", "symbols", (F.abs(F.col("kraft") - 1) < 1e-9).alias("complete"), ((F.col("bits") >= ideal - 1) & (F.col("bits") <= ideal + F.col("n"))).alias("near_entropy"))


@query("SELECT conv_id || ':' || turn AS key, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes, true AS covered FROM conversations")
def deflate_block_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse, split and price every turn; the blocks cover its bytes."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text")
    plan = recompress.block_plan(turns, "key", "text", level=2)
    return plan.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.every((F.col("tokens") == F.col("literals") + F.col("matches")) & (F.least("fixed_bits", "dynamic_bits") > 0)).alias("covered"))


# Containers


def _gzipped(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [containers.gzip_encode(d, level, f"{k}.txt") if k % 2 else gzip.compress(d, mtime=7) for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    return run


def gzip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a gzip file; odd ids by this package's encoder, with a name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", statistics.as_bytes("text").alias("data"))
    return map_arrow(docs, _gzipped(1), "path string, content binary")


@query(
    """
    SELECT CAST(doc_id AS VARCHAR) AS path, 'gzip' AS gzip_class, CAST(CASE WHEN doc_id % 2 = 1 THEN 8 ELSE 0 END AS BIGINT) AS flags,
      CAST(CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 7 END AS BIGINT) AS mtime, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS isize FROM documents
    """
)
def gzip_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and trailer fields by column expressions."""
    files = gzip_files(spark, sf_dir)
    fields = C.gzip_fields(F.col("content"))
    return files.select("path", C.gzip_class(F.col("content")).alias("gzip_class"), fields.alias("g")).select("path", "gzip_class", "g.flags", "g.mtime", "g.isize")


@query(
    """
    SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 2 = 1 THEN doc_id || '.txt' END AS name, CAST(1 AS INTEGER) AS members,
      md5(coalesce(text, '')) AS digest, NULL::VARCHAR AS error FROM documents
    """
)
def gzip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archives.gzip_contents(gzip_files(spark, sf_dir))
    return back.select("path", "name", "members", F.md5("content").alias("digest"), "error")


@query("SELECT CAST(page_id // 1000 AS VARCHAR) AS archive, 'page/' || page_id || '.html' AS name, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size, true AS intact, NULL::VARCHAR AS error FROM pages")
def zip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages packed into archives of at most a thousand and read back entry by entry."""
    pages = table(spark, sf_dir, "pages").select(F.expr("cast(page_id div 1000 AS string)").alias("archive"), F.concat(F.lit("page/"), "page_id", F.lit(".html")).alias("name"), statistics.as_bytes("html").alias("content"))
    made = archives.build_zips(pages, "archive", "name", "content", level=1)
    return archives.zip_entries(made, "archive", "zip").select("archive", "name", "size", "intact", "error")


# Images


@query(
    f"""
    WITH {SQL_PIXELS}, s AS (
      SELECT vec_id, count(*) AS pixels, least(257, count(DISTINCT CASE WHEN a = 0 THEN 0 ELSE ((r * 256 + g) * 256 + b) * 256 + a END)) AS colors,
        bool_and(r = g AND g = b) AS gray, bool_and(a = 255) AS opaque,
        max(CASE WHEN r = g AND g = b THEN CASE WHEN r % 255 = 0 THEN 1 WHEN r % 85 = 0 THEN 2 WHEN r % 17 = 0 THEN 4 ELSE 8 END ELSE 8 END) AS bits
      FROM pixels GROUP BY vec_id),
    d AS (SELECT *, CASE WHEN colors <= 2 THEN 1 WHEN colors <= 4 THEN 2 WHEN colors <= 16 THEN 4 ELSE 8 END AS depth,
      CASE WHEN gray THEN 8 ELSE 24 END + CASE WHEN opaque THEN 0 ELSE 8 END AS direct FROM s)
    SELECT vec_id, pixels, CAST(colors AS BIGINT) AS colors, gray, opaque, CAST(bits AS BIGINT) AS bits,
      CAST(CASE WHEN gray AND opaque AND (colors > 256 OR depth >= bits) THEN 0 WHEN colors <= 256 AND colors * 32 + pixels * depth < pixels * direct THEN 3
        WHEN gray AND NOT opaque THEN 4 WHEN gray THEN 0 WHEN opaque THEN 2 ELSE 6 END AS INTEGER) AS color_type
    FROM d
    """
)
def color_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour statistics of each image and the mode they lead to."""
    s = colors.color_summary(pixels(spark, sf_dir), ["vec_id"])
    kind, _ = colors.chosen_mode(*(F.col(c) for c in ("colors", "gray", "opaque", "bits", "pixels")))
    return s.withColumn("color_type", kind)


@query(
    f"""
    WITH {SQL_PIXELS}, i AS (SELECT vec_id, x, y, r // 85 AS idx FROM pixels),
    n AS (SELECT a.idx AS i, b.idx AS j FROM i a JOIN i b ON a.vec_id = b.vec_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)))
    SELECT least(i, j) AS i, greatest(i, j) AS j, count(*) AS n FROM n GROUP BY ALL
    """
)
def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two red levels stand beside each other in all images."""
    indexes = pixels(spark, sf_dir).withColumn("idx", F.expr("r div 85"))
    return colors.neighbour_pairs(indexes, ["vec_id"], "x", "y", "idx").groupBy("i", "j").agg(F.sum("n").alias("n"))


_SQL_COLORS = "c AS (SELECT p_size % 8 AS image, p_partkey * 37 % 256 AS r, p_partkey * 11 % 256 AS g, p_size * 5 % 256 AS b, CASE WHEN p_partkey % 9 = 0 THEN 128 ELSE 255 END AS a FROM part), k AS (SELECT *, count(*) AS n FROM c GROUP BY ALL)"


def _ordered(name: str, key: Callable[[], Column], sql: str, descending: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = colors.color_counts(part_colors(spark, sf_dir), ["image"])
        return colors.palette_rows(counts, ["image"], key(), descending).select("image", "r", "g", "b", "a", "n", F.col("idx").cast("long"))

    run.__name__ = f"palette_by_{name}"
    query(f"WITH {_SQL_COLORS} SELECT image, r, g, CAST(b AS BIGINT) AS b, CAST(a AS BIGINT) AS a, n, row_number() OVER (PARTITION BY image ORDER BY CASE WHEN a < 255 THEN 0 ELSE 1 END, {sql} {'DESC' if descending else 'ASC'}, r, g, b, a) - 1 AS idx FROM k")(run)


_SQL_MSB = " + ".join(f"(((({c} >> {bit}) & 1)) << {3 * bit + 2 - k})" for bit in range(8) for k, c in enumerate(("CAST(r AS BIGINT)", "CAST(g AS BIGINT)", "CAST(b AS BIGINT)")))
_ordered("popularity", lambda: F.col("n"), "n", descending=True)
_ordered("rgb", lambda: C.rgb_key(F.col("r"), F.col("g"), F.col("b")), "r * 65536 + g * 256 + b")
_ordered("msb", lambda: C.msb_key(F.col("r"), F.col("g"), F.col("b")), _SQL_MSB)
_ordered("yuv", lambda: F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114, "r * 299 + g * 587 + b * 114")


@query("WITH u AS (SELECT DISTINCT p_size AS v FROM part) SELECT CAST(min(c.v) AS BIGINT) AS p_size FROM (SELECT 0 AS v UNION ALL SELECT v + 1 FROM u) c LEFT JOIN u USING (v) WHERE u.v IS NULL")
def least_unused_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.least_unused(table(spark, sf_dir, "part"), "p_size")


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(4).alias("width"), coarse().alias("samples"))
    return scanlines.encode_images(rows, "vec_id", "width", "samples")


@query(f"WITH {SQL_PIXELS} SELECT CAST(vec_id AS VARCHAR) AS key, count(DISTINCT ((r * 256 + g) * 256 + b) * 256 + a) AS colors, true AS intact FROM pixels GROUP BY vec_id")
def png_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image written as PNG, decoded and compared."""
    return image_files(spark, sf_dir).select("key", "colors", "intact")


@query("SELECT CAST(vec_id AS VARCHAR) AS path, CAST(4 AS BIGINT) AS width, CAST(len(embedding) // 16 AS BIGINT) AS height, true AS crc_ok, true AS valid FROM embeddings")
def png_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = image_files(spark, sf_dir).select(F.col("key").alias("path"), C.png_fields(F.col("png")).alias("h"))
    return files.select("path", "h.width", "h.height", "h.crc_ok", C.valid_png_mode(F.col("h.colortype"), F.col("h.bitdepth")).alias("valid"))


@query("SELECT CAST(vec_id AS VARCHAR) AS path, true AS framed, true AS checked, CAST(len(embedding) // 16 AS BIGINT) AS lines FROM embeddings")
def png_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every image: IHDR first, IEND last, checksums right; and its stored scanlines."""
    files = image_files(spark, sf_dir).select(F.col("key").alias("path"), F.col("png").alias("content"))
    frames = archives.png_frames(files)
    return frames.select("path", ((F.col("first") == "IHDR") & (F.col("last") == "IEND")).alias("framed"), "checked", "lines")


@query(
    """
    SELECT CASE WHEN x % 8 = 0 AND y % 8 = 0 THEN 1 WHEN y % 8 = 0 AND x % 4 = 0 THEN 2 WHEN y % 4 = 0 AND x % 4 = 0 THEN 3 WHEN y % 4 = 0 AND x % 2 = 0 THEN 4
      WHEN y % 2 = 0 AND x % 2 = 0 THEN 5 WHEN y % 2 = 0 THEN 6 ELSE 7 END::INTEGER AS pass, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
    FROM (SELECT event_id, event_id % 100 AS x, event_id // 100 AS y FROM events) GROUP BY pass
    """
)
def interlace_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the pixels of an image 100 wide: how many each interlace pass holds."""
    pixel = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 100).alias("x"), F.expr("event_id div 100").alias("y"))
    return pixel.groupBy(C.adam7_pass(F.col("x"), F.col("y")).alias("pass")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 10 BETWEEN 1 AND 8 THEN o_orderkey % 10 ELSE 0 END AS INTEGER) AS orientation FROM orders")
def exif_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JPEG headers that state an orientation, in either byte order, parsed again."""
    value = F.lpad(F.hex(F.col("o_orderkey") % 10), 2, "0")
    big = F.concat(F.lit("4D4D002A0000000800010112000300000001" + "00"), value, F.lit("000000000000"))
    little = F.concat(F.lit("49492A0008000000010012010300010000" + "00"), value, F.lit("00000000000000"))
    tiff = F.when(F.col("o_custkey") % 2 == 0, big).otherwise(little)
    size = F.lpad(F.hex(F.length(tiff) / 2 + 8), 4, "0")
    jpeg = F.unhex(F.concat(F.lit("FFD8FFE1"), size, F.lit("457869660000"), tiff, F.lit("FFDA0002FFD9")))
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), jpeg.alias("content"))
    return archives.jpeg_segments(files).where("idx = 0").select(F.col("path").cast("long").alias("o_orderkey"), "orientation")


# Names, times, ranges


@query("SELECT regexp_extract(url, '\\.([^./?#]*)$', 1) AS ext, count(*) AS n FROM pages GROUP BY ext")
def url_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(C.extension(F.col("url")).alias("ext")).agg(F.count("*").alias("n"))


@query(
    """
    SELECT o_orderkey, CAST((year(o_orderdate) - 1980) * 512 + month(o_orderdate) * 32 + day(o_orderdate) AS BIGINT) AS dos_date,
      CAST(hour(o_orderdate) * 2048 + minute(o_orderdate) * 32 + second(o_orderdate) // 2 AS BIGINT) AS dos_time FROM orders
    """
)
def dos_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", C.dos_date(F.col("o_orderdate")).alias("dos_date"), C.dos_time(F.col("o_orderdate")).alias("dos_time"))


@query(
    """
    SELECT * FROM (SELECT user_id, event_id, s AS start, s + event_id % 5000 AS "end", lag(s + event_id % 5000) OVER (PARTITION BY user_id ORDER BY s, s + event_id % 5000) AS previous_end
      FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)) WHERE previous_end > start
    """
)
def overlapping_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as byte ranges of their user: those that begin before the previous one ends."""
    start = F.unix_timestamp("ts")
    entries = table(spark, sf_dir, "events").select("user_id", "event_id", start.alias("start"), (start + F.col("event_id") % 5000).alias("end"))
    return statistics.overlaps(entries, "user_id", "start", "end")


@query(
    """
    WITH g AS (SELECT l_orderkey, l_returnflag, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS d FROM lineitem)
    SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first, count(*) AS length FROM g GROUP BY l_orderkey, l_returnflag, d
    """
)
def flag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal return flags along the lines of an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"))
    return statistics.islands(lines, ["l_orderkey"], "at", "l_returnflag").select("l_orderkey", "l_returnflag", F.col("first.l_linenumber").alias("first"), "length")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 1")
def names_not_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose name no archive of the first two regions holds, whatever the case."""
    n = table(spark, sf_dir, "nation")
    present = n.where("n_regionkey <= 1").select(F.lower("n_name").alias("n_name"))
    return statistics.absent_names(n.select("n_nationkey", "n_name"), present, "n_name")
