import datetime
import gzip
import os
import zlib

import duckdb
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from bytewright.codecs import containers, png
from bytewright.functions import columns as C
from bytewright.operators import recompress, scanlines, statistics
from bytewright.options import Options, parse_args
from bytewright.plans import catalog, catalog_codecs  # noqa: F401
from bytewright.plans.registry import ORACLE_SQL, QUERIES
from bytewright.sources import archives, files, sinks
from bytewright.streaming.watch import watch


def write_folder(top):
    px = np.zeros((12, 12, 4), np.uint16)
    px[:, :, 3] = 255
    px[:, :, 0] = np.arange(12)
    loose = png.encode(png.Image(px), png.Mode(6, 8), "0", lambda raw: zlib.compress(raw, 0))
    (top / "sub").mkdir(parents=True)
    for name, data in {"a.png": loose, "b.PNG": loose, "c.Png": loose, "d.gif": b"GIF89a", "e.png": b"broken", "sub/f.png": loose, "t.gz": gzip.compress(b"x" * 999, 1), "empty.png": b""}.items():
        (top / name).write_bytes(data)
    return loose


def test_scan_eligibility_and_optimisation(spark, tmp_path):
    loose = write_folder(tmp_path)
    flat = files.scan_files(spark, [str(tmp_path)])
    assert flat.count() == 6  # Spark lists no empty files
    deep = files.scan_files(spark, [str(tmp_path), str(tmp_path / "missing")], Options(recurse=True))
    assert deep.count() == 7
    assert files.existing(spark, [str(tmp_path / "missing")])[1] == 1
    assert files.scan_files(spark, [str(tmp_path / "a.png")] * 2).count() == 2
    ready = files.eligible(flat)
    assert {os.path.basename(r.path) for r in ready.collect()} == {"a.png", "b.PNG", "e.png"}
    done = recompress.optimize_files(ready.where("status = 'ready'")).collect()
    by = {os.path.basename(r.path): r for r in done}
    assert by["a.png"].status == "smaller" and by["a.png"].after < len(loose)
    assert png.same_image(png.decode(by["a.png"].content), png.decode(loose))
    assert by["e.png"].status.startswith("error")
    zipped = recompress.optimize_files(files.eligible(flat, Options(gzip=True)).where("status = 'ready'"), Options(gzip=True)).collect()
    assert {r.status for r in zipped} <= {"created", "smaller", "kept"}
    sniffed = {os.path.basename(r.path): r for r in files.sniff(flat).collect()}
    assert sniffed["t.gz"].gzip_class == "gzip" and sniffed["t.gz"].gzip.isize == 999
    assert sniffed["a.png"].png.width == 12 and sniffed["a.png"].png.crc_ok and sniffed["d.gif"].format == "unknown"


def test_plan_reads_no_content_for_sizes(spark, tmp_path):
    write_folder(tmp_path)
    plan = files.scan_files(spark, [str(tmp_path)]).where("length > 5").select("length")._jdf.queryExecution().toString()
    scan = [x for x in plan.splitlines() if "ReadSchema" in x][-1]
    assert "PushedFilters" in scan and "content" not in scan.split("ReadSchema")[1]


def test_sink_replaces_only_what_is_smaller(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"old old old")
    (tmp_path / "b").write_bytes(b"old")
    rows = spark.createDataFrame([(str(tmp_path / "a"), 11, 3, "smaller", b"new"), (str(tmp_path / "b"), 3, 9, "kept", b"new longer"), ("/no/such/dir/x", 9, 1, "smaller", b"n")], "path string, before long, after long, status string, content binary")
    out = {r.path: r for r in sinks.write_files(sinks.never_larger(rows)).collect()}
    assert (tmp_path / "a").read_bytes() == b"new" and (tmp_path / "b").read_bytes() == b"old"
    assert len(out) == 2 and not out["/no/such/dir/x"].written
    assert recompress.overall_status(rows).first().code == 0


def test_savings(spark):
    rows = spark.createDataFrame([("a", 100, 60), ("a", 50, 50), ("b", 10, 20)], "k string, before long, after long")
    out = {r.k: r for r in recompress.savings(rows, ["k"]).collect()}
    assert (out["a"].files, out["a"].saved, out["a"].pct) == (2, 40, round(4000 / 150, 4)) and out["b"].note == "result is bigger"
    assert recompress.savings(rows.where("false"), []).first().note == "no compatible files"


def test_statistics_edge_cases(spark):
    docs = spark.createDataFrame([(1, "aab"), (2, ""), (3, None), (3, "é")], "id long, text string")
    counts = sorted(map(tuple, statistics.byte_counts(docs, "id", "text").collect()))
    assert counts == [("1", 97, 2), ("1", 98, 1), ("3", 0xA9, 1), ("3", 0xC3, 1)]
    assert sorted(map(tuple, statistics.run_counts(docs, "id", "text").collect()))[:2] == [("1", 1, 1), ("1", 2, 1)]
    empty = docs.where("false")
    assert statistics.byte_counts(empty, "id", "text").count() == 0 and statistics.entropy(statistics.byte_counts(empty, "id", "text")).count() == 0
    assert statistics.checksums(docs, "id", "text").where("key = '2'").first().adler32 == 1
    assert statistics.least_unused(spark.createDataFrame([(0,), (1,), (3,)], "v long"), "v").first().v == 2
    assert statistics.least_unused(spark.createDataFrame([], "v long"), "v").first().v == 0


def test_filters_agree_with_the_codec(spark):
    r = np.random.default_rng(2)
    lines = r.integers(0, 256, (6, 16)).astype(np.uint8)
    rows = spark.createDataFrame([(0, y, [int(v) for v in line]) for y, line in enumerate(lines)], "img long, y long, line array<int>")
    for kind in range(5):
        got = scanlines.with_above(rows, ["img"], "y", "line").select("y", scanlines.filtered(kind, F.col("line"), F.col("above"), 4).alias("f")).orderBy("y").collect()
        for y, row in enumerate(got):
            want = png.filter_line(kind, lines[y], lines[y - 1] if y else np.zeros(16, np.uint8), 4)
            assert row.f == want.tolist()
    for measure in scanlines.MEASURES:
        best = scanlines.best_filter(scanlines.filter_scores(rows, ["img"], "y", "line", 4, measure).withColumn("score", F.round("score", 9)), ["img"], "y").orderBy("y").collect()
        for y, row in enumerate(best):
            options = [round(png.line_score(k, png.filter_line(k, lines[y], lines[y - 1] if y else np.zeros(16, np.uint8), 4), measure), 9) for k in range(5)]
            assert row.filter == options.index(min(options)), measure


def test_column_functions(spark):
    ts = spark.createDataFrame([(datetime.datetime(1979, 5, 1),), (datetime.datetime(2024, 2, 29, 13, 37, 59),), (datetime.datetime(2200, 1, 1),)], "t timestamp")
    assert [tuple(r) for r in ts.select(C.dos_date(F.col("t")), C.dos_time(F.col("t"))).collect()] == [(0x21, 0), containers.dos_time(2024, 2, 29, 13, 37, 59), (0xFF9F, 0xBF7D)]
    names = spark.createDataFrame([("a/b.png",), ("x.Png",), ("noext",), ("d.jpeg",)], "p string")
    assert [r[0] for r in names.select(C.format_by_extension(F.col("p"))).collect()] == ["png", "", "", "jpeg"]
    data = spark.createDataFrame([(bytes.fromhex("0102030405"),)], "d binary")
    assert tuple(data.select(C.big_endian(F.col("d"), 1, 2), C.little_endian(F.col("d"), 1, 2)).first()) == (0x0203, 0x0302)
    sizes = spark.createDataFrame([(1024,), (1025,), (1 << 21,)], "n long")
    assert [r[0][-1] for r in sizes.select(C.human_size(F.col("n"))).collect()] == ["4", "K", "M"]


def test_archives_report_errors(spark):
    rows = spark.createDataFrame([("ok", gzip.compress(b"x")), ("bad", gzip.compress(b"x" * 99)[:-4]), ("null", None)], "path string, content binary")
    out = {r.path: r for r in archives.gzip_contents(rows).collect()}
    assert out["ok"].content == b"x" and out["bad"].error and out["null"].error
    assert archives.zip_entries(rows).where("error IS NULL").count() == 0


def test_options():
    o, inputs, notes = parse_args(["-9", "a.png", "-strip", "--pal_sort=200", "--reuse", "--allfilters", "--what", "-rec"])
    assert (o.level, o.strip, o.palette_sort, o.all_filters, o.recurse, inputs, notes) == (9, True, 120, False, True, ["a.png"], ["unknown flag: --what"])
    assert parse_args(["-0"])[0].level == 1 and parse_args(["-25"])[0].iterations == 25 and parse_args(["-10003"])[0].twice == 1
    assert parse_args(["-autorotate"])[2] and parse_args(["-zip"])[0].gzip and Options().strict and not parse_args([])[0].strict


def test_watched_folder_equals_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    write_folder(folder)
    query = watch(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    query.awaitTermination(120)
    batch = recompress.optimize_files(files.eligible(files.scan_files(spark, [str(folder)])))
    key = lambda df: sorted((os.path.basename(r.path), r.after, r.status) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)


def test_batches_are_bounded_in_bytes(spark):
    import pyarrow as pa

    from bytewright import runtime

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    rows = spark.range(64).coalesce(1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    found = [r.n for r in runtime.map_arrow(rows, sizes, "n long").collect()]
    assert sum(found) >= 64 << 20 and max(found) <= runtime.BATCH_BYTES + (2 << 20)


def test_gzip_in_blocks(spark):
    rnd = np.random.default_rng(3)
    big = b"".join(rnd.choice([b"alpha ", b"beta ", b"gamma\n", b"\0\1\2"], 4000).tolist())
    c = zlib.compressobj(0, zlib.DEFLATED, -15)
    loose = containers.gzip_frame(c.compress(big) + c.flush(), zlib.crc32(big), len(big), "n", 5)
    rows = [("a/new.txt", big), ("b.gz", loose), ("c", b""), ("d", b"\x1f\x8b\x08\x20" + b"\0" * 20), ("e", loose[:-3]), ("f", gzip.compress(b"tiny", 9, mtime=0))]
    made = {r.path: r for r in recompress.optimize_gzip_in_blocks(spark.createDataFrame(rows, "path string, content binary"), Options(level=3), master=5000).collect()}
    assert {k: r.status for k, r in made.items()} == {"a/new.txt": "created", "b.gz": "smaller", "c": "empty", "d": "refused", "e": "error: truncated", "f": "kept"}
    for k in ("a/new.txt", "b.gz"):
        assert gzip.decompress(made[k].content) == big and made[k].after == len(made[k].content) < len(big)
    assert containers.gunzip(made["b.gz"].content)[1][0].mtime == 5 and made["e"].content == loose[:-3] and made["f"].content == rows[5][1]


def test_texts_and_coefficients_as_rows(spark):
    from bytewright.codecs import jpeg

    image = png.Image(np.full((2, 2, 4), 9, np.uint16), extra=[(1, png.write_text(png.Text(b"iTXt", "k", "é", True, "fr", "c")))])
    data = png.encode(image, png.choose_mode(image))
    found = archives.png_texts(spark.createDataFrame([("p", data), ("q", data[:50])], "path string, content binary")).collect()
    assert [(r.path, r.keyword, r.text, r.language, r.compressed) for r in found if not r.error] == [("p", "k", "é", "fr", True)] and sum(bool(r.error) for r in found) == 1
    part = jpeg.Component(1, 1, 1, 0, blocks=np.arange(128, dtype=np.int32).reshape(1, 2, 64))
    picture = jpeg.Jpeg(16, 8, {0: (1,) * 64}, [part], [])
    picture.lay_out()
    rows = archives.jpeg_coefficients(spark.createDataFrame([("j", jpeg.write(picture, True))], "path string, content binary")).collect()
    assert [(r.x, r.coefficients) for r in sorted(rows, key=lambda r: r.x)] == [(0, list(range(64))), (1, list(range(64, 128)))]


def norm(value):
    return round(value, 9) if isinstance(value, float) else tuple(map(norm, value)) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations", "events", "orders", "lineitem", "part", "nation", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/sf0.001/{table}.parquet')")
    got = QUERIES[name](spark, f"{DATA}/sf0.001")
    columns = sorted(got.columns)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    have = [tuple(norm(r[c]) for c in columns) for r in got.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["savings_report", "gzip_best_level", "crc32_text"])
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_crc_agrees(spark):
    for r in QUERIES["crc32_text"](spark, f"{DATA}/sf0.001").join(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"), "doc_id").collect():
        assert r.crc32 == zlib.crc32((r.text or "").encode())
