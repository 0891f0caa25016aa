import base64
import gzip
import hashlib
import random
import re
import struct
import urllib.parse
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from bytewright.llm import media, mixing, pii, queries, secret_scan, toxicity, warc
from bytewright.llm.packing import PackParams, Windows, WordIds, best_fit_decreasing, pack_documents
from bytewright.llm.toxicity import FuzzyTrie, Scorer, ToxicityModel, ToxicityParams, DEFAULT_WEIGHTS, fit_logistic, fit_toxicity, held_out, score_toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def connect(tables, sf="sf0.001"):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name,table", [("op3_mix_sources", "documents"), ("op6_warc_round_trip", "pages")])
def test_query_equals_sql(spark, name, table):
    got = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
    con = connect([table]).execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in con.description]
    want = [tuple(r[names.index(c)] for c in sorted(names)) for r in con.fetchall()]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in got.collect()), key=repr) == sorted(want, key=repr)


# Mixing


def mixture(spark):
    rnd = random.Random(2)
    rows = [(k, " ".join(["w"] * rnd.randrange(0, 60)), "en", rnd.choice(["a", "b", "c", None, "é", "hot", "hot", "hot", "hot"]), 1) for k in range(400)]
    rows += [(900, None, "en", "empty", 0), (901, "", "en", "empty", 0), (902, "x y", None, "zz", 3), (902, "x y", None, "zz", 3), (None, "q r", "en", "a", 3)]
    return spark.createDataFrame(rows, SCHEMA)


def water_fill(sizes, weights, budget):
    targets, left = {}, dict(sizes)
    while left:
        spare = budget - sum(targets.values())
        total = sum(weights[s] for s in left)
        over = [s for s in left if spare * weights[s] / total > 2 * left[s]]
        if not over:
            return targets | {s: spare * weights[s] / total for s in left}
        for s in over:
            targets[s] = 2.0 * left.pop(s)
    return targets


def test_mix_hits_its_targets(spark):
    docs = mixture(spark)
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(rows, key=repr) == sorted(again, key=repr) and len(rows) == 405
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        assert 0 <= r.taken <= 2 * r.size
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.source_size >= 0
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want = water_fill({s: n for s, n in sizes.items()}, weights, 1.5 * sum(sizes.values()))
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1, s


def test_repeated_documents_are_the_mix(spark):
    docs = mixture(spark).withColumn("epochs", F.lit(7)).withColumn("target", F.lit("clash"))
    plan, size = {}, {}
    for r in mixing.mix_sources(docs).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.taken
        size[r.doc_id] = r.size
    got = {k: 0 for k in plan}
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] += len(WORDS.findall(r.text or ""))
        assert r.epochs == 7 and r.target == "clash" and (r.doc_id, r.text) in texts
    changed = [k for k in plan if got[k] != plan[k]]
    # Of each source at most one document is rounded, by half its words at most.
    assert len(changed) <= 7 and all(abs(got[k] - plan[k]) * 2 <= size[k] * 2 for k in changed)
    assert mixing.mix_sources(docs.where("false")).count() == 0


def test_sorted_bins_stay_small_for_any_quality(spark, monkeypatch):
    rows = [(k, f"w{k} x y", "en", "hot" if k % 3 else "cold", 5) for k in range(4000)] + [(None, f"n{k}", "en", "hot", 2) for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    seen = []
    real = mixing.settle
    monkeypatch.setattr(mixing, "settle", lambda df, tag, **kw: seen.append((tag, real(df, tag, **kw))) or seen[-1][1])
    for quality in (0.25, 1e-6):
        seen.clear()
        params = mixing.MixParams(edge_rows=40)
        out = mixing.mix_sources(docs, params, F.when(F.col("doc_id") % 2 == 0, quality).otherwise(1.0)).collect()
        last = [t for n, t in seen if n == "mix-rows"]
        assert len(last) > 1
        taken, target, sizes = {}, {}, {}
        for r in out:
            taken[r.target] = taken.get(r.target, 0) + r.taken
            assert 0 <= r.taken <= 2 * r.size
        assert all(abs(t - n) <= 1 for t, n in taken.items())


def test_rounds_end_where_all_ranks_are_equal(spark):
    rows = [(7, "same words here", "en", "a", 3)] * 300 + [(k, "b c", "en", "b", 3) for k in range(5)]
    out = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), mixing.MixParams(edge_rows=10)).collect()
    assert len(out) == 305 and len({r.taken for r in out if r.doc_id == 7 and r.size == 3 and r.source_size == 900}) == 1


def test_many_sources_are_ranked_in_order(spark):
    rows = [(k, "a b", "en", None if k == 50 else f"s{k:03}", 3) for k in range(101)]
    sizes = {r.source_size: r.target for r in mixing.mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    by = sorted(mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r.doc_id == 50, r.doc_id))
    want = water_fill({k: 2 for k in range(101)}, {k: (5, 2, 1)[k % 3] for k in range(101)}, 1.5 * 202)
    assert [r.target for r in by] == pytest.approx([want[k] for k in range(101)]) and len(sizes) == 1


def test_no_python_in_native_operators(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    for frame in (mixing.mix_sources(docs), pii.personal_data(docs), pii.base_spans(docs), pii.term_frequencies(docs, 3)):
        assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().toString())


# Packing


@pytest.fixture(scope="module")
def spec():
    return open(queries.word_tokenizer()).read()


def test_ids_equal_the_library(spec):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(spec)
    texts = ["  Don't STOP it's 12ab <|endoftext|> x<|startoftext|>y", "ÀÉ é Å İstanbul ΣΑΣ 日本語 \x1c\x1d a\x85b", "", None, "½²　z 𝒜 é", "a" * 300 + "!?" * 40]
    con = connect(["documents"])
    texts += [r[0] for r in con.execute("SELECT text FROM documents ORDER BY doc_id LIMIT 60").fetchall()]
    ids, at = WordIds(spec).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_tree_finds_the_tightest_window():
    rnd = random.Random(5)
    tree, open_rooms = Windows(64), []
    for k in range(2000):
        if rnd.random() < 0.55:
            room = rnd.randrange(0, 65)
            tree.add(room, k)
            open_rooms.append(room)
        else:
            size = rnd.randrange(1, 65)
            fits = [r for r in open_rooms if r >= size]
            found = tree.take(size)
            assert (found is None) == (not fits)
            if found:
                assert found[0] == min(fits)
                open_rooms.remove(found[0])


def test_best_fit_decreasing_is_tight():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 2049, 3000)
    number, offset, used = best_fit_decreasing(lengths, 2048)
    filled = np.bincount(number, lengths, minlength=used)
    assert filled.max() <= 2048 and used <= 1.03 * lengths.sum() / 2048 + 2
    for w in range(used):
        mine = np.flatnonzero(number == w)
        mine = mine[np.argsort(offset[mine])]
        assert (offset[mine] == np.cumsum(lengths[mine]) - lengths[mine]).all()


def test_packing_round_trip(spark, spec):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(spec)
    rows = [(k, t) for k, t in enumerate(["short one", None, "", "word " * 5000, "x"] + [f"doc {k} " * (k % 90) for k in range(200)])]
    frame = spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id long, text string, ids int").repartition(3)
    for params in (PackParams(queries.word_tokenizer()), PackParams(queries.word_tokenizer(), group_tokens=3000)):
        out = pack_documents(frame, params).collect()
        pieces, sequences = {}, {}
        for r in out:
            assert r.length == len(r.ids) > 0
            pieces.setdefault(r.doc_id, []).append(r)
            sequences.setdefault(r.sequence_id, []).append(r)
        for k, t in rows:
            mine = sorted(pieces[k], key=lambda r: r.start)
            ids = [i for r in mine for i in r.ids]
            assert ids == whole.encode(t or "", add_special_tokens=False).ids + [1] and mine[0].doc_tokens == len(ids)
            assert [r.start for r in mine] == [sum(x.length for x in mine[:n]) for n in range(len(mine))]
        for s in sequences.values():
            s.sort(key=lambda r: r.offset)
            assert [r.offset for r in s] == [sum(x.length for x in s[:n]) for n in range(len(s))] and sum(r.length for r in s) <= 2048
    assert pack_documents(frame.where("false"), params).count() == 0


def test_packing_of_repeated_ids_and_long_texts(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "other"), (None, "x"), (2, "word " * 60_000)]
    params = PackParams(queries.word_tokenizer(), group_tokens=50_000)
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), params).collect()
    assert sorted(r.doc_tokens for r in out if r.doc_id == 1) == [2, 3, 3] and [r.doc_tokens for r in out if r.doc_id is None] == [2]
    long = sorted((r.start, r.length) for r in out if r.doc_id == 2)
    assert sum(n for _, n in long) == 60_001 and len({(r.sequence_id, r.offset) for r in out}) == len(out)


def test_pieces_are_cut_as_the_library_cuts(spec):
    from tokenizers import Tokenizer

    whole, ids_of, rnd = Tokenizer.from_str(spec), WordIds(spec), random.Random(1)
    bits = ["don't", "we're", "''s", "'s's", "'", "'re", "'ll", "'v", "x'd'", "'ve!", "É", "ñandú", "ǅ", "İ", "Σ", "12½", "ª", "×", "<|", "日本", " ", "\n", "\x85", "’s", "a", "B", "«", "\x1c", "\xad", "Ⱥ", "é", "word" * 90]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(3000)]
    ids, at = ids_of.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_pack_query_digests(spark):
    real = {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pack_documents(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"), PackParams(queries.word_tokenizer())).collect()}
    got = {(r.doc_id, r.start): r.ids_crc32 for r in queries.op4_pack_sequences(spark, f"{DATA}/sf0.001").collect()}
    assert got == real


# Media


def crc(data, bits, poly):
    """Bit by bit, highest first."""
    value = 0
    for byte in data:
        value ^= byte << (bits - 8)
        for _ in range(8):
            value = (value << 1 ^ (poly if value >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
    return value


def flac(frames=3, block=192, stated=True):
    """One channel of constant 8-bit samples."""
    total = frames * block if stated else 0
    info = struct.pack(">HH", block, block) + b"\0" * 6 + (8000 << 44 | 0 << 41 | 7 << 36 | total).to_bytes(8, "big") + b"\0" * 16
    out = b"fLaC" + b"\x80\0\0\x22" + info
    for k in range(frames):
        head = bytes([0xFF, 0xF8, 0x14, 0x02, k])
        head += bytes([crc(head, 8, 0x07)])
        frame = head + bytes([0, 65 + k])
        out += frame + crc(frame, 16, 0x8005).to_bytes(2, "big")
    return out


def samples():
    from bytewright.codecs import containers, png

    image = png.Image(np.random.default_rng(1).integers(0, 256, (5, 6, 4)).astype(np.uint16))
    jpeg = b"\xff\xd8" + b"\xff\xe0\x00\x10JFIF" + b"\0" * 10 + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + b"\x12\xff\x00\x34" + b"\xff\xd9"
    bmp_rows = b"\1\2\3\0" * 2
    ogg = b"OggS\0\2" + b"\0" * 20 + b"\1\3abc" + b"OggS\0\4" + b"\0" * 20 + b"\1\2de"
    return {
        "image/png": png.encode(image, png.choose_mode(image)),
        "image/jpeg": jpeg,
        "image/gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\2\x4c\1\0;",
        "image/bmp": b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(bmp_rows), 0, 54, 40, 1, 2, 1, 24, 0, len(bmp_rows), 0, 0, 0, 0) + bmp_rows,
        "audio/wav": media.wav_bytes(b"abcd" * 16),
        "image/webp": b"RIFF" + struct.pack("<I", 4 + 8 + 4) + b"WEBPVP8 " + struct.pack("<I", 4) + b"data",
        "audio/flac": flac(),
        "video/x-msvideo": b"RIFF" + struct.pack("<I", 4 + 8 + 4) + b"AVI LIST" + struct.pack("<I", 4) + b"hdrl",
        "audio/basic": b".snd" + struct.pack(">IIIII", 24, 5, 2, 8000, 1) + b"12345",
        "audio/midi": b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", 3) + b"abc",
        "audio/ogg": ogg,
        "video/mp4": struct.pack(">I", 16) + b"ftypisom" + b"\0" * 4 + struct.pack(">I", 12) + b"mdatabcd",
        "application/pdf": b"%PDF-1.4 body startxref 0 %%EOF",
        "application/zip": containers.zip_create([("a.txt", b"a" * 50)]),
        "application/gzip": gzip.compress(b"hello" * 30),
    }


def test_every_format_is_confirmed_and_carved():
    machine = media.automaton()
    for kind, data in samples().items():
        assert (kind, 0, len(data)) in media.sniff(data, machine), kind
        inside = b"junk RIFF BM PK\3\4 GIF89a \xff\xd8\xff" + data + b"tail"
        at = inside.index(data)
        assert (kind, at, at + len(data)) in media.sniff(inside, machine), kind
        for cut in (data[:-1] if kind not in ("application/pdf",) else data[:-6], data[: len(data) // 2]):
            assert not [p for p in media.sniff(cut, machine) if p[1] == 0 and p[0] == kind], kind
    assert media.sniff(b"BM RIFFWAVE OggS fLaC %PDF- PK\3\4 ftyp \x1f\x8b\x08", machine) == []


def test_lengths_are_confirmed():
    machine = media.automaton()
    for data in (flac(), flac(stated=False), flac(1)):
        assert ("audio/flac", 0, len(data)) in media.sniff(data + b"\xff\xf8 not a frame" * 4, machine)
    assert not media.sniff(flac()[:-1], machine) and not media.sniff(flac()[:-1] + b"zz", machine)
    large = struct.pack(">I", 16) + b"ftypisom" + b"\0" * 4 + struct.pack(">I4sQ", 1, b"mdat", 20) + b"abcd"
    assert ("video/mp4", 0, len(large)) in media.sniff(large + b"rest", machine)
    two = gzip.compress(b"one") + gzip.compress(b"two")
    assert [p[1:] for p in media.sniff(two, machine)] == [(0, len(two) // 2), (len(two) // 2, len(two))]


def test_repeated_magic_costs_linear_time():
    import time

    machine = media.automaton()
    page = b"OggS\0\2" + b"\0" * 20 + b"\1\1x"
    for unit in (b"%PDF-1 ", b"PK\3\4 ", page, b"\x1f\x8b\x08\0\0\0\0\0\0\3\0"):
        began = time.process_time()
        media.sniff(unit * (2_000_000 // len(unit)), machine)
        assert time.process_time() - began < 20, unit


def test_media_columns(spark):
    texts = [(0, "x" * 64), (1, ""), (2, None), (3, "é" * 40), (4, "y" * 65), (4, "y" * 65), (5, "z" * 100_001)]
    frame = spark.createDataFrame([(k, t, "clash") for k, t in texts], "doc_id long, text string, payload string")
    back = media.sniff_media(media.stored(media.text_media(frame))).collect()
    assert len(back) == len(texts)
    plain = dict(texts)
    for r in back:
        raw = (plain[r.doc_id] or "").encode()
        assert r.n_bytes == len(raw) and r.actual == "audio/wav" and r.corrected and r.bits == 8
        assert len(r.payload) % 64 == 0 and len(r.payload) >= 64 and r.payload[: len(raw)] == raw and not r.payload[len(raw) :].strip(b"\0") and len(r.payload) - len(raw) <= 64
    cells = [("image/png", samples()["image/png"]), ("image/png", samples()["audio/wav"]), ("image/png", None), ("x", b"")]
    out = media.sniff_media(spark.createDataFrame(cells, "declared string, media binary")).collect()
    assert sorted((r.actual, r.corrected) for r in out) == sorted([("image/png", False), ("audio/wav", True), ("application/octet-stream", True), ("application/octet-stream", True)])
    assert media.sniff_media(media.text_media(frame.where("false"))).count() == 0


def test_media_query(spark):
    con = connect(["documents"])
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.op5_media_columns(spark, f"{DATA}/sf0.001").collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.wav_bytes(payload)).hexdigest() and r.media_bytes == len(media.wav_bytes(payload))


# WARC


def test_magic_inside_payloads_is_rejected(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a/", "<p>"), (2, "http://b/\r\nX: y", fake + fake), (3, None, "<p>"), (9, "u", None), (8, "u", ""), (5, "u", "x" + fake + "tail"), (6, "u", "é" * 9000), (7, "u", "<p>")]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    for size in (64, 1000, 1 << 20):
        rows = warc.warc_round_trip(frame, warc.WarcParams(archive_bytes=900, range_bytes=size)).collect()
        got = {r.page_id: r for r in rows}
        assert set(got) == {p[0] for p in pages} and len(rows) == len(pages)
        for k, _, html in pages:
            raw = (html or "").encode()
            assert got[k].payload_bytes == len(raw) and got[k].intact
            assert got[k].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert (got[7].record_type, got[3].record_type, got[3].refers_to, got[8].refers_to, got[9].record_type) == ("response", "revisit", 7, 9, "response")
    apart = {r.page_id: r for r in warc.warc_round_trip(frame, warc.WarcParams(least_revisit=1)).collect()}
    assert apart[8].record_type == "response" and apart[1].record_type == "revisit"
    assert warc.warc_round_trip(frame.where("false")).count() == 0


def test_long_urls_do_not_break_the_chain(spark):
    rows = [(1, "http://a/", "<p>1"), (2, "data:text/html," + "x" * 200_000, "<p>2"), (3, "http://b/WARC/1.1", "<p>3"), (4, "http://c/", "WARC/1.1\r\n" * 50_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r for r in warc.warc_round_trip(frame).collect()}
    assert {k: (r.url, r.payload_bytes, r.intact) for k, r in got.items()} == {k: (u, len(h), True) for k, u, h in rows}


def test_archives_of_any_name_and_form(spark, tmp_path):
    record = lambda k, body: (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{k}>\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    bodies = {k: f"HTTP/1.1 200 OK\r\nX: {k}\r\n\r\n".encode() + bytes([k]) * (k * 400) for k in range(1, 8)}
    parts = [record(k, b) for k, b in bodies.items()]
    (tmp_path / "plain.warc").write_bytes(b"".join(parts))
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "broken.warc").write_bytes(b"".join(parts)[: -len(parts[-1]) + 60])
    (tmp_path / "none.warc").write_bytes(b"no records")
    for size in (50, 700, 1 << 20):
        found = warc.read_warc(spark, f"file://{tmp_path}", warc.WarcParams(range_bytes=size)).collect()
        for name, last in (("plain.warc", 7), ("each.warc.gz", 7), ("broken.warc", 6)):
            mine = sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in found if r.archive.endswith(name))
            assert mine == [(k, 400 * k, base64.b32encode(hashlib.sha1(bytes([k]) * (k * 400)).digest()).decode()) for k in range(1, last + 1)], (name, size)
        assert not [r for r in found if r.archive.endswith("none.warc")]


def test_repeated_pages_and_archive_sizes(spark, tmp_path):
    import os

    rows = [(1, "u", "a" * 500), (1, "u", "a" * 500), (2, "u", "a" * 500), (2, "u", "a" * 500), (3, "u", "b" * 5000), (4, "u", "c" * 5000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.warc_round_trip(frame).collect())
    assert got == [(1, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None), (4, "response", None)]
    warc.write_warc(frame, f"file://{tmp_path}/out", warc.WarcParams(archive_bytes=4000))
    sizes = [len(gzip.open(os.path.join(d, f)).read()) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".gz")]
    assert len(sizes) >= 3 and sum(n > 4000 for n in sizes) == 2


def test_pointer_jumping():
    offsets = np.array([50, 0, 10, 25, 33, 70])
    successors = np.array([70, 10, 50, 33, 50, 99])
    assert warc.reachable(offsets, successors).tolist() == [True, True, True, False, False, True]
    assert warc.reachable(np.array([5]), np.array([9])).tolist() == [False] and warc.reachable(np.array([], int), np.array([], int)).tolist() == []
    n = 1000
    chain = warc.reachable(np.arange(n) * 3, np.arange(1, n + 1) * 3)
    assert chain.all()


# Toxicity


def edits(a, b):
    """Optimal string alignment distance."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_edit_distance():
    terms = {"idiot": (1.0, False), "moron": (1.0, False), "scum": (1.0, False), "clown": (1.0, False), "lowei": (1.0, True)}
    trie = FuzzyTrie(terms, 5)
    rnd = random.Random(3)
    words = ["idiot", "1diot", "idoit", "idio", "idiots", "iidiot", "scum", "scam", "loweischaft", "lowex", "", "cl0wn", "colwn", "morno"]
    for t in ("idiot", "moron", "clown", "scum"):
        for _ in range(150):
            w = list(t)
            for _ in range(rnd.randrange(3)):
                k = rnd.randrange(len(w) + 1)
                w[k : k + rnd.randrange(2)] = rnd.choice(["", "x", "o", "n"])
            words.append("".join(w))
    for w in words:
        best = min((edits(w, t), t) for t in terms if not terms[t][1])
        limit = 0 if best[1] == "scum" else 1
        fits = [t for t in terms if not terms[t][1] and edits(w, t) <= (0 if t == "scum" else 1)]
        got = trie.match(w)
        if w.startswith("lowei"):
            assert got == ("lowei", 0)
        elif fits:
            assert got is not None and got[0] in fits and got[1] == min(edits(w, t) for t in fits), w
        else:
            assert got is None, (w, got, limit)


def brute_features(text, terms, p):
    """The features by trying every term on every word."""
    out = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    strip = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w).lower()

    def match(core):
        near = sorted((edits(core, t), t) for t, (_, stem) in terms.items() if not stem and edits(core, t) <= (len(t) >= p.fuzzy_length))
        stems = [t for t, (_, stem) in terms.items() if stem and core.startswith(t)]
        if near and (near[0][0] == 0 or not stems):
            return near[0][1], near[0][0]
        return (max(stems, key=len), 0) if stems else None

    exact = fuzzy = most = quoted = hits = 0.0
    for k, word in enumerate(words):
        core = strip(word)
        found = match(core)
        if not found and not core.isalpha():
            found = min((m for m in map(match, re.findall(r"[^\W\d_]+", core)) if m), key=lambda m: m[1], default=None)
        if not found:
            continue
        before, after = words[max(0, k - p.window) : k], words[k + 1 : k + 1 + p.window]
        quotes = set('"“”„«»')
        opened = word[:1] in quotes or any(x[:1] in quotes and x[-1:] not in quotes for x in before)
        closed = bool(quotes & {word[-1:], word[-2:-1]}) or any(quotes & {x[-1:], x[-2:-1]} for x in after)
        said = any(strip(x) in toxicity.REPORTING for x in before)
        you = any(strip(x) in toxicity.ADDRESS for x in before + after)
        weight = terms[found[0]][0] * min(1.0, (0.4 if opened and closed else 1.0) * (0.6 if said else 1.0) + (0.3 if you else 0.0))
        if found[1]:
            fuzzy += weight
        else:
            exact, most, hits = exact + weight, max(most, weight), hits + 1
        quoted += opened and closed
    return [1.0, np.log1p(exact), np.log1p(fuzzy), most, np.log1p(quoted), np.log1p(100.0 * hits / max(len(words), 1))]


def test_features_equal_brute_force():
    terms = {"idiot": (0.9, False), "moron": (0.7, False), "scum": (0.5, False), "grump": (0.6, True), "grumpy": (0.3, False)}
    rnd = random.Random(12)
    bits = ["idiot", "idi0t", "idiots", '"idiot', 'moron"', "“moron,”", "scum", "scam", "grumph", "grumpy", "you", "said", "she", "idiot\'s", "moron/stupid", "x" * 80, "grump" + "z" * 90, "_scum_", "the", "a", "12idiot34"]
    texts = [" ".join(rnd.choice(bits) for _ in range(rnd.randrange(30))) for _ in range(300)] + ["", None, "  "]
    got = Scorer(terms, ToxicityParams()).features(pa.array(texts))
    assert np.allclose(got, np.array([brute_features(t, terms, ToxicityParams()) for t in texts]))


def test_long_words_match_and_are_learnt(spark):
    trie = FuzzyTrie({"idiot": (1.0, True)}, 5)
    assert trie.match("idiot" + "x" * 5000) == ("idiot", 0)
    long = "grumphous" * 9
    rows = [(k, f"plain words {k} " + (long if k % 5 == 0 else "fine")) for k in range(600)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    model = fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert any(long.startswith(t) and len(t) > 3 for t in model.terms)


def test_fit_of_repeated_ids_is_bounded_and_ordered(spark):
    rows = [(k % 50, f"text {k} " + ("idiot" if k % 50 % 4 == 0 else "kind")) for k in range(2000)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(50)], "doc_id long, quality int, toxic int")
    models = [fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels) for n in (1, 7)]
    assert models[0].terms == models[1].terms and np.allclose(models[0].weights, models[1].weights)


def test_context_separates_quotation_from_abuse():
    scorer = Scorer({"idiot": (1.0, False)}, ToxicityParams())
    abuse, quote, report, none, nothing, empty = scorer.features(pa.array(["you are an idiot !", 'he said "what an idiot" to them', "she wrote idiot there", "you are kind", "", None]))
    assert abuse[3] == 1.0 > report[3] > quote[3] > none[3] == nothing[3] == empty[3] == 0.0
    assert quote[4] > 0 and abuse[4] == 0


def test_scores_do_not_depend_on_what_is_remembered():
    texts = [" ".join(f"w{k}x{i}" for i in range(400)) + (" you idiot" if k % 3 == 0 else "") for k in range(900)]
    terms = {"idiot": (1.0, False)}
    whole = Scorer(terms, ToxicityParams()).features(pa.array(texts))
    fresh, parts = Scorer(terms, ToxicityParams()), []
    for k in range(0, 900, 300):
        parts.append(fresh.features(pa.array(texts[k : k + 300])))
    assert (whole == np.concatenate(parts)).all() and whole[:, 3].astype(bool).tolist() == [k % 3 == 0 for k in range(900)]


def labelled(spark, n=900):
    rnd = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        words = [rnd.choice("alpha beta gamma delta idea lemon crown clone".split()) for _ in range(rnd.randrange(5, 60))]
        toxic = int(rnd.random() < 0.2)
        if toxic:
            for _ in range(2):
                words[rnd.randrange(len(words))] = rnd.choice(["idiot", "grumph" + rnd.choice(["a", "ob", "il"]), "idi0t"])
        rows.append((k, " ".join(words)))
        labels.append((k, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = fit_toxicity(docs, labels)
    assert any(t.startswith("grump") for t in model.terms)
    out = score_toxicity(docs, model).withColumn("held", held_out()).join(labels, "doc_id").where("held").collect()
    assert 200 < len(out) < 400 and np.mean([r.predicted == r.toxic for r in out]) > 0.97
    held = {r.doc_id for r in out}
    assert held == {k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1}
    wrong = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = fit_toxicity(docs, wrong)
    assert again.terms == model.terms and np.allclose(again.weights, model.weights)


def test_toxicity_of_odd_tables(spark):
    docs, labels = labelled(spark, 30)
    model = fit_toxicity(docs.where("false"), labels)
    assert (model.weights == DEFAULT_WEIGHTS).all()
    rows = spark.createDataFrame([(1, None, 0.5), (1, None, 0.5), (None, "", 0.1), (2, "you idiot", 0.2), (3, "ok " * 200_000, 0.3)], "doc_id long, text string, score double")
    out = score_toxicity(rows, ToxicityModel(model.terms, DEFAULT_WEIGHTS, ToxicityParams())).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert [r.predicted for r in out if r.doc_id == 2] == [1] and [r.predicted for r in out if r.doc_id == 3] == [0]
    assert score_toxicity(rows.where("false"), model).count() == 0


def test_logistic_fit():
    r = np.random.default_rng(0)
    x = np.c_[np.ones(500), r.standard_normal((500, 2))]
    y = (x @ np.array([0.3, 2.0, -1.0]) + r.logistic(size=500) > 0).astype(float)
    w = fit_logistic(x, y, ridge=0.0)
    assert abs(w[1] - 2.0) < 0.6 and abs(w[2] + 1.0) < 0.5


# Secrets


def brute_secrets(text):
    letters = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(letters(w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    assign = re.compile(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_base_spans_equal_brute_force():
    rnd = random.Random(1)
    bits = ["password", "PassWd", "api_key", "APIKEY", "toKen", "ſecret", "toKen", "=", ":", " ", '"', "'", "abcdefgh", "A.b-c_d/", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "\n", "x"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 14)))
        base = [x[:3] for x in secret_scan.scan(text) if x[3]]
        assert base == brute_secrets(text), text
        if base:
            assert secret_scan.candidates(pa.array([text]))[0]


def test_layers_are_unwrapped_to_a_fixpoint():
    plain = 'password = "hunter2hunter2"'
    b64 = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()
    quote = lambda s: urllib.parse.quote(s, safe="")
    hidden = [quote(plain), quote(quote(plain)), b64(plain), b64(b64(plain)), b64(gzip.compress(plain.encode())), b64(zlib.compress(plain.encode())), quote(b64(plain)), b64(quote(plain)), "".join(f"\\u{ord(c):04x}" for c in plain), "".join(f"&#{ord(c)};" for c in plain), "".join(f"%{b:02x}" for b in plain.encode()), b64(b64(gzip.compress(quote(plain).encode())))]
    for text in hidden:
        whole = f"é before {text} after"
        spans = secret_scan.scan(whole)
        found = [s for s in spans if s[0] == "assign" and not s[3]]
        assert found, text
        assert all(8 < a < b <= 9 + len(text) for _, a, b, _ in found)
        assert "hunter2" not in secret_scan.redacted(whole, [s[1:3] for s in spans])
        assert secret_scan.candidates(pa.array([whole]))[0]
    assert secret_scan.scan("clean words only, 100% fine & 50%ab") == []
    assert secret_scan.scan("%25" * 50) == []
    mapped = secret_scan.scan("a token%3Dabcdefgh1 b")
    assert ("assign", 2, 19, False) in mapped


def brute_layers(text):
    """Spans of kinds in a text whose URL escapes, entities and base64 runs are decoded one run at a time, with root places
    for every character; written for short ASCII texts."""
    found, seen = set(), set()
    work = [[(c, k, k + 1) for k, c in enumerate(text)]]
    while work:
        chars = work.pop()
        plain = "".join(c for c, _, _ in chars)
        key = (plain, chars[0][1:] if chars else None, chars[-1][1:] if chars else None)
        if key in seen:
            continue
        seen.add(key)
        found |= {(kind, chars[a][1], chars[b - 1][2]) for kind, a, b in brute_secrets(plain)}
        out, k, changed = [], 0, False
        while k < len(plain):
            m = re.compile("%([0-9A-Fa-f]{2})").match(plain, k)
            if m and int(m.group(1), 16) < 128:
                out.append((chr(int(m.group(1), 16)), chars[k][1], chars[m.end() - 1][2]))
                k, changed = m.end(), True
            else:
                out.append(chars[k])
                k += 1
        if changed:
            work.append(out)
        for m in re.finditer("[A-Za-z0-9+/_-]{16,}={0,2}", plain):
            body = m.group().rstrip("=")
            body = body[: len(body) - (len(body) % 4 == 1)]
            raw = base64.urlsafe_b64decode(body.replace("+", "-").replace("/", "_") + "=" * (-len(body) % 4))
            if raw.isascii():
                at = [(i // 3 * 4 + i % 3) for i in range(len(raw))]
                work.append([(chr(b), chars[m.start() + x][1], chars[m.start() + min(x + 1, len(m.group().rstrip("=")) - 1)][2]) for b, x in zip(raw, at)])
    return sorted(found, key=lambda s: (s[1], secret_scan.KINDS.index(s[0]), s[2]))


def test_layer_spans_equal_brute_force():
    rnd = random.Random(5)
    plain = ["token=abcdefgh1", "AKIA" + "Q" * 16, "0123456789abcdef" * 2, "hello there", "api_key: zyxwvuts9"]
    quote = lambda s: "".join(f"%{ord(c):02X}" if rnd.random() < 0.5 else c for c in s)
    b64 = lambda s: base64.b64encode(s.encode()).decode()
    for _ in range(300):
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            part = rnd.choice(plain)
            for _ in range(rnd.randrange(4)):
                part = rnd.choice([quote, b64])(part)
            parts.append(part)
        text = rnd.choice([" ", ", "]).join(parts)
        assert [s[:3] for s in secret_scan.scan(text)] == brute_layers(text), text


def test_layers_that_were_once_dropped():
    plain = 'password = "hunter2hunter2"'
    b64 = lambda s: base64.b64encode(s).decode()
    packed = gzip.compress(plain.encode())
    numbers = "".join(f"%{b:02x}" for b in packed)
    wrapped = base64.encodebytes(("w " * 60 + plain + " x" * 80).encode()).decode()
    hidden = {
        "byte that is not UTF-8": b64(plain.encode() + b"\xff end"),
        "escaped gzip": numbers,
        "quoted gzip": urllib.parse.quote(packed, safe=""),
        "hexadecimal gzip": "".join(f"\\x{b:02x}" for b in packed),
        "wrapped": wrapped,
        "wrapped gzip": base64.encodebytes(gzip.compress(random.Random(1).randbytes(300) + plain.encode())).decode(),
        "second member": b64(gzip.compress(b"nothing") + packed),
        "bzip2": b64(__import__("bz2").compress(plain.encode())),
        "xz": b64(__import__("lzma").compress(plain.encode())),
        "long entities": "".join(f"&#{ord(c):012d};" for c in plain),
        "controls": b64(bytes(range(32)) * 20 + plain.encode()),
        "inside binary": b64(b"\xff\xfe\0\1" * 9 + packed),
    }
    for name, text in hidden.items():
        whole = f"é before {text} after"
        spans = [s for s in secret_scan.scan(whole) if s[0] == "assign"]
        assert spans and all(9 <= a < b <= 9 + len(text) for _, a, b, _ in spans), name
        assert secret_scan.candidates(pa.array([whole]))[0], name
    # Layers are cut, not dropped: the secret lies past many of them.
    deep = b64(gzip.compress(b"a,b;" * 20_000 + plain.encode()))
    assert [s[0] for s in secret_scan.scan(deep, secret_scan.SecretParams(layer_bytes=1000))] == ["assign"]
    assert secret_scan.scan(b64(zlib.compress(b"x" * 100_000)), secret_scan.SecretParams(layer_bytes=1000)) == []


def test_secret_query_equals_brute_force(spark):
    con = connect(["documents"])
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.op8_secret_scan(spark, f"{DATA}/sf0.001").collect():
        base = brute_secrets(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in secret_scan.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",")) | {""}


def test_secret_columns(spark):
    rows = [(1, "token=abcdefgh1", "l", "s", 15), (1, "token=abcdefgh1", "l", "s", 15), (2, None, None, None, None), (3, "", "l", "s", 0), (4, "clean", "l", "s", 5), (5, "w " * 50_000 + "AKIA" + "Z" * 16, "l", "s", 9)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("secrets", F.lit("clash"))
    out = secret_scan.scan_secrets(frame, redact=True).collect()
    assert [r.text for r in out[:2]] == ["[secret]"] * 2 and out[0].n_chars == 8 and out[2].text is None and out[4].text == "clean"
    assert out[5].text.endswith("[secret]") and len(out[5].secrets) == 1
    assert secret_scan.scan_secrets(frame.where("false")).count() == 0


# Personal data


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_pii(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15)
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_equals_brute_force(spark):
    rnd = random.Random(7)
    bits = ["a", "B9", "@", ".", "-", "_", "%", "+", "(", ")", " ", "1", "25", "256", "4111111111111111", "4539 5787-6362", "é", "😀", "\u0001", "com", "x@y.z", "1.2.3.4", "+49 30 12345", "\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25))) for _ in range(1500)]
    texts += ["", None, "1" * 5000 + " " + "1 " * 4000 + "+" + "1." * 3000 + "a@" + "b." * 3000 + "c", "a" * 20_000 + "@b.c"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tag", F.lit(1)).withColumn("spans", F.lit(2))
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.personal_data(frame).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == brute_pii(t or ""), t


def test_revealing_terms(spark):
    rnd = random.Random(2)
    common = [f"{a}{b}" for a in "the and for with from that this".split() for b in ("", "se", "ly")]
    filler = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    rows = [(k, filler(30)) for k in range(300)]
    rows += [(1000 + k, f"{filler(9)} Boss, quorum the ceo@acme.example and zanzibar {filler(9)} Zanzibar {k}") for k in range(6)]
    rows += [(2000, "zanzibar alone names nobody"), (2001, "one@off.example unique"), (2002, None), (2003, "")]
    rows += [(3000, "copy@copy.example secretive")] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.personal_data(frame)
    got = found.collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        words = {text[r.doc_id][s.start : s.end].lower() for s in r.terms}
        if 1000 <= r.doc_id < 1006:
            assert words == {"boss", "quorum", "zanzibar"} and len(r.terms) == 4
        else:
            assert not words
    clean = {r.doc_id: r.text for r in pii.sanitized(found).collect()}
    assert "[email]" in clean[1000] and "anzibar" not in clean[1000] and "acme" not in clean[1000] and clean[2001].endswith(" unique")
    assert pii.personal_data(frame.where("false")).count() == 0


def test_terms_of_entities_in_one_or_two_texts(spark):
    rnd = random.Random(4)
    common = [f"{a}{b}" for a in "the and for with from that this".split() for b in ("", "se", "ly")]
    filler = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    rows = [(k, f"{filler(20)} {k}") for k in range(3000)]
    rows += [(5000, f"{filler(9)} Quibble, one@off.example {filler(9)} but-QUIBBLE"), (5001, f"{filler(9)} ombrage 10.9.8.7 {filler(9)}"), (5002, f"10.9.8.7 ombrage {filler(9)}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    text = dict(rows)
    got = {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.terms] for r in pii.personal_data(frame).collect()}
    assert got[5000] == ["Quibble", "QUIBBLE"] and got[5001] == got[5002] == ["ombrage"]
    assert not any(got[k] for k in range(3000))


def test_copies_do_not_hide_revealing_terms(spark):
    rnd = random.Random(6)
    common = [f"{a}{b}" for a in "the and for with from that this".split() for b in ("", "se", "ly")]
    filler = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    rows = [(k, f"{filler(20)} {k}") for k in range(300)] + [(1000 + k, f"{filler(9)} zanzibar ceo@acme.example {filler(9)} Zanzibar {k}") for k in range(6)]
    rows += [(2000 + k, rows[-1][1]) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.term: r.df for r in pii.term_frequencies(frame, 3).collect()}["zanzibar"] == 6
    text = dict(rows)
    for r in pii.personal_data(frame).collect():
        assert [text[r.doc_id][s.start : s.end] for s in r.terms] == (["zanzibar", "Zanzibar"] if r.doc_id >= 1000 else [])


def test_personal_data_query_equals_brute_force(spark):
    con = connect(["documents"])
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = queries.op10_pii_sanitisation(spark, f"{DATA}/sf0.001").collect()
    assert len(rows) == len(texts) and any(r.n_email for r in rows)
    for r in rows:
        text = texts[r.doc_id] or ""
        base = brute_pii(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert (r.sanitised_sha256 is None) == (not base)
        if base and not any(s.startswith("term:") for s in r.spans.split(",")):
            out, last = [], 0
            for a, b, k in sorted((a, b, k) for k, a, b in base):
                if a >= last:
                    out += [text[last:a], f"[{k}]"]
                last = max(last, b)
            assert r.sanitised_sha256 == hashlib.sha256("".join([*out, text[last:]]).encode()).hexdigest()


# The pipeline


def test_pipeline_keeps_every_text_of_a_repeated_id(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (6, c), (6, c), (6, c.upper()), (None, a), (None, a), (7, None), (7, None), (8, ""), (9, "short"), (10, "SHORT")]
    frame = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA).withColumn("tag", F.lit(1)).withColumn("digest", F.lit("x"))
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()), key=repr)
    six = [t for k, t in left if k == 6]
    assert len(six) == 1 and six[0] in (c, c.upper())
    assert sorted([x for x in left if x[0] != 6], key=repr) == sorted([(1, a), (5, b), (None, a), (7, None), (8, ""), (9, "short")], key=repr)


def near_groups(rows, percent):
    """Components of rows by shared five-word shingles, pair by pair; rows without words stand alone."""
    sets = []
    for _, text in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORDS.findall(text or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def brute_mix(rows):
    """How often each (doc_id, text, source) is taken."""
    size = lambda t: len(WORDS.findall(t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    targets = water_fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    out = {}
    for s in sizes:
        ranked = []
        for k, t, x in rows:
            if x == s:
                tie = hashlib.md5((t or "").encode()).hexdigest()
                u = (int(hashlib.md5((tie if k is None else str(k)).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                junk = len(re.findall(r"[#$%&*!|~^<>{}=\\]", t or "")) / max(len(t or ""), 1)
                ranked.append((-np.log(u) / (1.0 if junk < 0.01 else 0.5 if junk < 0.05 else 0.25), k if k is not None else -(10**9), tie, k, t))
        epochs = int(targets[s] // sizes[s]) if sizes[s] else 0
        left, done = targets[s] - epochs * sizes[s], 0
        for *_, k, t in sorted(ranked, key=lambda r: r[:3]):
            extra = 0
            if done + size(t) <= left:
                extra = 1
            elif done <= left:
                extra = int(2 * int(left - done) >= size(t) and int(left - done) > 0)
            done += size(t)
            out[k, t, s] = epochs + extra
    return out


def test_pipeline_stages_equal_brute_force(spark, spec):
    import corpus_pipeline as pipeline
    from bytewright.llm.common import settle
    from tokenizers import Tokenizer

    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [settle(docs, "t")]
    for _, stage in pipeline.STAGES:
        tables.append(settle(stage(spark, tables[-1], sf), "t"))
    rows = [sorted(((r.doc_id, r.text, r.source) for r in t.collect()), key=repr) for t in tables[:-1]]
    # Toxicity: the documents whose score by the fitted model passes the threshold go.
    model = fit_toxicity(tables[0], spark.read.parquet(f"{sf}/labels.parquet"))
    x = Scorer(model.terms, model.params).features(pa.array([t for _, t, _ in rows[0]]))
    assert rows[1] == [r for r, f in zip(rows[0], x) if 1 / (1 + np.exp(-(f @ model.weights))) < model.params.threshold]
    # Near-dedup: the smallest id of each group stays.
    groups = near_groups([(k, t) for k, t, _ in rows[1]], 80)
    assert rows[2] == sorted((min((rows[1][i] for i in g), key=lambda r: r[0]) for g in groups), key=repr)
    # Secrets: every span is replaced, nothing else changes.
    want = [(k, t if t is None else secret_scan.redacted(t, [(a, b) for _, a, b, _ in secret_scan.scan(t)]), s) for k, t, s in rows[2]]
    assert rows[3] == sorted(want, key=repr) and all(not brute_secrets(t or "") for _, t, _ in rows[3])
    # Mixing.
    taken = {}
    for r in rows[4]:
        taken[r] = taken.get(r, 0) + 1
    assert taken == {r: n for r, n in brute_mix(rows[3]).items() if n}
    # Packing: all ids of all rows, each once, in sequences of at most 2048.
    whole = Tokenizer.from_str(spec)
    ids = sorted(tuple(whole.encode(t or "", add_special_tokens=False).ids + [1]) for _, t, _ in rows[4])
    pieces, used = {}, {}
    for r in tables[-1].collect():
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
        pieces.setdefault((r.doc_id, r.doc_tokens, r.start), []).append(tuple(r.ids))
    assert max(used.values()) <= 2048 and sum(used.values()) == sum(map(len, ids))
    got = []
    for k, n, start in sorted(pieces, key=repr):
        if start == 0:
            for copy in range(len(pieces[k, n, 0])):
                parts, at = [], 0
                while at < n:
                    piece = pieces[k, n, at][copy]
                    parts += piece
                    at += len(piece)
                got.append(tuple(parts))
    assert sorted(got) == ids


def test_pipeline_of_empty_and_wide_tables(spark):
    import corpus_pipeline as pipeline

    empty = spark.createDataFrame([], SCHEMA).withColumn("score", F.lit(1.0)).withColumn("_tag", F.lit(2))
    for name, stage in pipeline.STAGES:
        out = stage(spark, empty, f"{DATA}/sf0.001")
        assert out.count() == 0 and (name == "packing" or out.columns == list(pipeline.COLUMNS))
    wide = spark.createDataFrame([(1, "token=abcdefgh1 and words", "en", "s", 20)], SCHEMA)
    for clash in ("score", "predicted", "secrets", "_tag", "_src", "tag", "digest", "component_id"):
        wide = wide.withColumn(clash, F.lit("clash"))
    for name, stage in pipeline.STAGES:
        assert stage(spark, wide, f"{DATA}/sf0.001").count() >= 1, name


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline
    from bytewright.llm.common import settle

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(90001, "you idiot moron, you are stupid scum and an idiot " * 3, "en", "src1", 150), (90002, "token=abcdefgh12345 " + " ".join(f"clean{k}" for k in range(40)), "en", "src1", 300), (None, "no id here at all", "en", None, 17), (90003, None, "en", "src2", None)], SCHEMA)
    rows = docs.unionByName(extra).unionByName(docs.limit(3))
    tables = []
    for name, stage in pipeline.STAGES:
        rows = settle(stage(spark, rows, sf), "t")
        tables.append(rows)
        if name != "packing":
            assert rows.columns == list(pipeline.COLUMNS)
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert 90001 not in ids[0] and {90002, None, 90003} <= ids[0]
    assert tables[1].count() == tables[1].select("doc_id").distinct().count()
    redacted = tables[2].where("doc_id = 90002").first()
    assert redacted.text.startswith("[secret] clean0") and redacted.n_chars == len(redacted.text)
    words = lambda t: sum(len(WORDS.findall(r.text or "")) for r in t.select("text").collect())
    # Whole documents: a source may miss its target by half a document.
    longest = {}
    for r in tables[2].collect():
        longest[r.source] = max(longest.get(r.source, 0), len(WORDS.findall(r.text or "")))
    assert words(tables[3]) == pytest.approx(1.5 * words(tables[2]), abs=sum(longest.values()) / 2 + 1)
    assert tables[4].where("length > 2048 or length <> size(ids)").count() == 0 and ids[4] == ids[3]


def test_pipeline_drops_near_copies_from_80_percent_on(spark):
    import corpus_pipeline

    # Of 100 shingles each, 90 of 110 (0.82) and 88 of 112 (0.79) are shared.
    rows = []
    for k, changed in ((0, 10), (10, 12)):
        words = [f"w{k}x{i}" for i in range(104)]
        rows += [(k, " ".join(words), "en", "s", 1), (k + 1, " ".join(words[:-changed] + [f"y{i}" for i in range(changed)]), "en", "s", 1)]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in left.collect()) == [0, 10, 11]


def test_everything_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names} and "pipeline" in names and "savings_report" in names
    assert set(entry.oracle_sql()) <= set(names)
