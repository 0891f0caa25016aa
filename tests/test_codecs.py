import gzip
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytewright.codecs import containers as C
from bytewright.codecs import deflate as D
from bytewright.codecs import huffman as H
from bytewright.codecs import png as P


@given(st.lists(st.sampled_from([0, 1, 2, 5, 100, 1000]), min_size=2, max_size=40), st.integers(6, 15))
@settings(max_examples=60, deadline=None)
def test_limited_lengths_are_complete_and_optimal_without_the_limit(counts, limit):
    lengths = H.limited_lengths(counts, limit)
    used = [n for n in counts if n]
    assert max(lengths, default=0) <= limit
    if len(used) >= 2:
        assert abs(H.kraft_sum(lengths) - 1) < 1e-9
        if limit == 15:
            heap, total = sorted(used), 0
            while len(heap) > 1:
                a = heap.pop(0) + heap.pop(0)
                total += a
                heap = sorted([*heap, a])
            assert sum(n * k for n, k in zip(counts, lengths)) == total


def test_code_special_cases():
    assert H.limited_lengths([0, 0], 7) == [0, 0]
    assert H.limited_lengths([0, 9], 7) == [0, 1]
    assert H.limited_lengths([4, 9], 7) == [1, 1]
    assert H.canonical_codes([2, 1, 3, 3]) == [0b10, 0b0, 0b110, 0b111]
    assert H.two_distance_codes([0] * 30)[:3] == [1, 1, 0]
    assert H.two_distance_codes([0, 0, 1])[:3] == [1, 0, 1]
    assert H.rle_code_lengths([0] * 140 + [5] * 5) == [(18, 127), (0, 0), (0, 0), (5, 0), (16, 1)]
    assert H.runs([1, 1, 2]) == [(1, 2), (2, 1)]


def test_symbols_at_their_borders():
    assert [D.length_symbol(n) for n in (3, 10, 11, 257, 258)] == [(257, 0, 0), (264, 0, 0), (265, 1, 0), (284, 5, 30), (285, 0, 0)]
    assert [D.distance_symbol(n) for n in (1, 4, 5, 24577, 32768)] == [(0, 0, 0), (3, 0, 0), (4, 1, 0), (29, 13, 0), (29, 13, 8191)]


@pytest.mark.parametrize("level", [1, 2, 4])
def test_deflate_round_trip(level):
    rnd = random.Random(3)
    texts = [b"", b"a", b"abc" * 300, bytes(rnd.randrange(256) for _ in range(2000)), b"\0" * 3000 + bytes(range(256)) * 4, b"".join(rnd.choice([b"alpha ", b"beta ", b"gamma\n"]) for _ in range(900))]
    for data in texts:
        assert D.inflate(D.deflate(data, level)) == data


def test_every_match_is_one():
    rnd = random.Random(2)
    data = b"".join(rnd.choice([b"alpha ", b"beta", b"x", b"\0" * 40]) for _ in range(1500)) + bytes(rnd.randrange(4) for _ in range(3000))
    for chain, every in ((4, False), (20_000, False), (64, True)):
        found = D.Matches(data, chain, every=every)
        for i in range(0, len(data), 7):
            steps = found.at(i)
            for n, d in steps:
                assert data[i : i + n] == (data[i - d : i] * (n // d + 1))[:n] and 3 <= n <= 258 and d <= i
            if steps and not every:
                assert [n for n, _ in steps] == sorted({n for n, _ in steps}) and steps[-1] == (found.best_length[i], found.best_distance[i])
            if chain == 20_000 and i % 49 == 0:
                longest = max((n for j in range(max(0, i - 32768), i) if data[j : j + 3] == data[i : i + 3] for n in [next((k for k in range(3, 259) if i + k >= len(data) or k == 258 or data[j + k] != data[i + k]), 258)]), default=0)
                assert (steps[-1][0] if steps else 0) == longest


def test_rows_do_not_see_each_other():
    rows = [b"abcabcabc", b"abcabc", b"", b"xabc"]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    together = D.Matches(b"".join(rows), 32, bounds)
    for k, row in enumerate(rows):
        alone = D.Matches(row, 32)
        assert [together.at(int(bounds[k]) + i) for i in range(len(row))] == [alone.at(i) for i in range(len(row))]


def test_streams_follow_each_other():
    rnd = random.Random(4)
    data = b"".join(rnd.choice([b"one ", b"two ", b"three\n", bytes([rnd.randrange(256)])]) for _ in range(3000))
    cut = len(data) // 3
    for level in (2, 3):
        parts = D.deflate(data[:cut], level, final=False) + D.deflate(data[cut:], level, window=data[:cut])
        assert D.inflate(parts) == data
    assert D.inflate(D.deflate(data, 4, master=700, rounds=1)) == data
    assert len(D.deflate(data, 4, rounds=1)) <= len(zlib.compress(data, 9))


def test_package_merge_is_optimal():
    rnd = random.Random(5)
    for _ in range(60):
        counts = [rnd.choice([0, 1, 2, 3, 5, 8, 13, 400, 9000]) for _ in range(rnd.randrange(3, 7))]
        used = [n for n in counts if n]
        for limit in (3, 4, 7):
            if 2 <= len(used) <= 1 << limit:
                got = H.limited_lengths(counts, limit)
                best = min(sum(n * k for n, k in zip(used, lengths)) for lengths in __import__("itertools").product(range(1, limit + 1), repeat=len(used)) if sum(2.0**-k for k in lengths) <= 1)
                assert sum(n * k for n, k in zip(counts, got)) == best


def test_smoothings_keep_used_symbols():
    rnd = random.Random(6)
    for _ in range(200):
        counts = [rnd.choice([0, 0, 1, 2, 3, 50, 51, 52]) for _ in range(60)]
        for way in (H.smoothed, H.strided):
            assert all(b > 0 for a, b in zip(counts, way(counts)) if a > 0)


@given(st.binary(max_size=600))
@settings(max_examples=40, deadline=None)
def test_deflate_any_bytes(data):
    assert D.inflate(D.deflate(data, 3)) == data
    assert D.inflate(D.best_deflate(data)) == data


def test_deflate_beats_zlib_on_text():
    text = " ".join(f"{random.Random(k % 97).random():.4f}" for k in range(1500)).encode()
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    assert len(D.deflate(text, 5)) <= len(c.compress(text) + c.flush())


def test_blocks_split_where_statistics_change():
    rnd = random.Random(1)
    data = bytes(rnd.choice(b"abcd") for _ in range(4000)) + bytes(rnd.choice(b"WXYZ0123456789") for _ in range(4000))
    tokens = D.lazy_tokens(data, D.Matches(data, 4))
    assert D.split_points(tokens, 200)


def test_inflate_is_strict():
    whole = zlib.compress(b"x" * 100)[2:-4]
    with pytest.raises((ValueError, zlib.error)):
        D.inflate(whole[:-2])
    with pytest.raises(ValueError):
        D.inflate(whole + b"y")


def test_large_archives_and_members():
    entries = [C.ZipEntry(b"%d" % k, 0, 0, 0, 0x21, 0, 0, 0, 0) for k in range(70_000)]
    made = C.zip_write(entries, b"head")
    back, base = C.zip_entries(made)
    assert len(back) == 70_000 and base == 4 and len(zipfile.ZipFile(io.BytesIO(made)).namelist()) == 70_000
    many = gzip.compress(b"x", mtime=0) * 20_000
    assert C.gunzip(many)[0] == b"x" * 20_000
    with pytest.raises(C.FormatError):
        C.gunzip(gzip.compress(bytes(5_000_000)), most=1_000_000)


def test_text_chunks():
    for text in (P.Text(b"tEXt", "Title", "é plain"), P.Text(b"zTXt", "Note", "long " * 50, True), P.Text(b"iTXt", "Über", "日本 " * 30, True, "ja", "訳"), P.Text(b"iTXt", "k", "x")):
        assert P.read_text(P.write_text(text)) == text
    for kind, body in ((b"tEXt", b"no end"), (b"zTXt", b"k\0\1abc"), (b"zTXt", b"k\0\0abc"), (b"iTXt", b"k\0\0"), (b"tEXt", b"\0x"), (b"iTXt", b"k\0\0\0a\0b\0\xff")):
        with pytest.raises(P.PngError):
            P.read_text(P.Chunk(kind, body))
    made = image(4, 4, "rgb")
    made.extra.append((2, P.Chunk(b"zTXt", b"k\0\0" + zlib.compress(b"again " * 99, 0))))
    small = P.optimize(P.encode(made, P.choose_mode(made)), 3)
    assert [t.text for t in P.texts(small)] == ["again " * 99] and len(small) < 400


def test_strip_policies():
    made = image(3, 3, "rgb")
    made.extra += [(1, P.Chunk(b"gAMA", b"\0\0\1\0")), (1, P.write_text(P.Text(b"tEXt", "k", "v")))]
    data = P.encode(made, P.Mode(2, 8))
    kinds = lambda d: {c.kind for c in P.chunks(d)}
    assert kinds(P.strip(data)) == {b"IHDR", b"IDAT", b"IEND"} and kinds(P.strip(data, lambda c: c.kind == b"gAMA")) == {b"IHDR", b"gAMA", b"IDAT", b"IEND"}
    assert P.same_image(P.decode(P.strip(data, lambda c: False)), made)


def test_plan_of_each_level():
    assert sorted(P.PLANS) == list(range(1, 10)) and P.PLANS[9].before == 3 and P.PLANS[4].bonus < P.PLANS[5].bonus
    made = image(12, 12, "gray")
    data = P.encode(made, P.Mode(6, 8), "0")
    for level in (1, 5, 9):
        assert P.same_image(P.decode(P.optimize(data, level, passes=1)), made)
    assert P.same_image(P.decode(P.optimize(data, 2, all_filters=True, cheap=True, passes=0)), made)


def test_genetic_filters_are_no_worse_than_plain_ones():
    made = image(6, 9, "rgb")
    lines = P.pack_samples(P.to_samples(made, P.Mode(2, 8)), 8)
    types = P.choose_filters(lines, 3, "genetic")
    size = lambda t: len(zlib.compress(P.apply_filters(lines, 3, t), 9))
    assert size(types) <= min(size([k] * 6) for k in range(5)) and types == P.choose_filters(lines, 3, "genetic")
    assert size(P.choose_filters(lines, 3, "cheap")) == min(size(P.choose_filters(lines, 3, s)) for s in P.INCREMENTAL)


def image(height, width, kind, seed=0):
    r = np.random.default_rng(seed)
    px = np.full((height, width, 4), 255, np.uint16)
    if kind == "gray":
        px[:, :, :3] = r.integers(0, 256, (height, width, 1))
    elif kind == "palette":
        px[:] = np.array([[1, 2, 3, 255], [9, 9, 9, 255], [0, 0, 0, 0]])[r.integers(0, 3, (height, width))]
    elif kind == "rgba":
        px[:] = r.integers(0, 256, (height, width, 4))
    elif kind == "rgb":
        px[:, :, :3] = r.integers(0, 256, (height, width, 3))
    elif kind == "lines":
        px[:, :, :3] = 255 * r.integers(0, 2, (height, width, 1))
    elif kind == "key":
        px[:, :, :3] = r.integers(1, 256, (height, width, 3))
        px[::3, ::3] = 0
    return P.Image(px)


@pytest.mark.parametrize("kind", ["gray", "palette", "rgba", "rgb", "lines", "key"])
@pytest.mark.parametrize("strategy", P.STRATEGIES)
def test_png_round_trip(kind, strategy):
    made = image(9, 11, kind)
    assert P.same_image(P.decode(P.encode(made, P.choose_mode(made), strategy)), made)


@pytest.mark.parametrize("color,depth", [(c, d) for c, ds in P.DEPTHS.items() for d in ds])
def test_every_mode_decodes(color, depth):
    r = np.random.default_rng(5)
    height, width = 5, 7
    samples = r.integers(0, 1 << depth, (height, width, P.CHANNELS[color])).astype(np.uint16)
    h = P.Header(width, height, depth, color)
    body = P.apply_filters(P.pack_samples(samples, depth), h.pixel_bytes, [4] * height)
    parts = [P.SIGNATURE, P.write_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0))]
    if color == 3:
        parts.append(P.write_chunk(b"PLTE", bytes(range(256)) * 3))
    data = b"".join([*parts, P.write_chunk(b"IDAT", zlib.compress(body)), P.write_chunk(b"IEND", b"")])
    back = P.decode(data)
    assert P.filter_types(data) == [4] * height
    top = (1 << depth) - 1
    want = samples[:, :, 0].astype(int) if color == 3 or depth >= 8 else samples[:, :, 0].astype(int) * 255 // top
    table = np.frombuffer(bytes(range(256)) * 3, np.uint8).reshape(-1, 3)
    assert (back.pixels[:, :, 0] == (table[want][:, :, 0] if color == 3 else want)).all()
    assert P.same_image(P.decode(P.encode(back, P.choose_mode(back))), back)


def test_interlaced_file_decodes():
    made = image(10, 13, "rgb")
    h = P.Header(13, 10, 8, 2, 1)
    body = b""
    for (x, y, dx, dy), (w, n) in zip(P.ADAM7, h.passes()):
        if w and n:
            body += P.apply_filters(P.pack_samples(made.pixels[y::dy, x::dx, :3], 8), 3, [1] * n)
    assert len(body) == h.raw_size()
    data = P.SIGNATURE + P.write_chunk(b"IHDR", struct.pack(">IIBBBBB", 13, 10, 8, 2, 0, 0, 1)) + P.write_chunk(b"IDAT", zlib.compress(body)) + P.write_chunk(b"IEND", b"")
    assert P.same_image(P.decode(data), made)
    small = P.optimize(data, 1)
    assert P.header(small).interlace == 0 or small == data


def test_png_errors_and_guards():
    made = image(6, 6, "rgb")
    data = P.encode(made, P.choose_mode(made))
    for broken in (b"x" + data[1:], data[:40], data[:-12], data[:30] + b"\x09" + data[31:]):
        with pytest.raises(P.PngError):
            P.decode(broken)
    animated = data[:33] + P.write_chunk(b"acTL", b"\0" * 8) + data[33:]
    assert P.optimize(animated) == animated
    text = data[:33] + P.write_chunk(b"tEXt", b"k\0v") + data[33:]
    assert b"tEXt" not in P.strip(text)
    assert any(c.kind == b"tEXt" for _, c in P.decode(text).extra)
    assert P.unused_color(made.pixels) is not None
    assert P.line_score(0, np.array([1, 255], np.uint8), "minsum") == 256
    assert P.line_score(1, np.array([1, 255], np.uint8), "minsum") == 1


def test_hidden_colours_change_only_when_allowed():
    px = image(8, 8, "rgba").pixels
    px[:, :, 3] = 255
    px[2:5, 2:5, 3] = 0
    data = P.encode(P.Image(px), P.Mode(6, 8), "0", lambda raw: zlib.compress(raw, 0))
    assert P.same_image(P.decode(P.optimize(data, 2, strict=True)), P.Image(px))
    assert P.same_image(P.decode(P.optimize(data, 2, strict=False)), P.Image(px), hidden=False)


def test_hidden_colours_follow_the_filter():
    px = image(7, 9, "rgba", 4).pixels
    px[:, :, 3] = 255
    px[1:5, 2:8, 3] = 0
    for kind, how in enumerate(P.HIDDEN):
        made = P.clean_alpha(P.Image(px), how)
        assert P.same_image(made, P.Image(px), hidden=False)
        if kind:
            lines = P.pack_samples(made.pixels, 8)
            for y in range(1, 5):
                zeros = P.filter_line(kind, lines[y], lines[y - 1], 4).reshape(-1, 4)[2:8, :3]
                assert not zeros.any()


def test_short_matches_become_cheaper_literals():
    litlen = [2] * 257 + [12] * 31
    pairs = lambda t: list(zip(t.value.tolist(), t.distance.tolist()))
    tokens = D.tokens_of([97, 98, 99, 3, 20], [0, 0, 0, 3, 3])
    raw = b"abcabc" + b"abc" * 7
    assert pairs(D.cheaper_literals(tokens, raw, litlen, [9] * 32)) == [(97, 0), (98, 0), (99, 0), (97, 0), (98, 0), (99, 0), (20, 3)]
    assert pairs(D.cheaper_literals(tokens, raw, [0] * 257 + [12] * 31, [9] * 32)) == pairs(tokens)


def test_gzip():
    text = b"hello world " * 200
    made, status = C.gzip_optimize(text, 3, name="/a/b.txt")
    assert status == "created" and gzip.decompress(made) == text and C.gunzip(made)[1][0].name == "b.txt"
    again, status = C.gzip_optimize(gzip.compress(text, 1))
    assert status == "smaller" and gzip.decompress(again) == text
    assert C.gunzip(gzip.compress(b"a") + gzip.compress(b"b") + b"junk")[0] == b"ab"
    for broken in (gzip.compress(text)[:-3], gzip.compress(text)[:-8] + b"\0" * 8, b"\x1f\x8b\x08"):
        with pytest.raises(C.FormatError):
            C.gunzip(broken)
    assert C.gzip_optimize(b"")[1] == "empty"
    extra = b"\x1f\x8b\x08\x04" + b"\0" * 6 + b"\x02\x00ab" + gzip.compress(text)[10:]
    assert C.gzip_classify(extra) == "extras" and C.gzip_optimize(extra, strict=True)[1] == "refused"
    assert C.gzip_classify(b"\x1f\x8b\x08\x20" + b"\0" * 20) == "error" and C.gzip_classify(b"plain") == "none"


def test_zip():
    out = io.BytesIO()
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep " * 50, zipfile.ZIP_DEFLATED)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("x.txt", b"text " * 400)
        z.writestr("empty", b"")
        z.writestr("stored.bin", b"s" * 50, zipfile.ZIP_STORED)
        z.writestr("in.zip", inner.getvalue())
        z.comment = b"PK\5\6" + b"x" * 30
    data = b"#!prefix" + out.getvalue()
    made = C.zip_optimize(data, 3)
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.testzip() is None and z.read("x.txt") == b"text " * 400
        assert z.getinfo("stored.bin").compress_type == 0 and z.getinfo("empty").compress_type == 0
    assert made.startswith(b"#!prefix") and len(made) < len(data)
    more = C.zip_create([("new/", b""), ("n.txt", b"n" * 99)], made)
    with zipfile.ZipFile(io.BytesIO(more)) as z:
        assert z.read("n.txt") == b"n" * 99
    for name in ("X.TXT", "/abs", "a\\b", "c:d"):
        with pytest.raises(C.FormatError):
            C.zip_create([(name, b"")], made)
    with pytest.raises(C.FormatError):
        C.zip_entries(b"nothing here")
    broken = bytearray(made)
    at = broken.find(b"text"[:1], 40)
    broken[at + 20] ^= 255
    assert C.zip_optimize(bytes(broken), 3)


def test_jpeg_markers():
    def segment(marker, body):
        return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body

    tail = segment(0xDA, b"\0") + b"\x12\x34\xff\xd9"
    for order, value in (("<", 6), (">", 3)):
        tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IHHHIHH", 8, 1, 0x0112, 3, 1, value, 0)
        data = b"\xff\xd8" + segment(0xE0, b"JFIF\0x") + segment(0xE0, b"JFIF\0y") + segment(0xE1, b"Exif\0\0" + tiff) + segment(0xFE, b"note") + tail
        assert C.exif_orientation(data) == value
        slim = C.jpeg_strip(data)
        assert slim.count(b"JFIF") == 1 and b"Exif" not in slim and b"note" not in slim and slim.endswith(b"\x12\x34\xff\xd9")
    assert C.exif_orientation(b"\xff\xd8" + segment(0xE1, b"Exif\0\0II*\0\xff") + tail) == 0
    assert C.exif_orientation(b"no") == 0
    assert C.tries_baseline(6499, 2) and not C.tries_baseline(6500, 2) and C.tries_baseline(19999, 7)
    assert C.dos_time(1979, 1, 1, 0, 0, 0) == (0x21, 0) and C.dos_time(1980, 1, 1, 0, 0, 3) == (0x21, 1)
