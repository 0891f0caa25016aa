import gzip
import io
import os
import zipfile
import zlib

import numpy as np

from bytewright.__main__ import main
from bytewright.codecs import png


def test_files_are_optimised_in_place(spark, tmp_path, capsys):
    px = np.zeros((16, 16, 4), np.uint16)
    px[:, :, 3], px[:, :, 1] = 255, np.arange(16)
    data = png.encode(png.Image(px), png.Mode(6, 8), "0", lambda raw: zlib.compress(raw, 0))
    (tmp_path / "a.png").write_bytes(data)
    os.utime(tmp_path / "a.png", (1_000_000_000, 1_000_000_000))
    (tmp_path / "b.txt").write_bytes(b"text " * 300)
    assert main(["-4", "-keep", str(tmp_path / "a.png")]) == 0
    small = (tmp_path / "a.png").read_bytes()
    assert len(small) < len(data) and png.same_image(png.decode(small), png.Image(px))
    assert int(os.path.getmtime(tmp_path / "a.png")) == 1_000_000_000
    assert "Saved" in capsys.readouterr().out
    assert main(["-gzip", str(tmp_path / "b.txt")]) == 0
    assert gzip.decompress((tmp_path / "b.txt.gz").read_bytes()) == b"text " * 300
    assert main([str(tmp_path / "missing.png")]) == 1 and main(["-help"]) == 0


def test_flags_take_effect(spark, tmp_path, capsys):
    from bytewright.codecs import jpeg
    from bytewright.options import parse_args

    part = jpeg.Component(1, 1, 1, 0, blocks=np.arange(128, dtype=np.int32).reshape(1, 2, 64) % 50)
    orientation = (0xE1, b"Exif\0\0MM\0*\0\0\0\x08\0\1\1\x12\0\3\0\0\0\1\0\6\0\0\0\0\0\0")
    picture = jpeg.Jpeg(16, 8, {0: (1,) * 64}, [part], [orientation])
    picture.lay_out()
    (tmp_path / "p.jpg").write_bytes(jpeg.write(picture))
    assert main(["-progressive", "-strip", "-autorotate", str(tmp_path / "p.jpg")]) == 0
    turned = jpeg.read((tmp_path / "p.jpg").read_bytes())
    assert (turned.width, turned.height) == (8, 16) and not turned.segments
    text = b"alpha beta gamma " * 4000
    (tmp_path / "t.txt").write_bytes(text)
    assert main(["-3", "-gzip", "--mt-deflate=4", "--mt-file=2", str(tmp_path / "t.txt")]) == 0
    assert gzip.decompress((tmp_path / "t.txt.gz").read_bytes()) == text
    main(["--arithmetic", "-quiet", str(tmp_path / "p.jpg")])
    assert "--arithmetic" in capsys.readouterr().out
    options = parse_args(["-20015", "--allfilters-c"])[0]
    assert (options.level, options.iterations, options.twice, options.all_filters_cheap) == (9, 15, 2, True)


def test_read_only_files_stay(spark, tmp_path):
    data = gzip.compress(b"x" * 5000, 1)
    for name, mode in (("a.png", 0o444), ("b.txt", 0o640)):
        (tmp_path / name).write_bytes(data)
        os.chmod(tmp_path / name, mode)
    from bytewright.sources.sinks import write_files

    rows = [(f"file:{tmp_path}/a.png", b"new"), (f"file:{tmp_path}/b.txt", b"new")]
    out = {os.path.basename(r.path): r.written for r in write_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert out == {"a.png": False, "b.txt": True} and (tmp_path / "a.png").read_bytes() == data
    assert os.stat(tmp_path / "b.txt").st_mode & 0o777 == 0o640 and not list(tmp_path.glob("*.tmp"))


def test_zip(spark, tmp_path, capsys):
    (tmp_path / "d" / "empty").mkdir(parents=True)
    (tmp_path / "d" / "x.txt").write_bytes(b"x" * 500)
    assert main(["-zip", str(tmp_path / "d")]) == 0
    with zipfile.ZipFile(tmp_path / "d.zip") as z:
        assert sorted(z.namelist()) == ["d/empty/", "d/x.txt"] and z.read("d/x.txt") == b"x" * 500
    (tmp_path / "more.txt").write_bytes(b"more")
    assert main(["-zip", str(tmp_path / "d.zip"), str(tmp_path / "more.txt")]) == 0
    with zipfile.ZipFile(io.BytesIO((tmp_path / "d.zip").read_bytes())) as z:
        assert z.read("more.txt") == b"more" and len(z.namelist()) == 3


def test_palette_orders_are_permutations():
    palette = tuple((k * 40 % 256, k * 90 % 256, k, 255 if k % 3 else 0) for k in range(6))
    indexes = np.random.default_rng(0).integers(0, 6, (9, 9))
    orders = png.palette_orders(palette, {c: k for k, c in enumerate(palette)}, indexes, 120)
    assert len(orders) > 20 and all(sorted(o) == sorted(palette) for o in orders)
    px = np.array(palette, np.uint16)[indexes]
    data = png.encode(png.Image(px), png.Mode(6, 8), "0", lambda raw: zlib.compress(raw, 0))
    few, many = png.optimize(data, 1), png.optimize(data, 1, palette_sort=120)
    assert len(many) <= len(few) and png.same_image(png.decode(many), png.Image(px))
