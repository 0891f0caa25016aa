import random
import struct

import numpy as np
import pytest

from bytewright.codecs import jpeg as J
from bytewright.codecs.containers import FormatError


def picture(width, height, sampling, seed=1, segments=()):
    r = np.random.default_rng(seed)
    parts = [J.Component(k + 1, h, v, min(k, 1)) for k, (h, v) in enumerate(sampling)]
    image = J.Jpeg(width, height, {0: tuple(range(1, 65)), 1: tuple(range(64, 0, -1))}, parts, [(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), *segments])
    image.lay_out()
    for c in image.components:
        c.blocks[:] = r.integers(-1000, 1000, c.blocks.shape) * (r.random(c.blocks.shape) < 0.05) + r.integers(-2, 3, c.blocks.shape) * (r.random(c.blocks.shape) < 0.3)
    return image


SHAPES = [(17, 9, [(2, 2), (1, 1), (1, 1)]), (32, 16, [(2, 1), (1, 1), (1, 1)]), (5, 70, [(1, 1)]), (40, 40, [(1, 1)] * 4), (64, 48, [(2, 2), (1, 1), (1, 1)]), (33, 33, [(4, 4), (1, 1), (1, 1)])]


def test_zigzag():
    assert J.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and J.ZIGZAG[-1] == 63 and sorted(J.ZIGZAG) == list(range(64))


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("progressive", [False, True])
def test_coefficients_survive(shape, progressive):
    image = picture(*shape)
    back = J.read(J.write(image, progressive))
    assert J.same_coefficients(back, image) and back.progressive == progressive and back.segments == image.segments
    assert J.same_coefficients(J.read(J.write(back, not progressive)), image)


@pytest.mark.parametrize("shape", [SHAPES[1], SHAPES[4], (16, 24, [(1, 1)])])
def test_turns_undo_each_other(shape):
    image = picture(*shape)
    for how in J.TRANSFORMS:
        turned = J.transform(image, how)
        back = {"rotate 90": "rotate 270", "rotate 270": "rotate 90"}.get(how, how)
        assert J.same_coefficients(J.transform(turned, back), image)
        assert J.same_coefficients(J.read(J.write(turned)), turned)
    quarter = J.transform(J.transform(image, "rotate 90"), "rotate 90")
    assert J.same_coefficients(quarter, J.transform(image, "rotate 180"))


def samples(image):
    """Samples of a component by the inverse transform, for looking only."""
    c = image.components[0]
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[None, :]
    table = np.array(image.tables[c.table])
    rows = []
    for y in range(c.size[0]):
        rows.append(np.concatenate([basis @ (c.blocks[y, x] * table)[J.NATURAL].reshape(8, 8) @ basis.T for x in range(c.size[1])], axis=1))
    return np.concatenate(rows)[: image.height, : image.width]


def test_turned_coefficients_are_turned_samples():
    image = picture(24, 16, [(1, 1)])
    look = samples(image)
    wanted = {"flip horizontally": look[:, ::-1], "flip vertically": look[::-1], "rotate 180": look[::-1, ::-1], "transpose": look.T, "rotate 90": np.rot90(look, -1), "rotate 270": np.rot90(look), "transverse": np.rot90(look, 2).T, "none": look}
    for how, want in wanted.items():
        assert np.allclose(samples(J.transform(image, how)), want), how


def test_edges_are_kept_or_trimmed():
    image = picture(20, 20, [(1, 1)])
    assert J.transform(image, "rotate 90") is None and J.transform(image, "transpose") is not None
    cut = J.transform(image, "rotate 90", trim=True)
    assert (cut.width, cut.height) == (16, 20)
    assert np.allclose(samples(cut), np.rot90(samples(image)[:16], -1))


def exif(value):
    return (0xE1, b"Exif\0\0MM\0*\0\0\0\x08\0\1\1\x12\0\3\0\0\0\1\0" + bytes([value]) + b"\0\0\0\0\0\0")


def test_optimize():
    image = picture(48, 32, [(1, 1)], segments=[exif(6), (0xFE, b"comment")])
    for form in (False, True):
        data = J.write(image, form)
        made, status = J.optimize(data, 3, progressive=not form)
        assert len(made) <= len(data) and J.same_coefficients(J.read(made), image) and J.read(made).segments == image.segments
    bare, _ = J.optimize(J.write(image), 3, strip=True)
    assert [m for m, _ in J.read(bare).segments] == [0xE0]
    turned, status = J.optimize(J.write(image), 3, strip=True, autorotate=2)
    assert status == "turned" and J.same_coefficients(J.read(turned), J.transform(J.read(bare), "rotate 90"))
    assert J.optimize(J.write(image), 3, autorotate=2)[1] != "turned"
    odd = J.write(picture(20, 20, [(1, 1)], segments=[exif(3)]))
    assert J.optimize(odd, 3, strip=True, autorotate=2)[1] != "turned" and J.optimize(odd, 3, strip=True, autorotate=1)[1] == "turned"
    assert J.read(J.write(image) + b"tail").tail == b"tail" and J.optimize(J.write(image) + b"tail")[0].endswith(b"tail")


def test_restart_intervals_are_read():
    image = picture(32, 16, [(1, 1)])
    whole = J.write(image)
    one = [J.write(J.Jpeg(8, 8, image.tables, [J.Component(1, 1, 1, 0, blocks=image.components[0].blocks[y : y + 1, x : x + 1])], [])) for y in range(2) for x in range(4)]
    # All eight blocks under one code table, each in an interval of its own.
    scan = J._Scan((0, 63, 0, 0))
    pieces = []
    counts = {}
    for y in range(2):
        for x in range(4):
            scan = J._Scan((0, 63, 0, 0))
            scan.block(image.components[0], image.components[0].blocks[y, x].tolist(), 0, True)
            pieces.append(scan.out)
            for name, symbol, _, _ in scan.out:
                counts.setdefault(name, J.Counter())[symbol] += 1
    tables = {name: J._code_table(found) for name, found in counts.items()}
    codes = {name: found for name, (_, found) in tables.items()}
    body = b"".join(J._packed(p, codes) + (bytes([0xFF, 0xD0 + k % 8]) if k < 7 else b"") for k, p in enumerate(pieces))
    head = whole[: whole.index(b"\xff\xc4")]
    data = head + J._segment(0xDD, struct.pack(">H", 1)) + b"".join(J._segment(0xC4, bytes([kind << 4 | n]) + t) for (kind, n), (t, _) in tables.items()) + J._segment(0xDA, b"\1\1\0\0\x3f\0") + body + b"\xff\xd9"
    assert J.same_coefficients(J.read(data), image) and len(one) == 8


def test_damage_is_an_error():
    rnd = random.Random(3)
    data = J.write(picture(40, 24, [(2, 1), (1, 1), (1, 1)]), True)
    for cut in range(0, len(data) - 1, 29):
        with pytest.raises((FormatError, IndexError, struct.error)):
            J.read(data[:cut])
    for _ in range(150):
        k = rnd.randrange(len(data))
        broken = data[:k] + bytes([rnd.randrange(256)]) + data[k + 1 :]
        try:
            J.optimize(broken)
        except (FormatError, ValueError, IndexError, KeyError, struct.error, OverflowError):
            pass
    for marker in (0xC3, 0xC9):
        with pytest.raises(FormatError):
            J.read(data.replace(b"\xff\xc2", bytes([0xFF, marker])))
