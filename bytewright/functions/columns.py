"""Byte-level column expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big_endian(data: Column, at: int, size: int) -> Column:
    """An unsigned integer of ``size`` bytes at byte ``at`` (from 0)."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("long")


def little_endian(data: Column, at: int, size: int) -> Column:
    text = F.concat(*[F.hex(F.substring(data, at + k + 1, 1)) for k in reversed(range(size))])
    return F.conv(text, 16, 10).cast("long")


def detect_format(data: Column) -> Column:
    """``png``, ``jpeg``, ``gzip``, ``zip`` or ``unknown``, by magic bytes."""
    head = F.hex(F.substring(data, 1, 8))
    return F.when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("1F8B08"), "gzip").when(head.startswith("504B0304"), "zip").otherwise("unknown")


def extension(path: Column) -> Column:
    """What follows the last dot of the last path component; empty without a dot."""
    return F.regexp_extract(path, r"\.([^./?#]*)$", 1)


def format_by_extension(path: Column) -> Column:
    """Exact spellings only: mixed case is no image."""
    ext = extension(path)
    return F.when(ext.isin("png", "PNG"), "png").when(ext.isin("jpg", "JPG", "jpeg", "JPEG"), "jpeg").otherwise("")


def gzip_class(data: Column) -> Column:
    """``none``, ``gzip``, ``extras`` or ``error``, from the header's flags."""
    flags = big_endian(data, 3, 1)
    return (
        F.when(F.hex(F.substring(data, 1, 3)) != "1F8B08", "none")
        .when((F.length(data) < 10) | (flags.bitwiseAND(0x20) != 0), "error")
        .when(flags.bitwiseAND(0x14) != 0, "extras")
        .otherwise("gzip")
    )


def gzip_fields(data: Column) -> Column:
    """A struct of the fixed header and trailer fields."""
    tail = F.substring(data, -8, 8)
    return F.struct(big_endian(data, 3, 1).alias("flags"), little_endian(data, 4, 4).alias("mtime"), big_endian(data, 8, 1).alias("xfl"), big_endian(data, 9, 1).alias("os"), little_endian(tail, 0, 4).alias("crc32"), little_endian(tail, 4, 4).alias("isize"))


def png_fields(data: Column) -> Column:
    """A struct of the IHDR fields; ``crc_ok`` compares its checksum."""
    return F.struct(
        big_endian(data, 16, 4).alias("width"),
        big_endian(data, 20, 4).alias("height"),
        big_endian(data, 24, 1).alias("bitdepth"),
        big_endian(data, 25, 1).alias("colortype"),
        big_endian(data, 28, 1).alias("interlace"),
        (F.crc32(F.substring(data, 13, 17)) == big_endian(data, 29, 4)).alias("crc_ok"),
    )


def valid_png_mode(color: Column, depth: Column) -> Column:
    return ((color == 0) & depth.isin(1, 2, 4, 8, 16)) | ((color == 3) & depth.isin(1, 2, 4, 8)) | (color.isin(2, 4, 6) & depth.isin(8, 16))


def png_bits_per_pixel(color: Column, depth: Column) -> Column:
    return depth * F.when(color == 2, 3).when(color == 4, 2).when(color == 6, 4).otherwise(1)


def png_raw_size(width: Column, height: Column, bits: Column) -> Column:
    """Bytes of the filtered scanlines of a non-interlaced image."""
    return height * (1 + F.floor((width * bits + 7) / 8))


def dos_date(ts: Column) -> Column:
    """The DOS date word in UTC; years outside 1980 to 2107 are clamped."""
    y = F.year(ts)
    return F.when(y < 1980, 0x21).when(y > 2107, 0xFF9F).otherwise(F.shiftleft(y - 1980, 9) + F.shiftleft(F.month(ts), 5) + F.dayofmonth(ts)).cast("long")


def dos_time(ts: Column) -> Column:
    """The DOS time word, in steps of two seconds."""
    y = F.year(ts)
    words = F.shiftleft(F.hour(ts), 11) + F.shiftleft(F.minute(ts), 5) + F.floor(F.second(ts) / 2)
    return F.when(y < 1980, 0).when(y > 2107, 0xBF7D).otherwise(words).cast("long")


def valid_archive_name(name: Column) -> Column:
    return ~name.rlike(r"^/|[\\:]") & (F.length(name) > 0)


def length_symbol(n: Column) -> Column:
    """DEFLATE's symbol of a match length from 3 to 258."""
    k = n - 3
    bits = F.greatest(F.floor(F.log2(F.greatest(k, F.lit(1)))) - 2, F.lit(0))
    return F.when(n == 258, 285).otherwise(257 + 4 * bits + F.floor(k / F.pow(F.lit(2.0), bits))).cast("int")


def length_extra_bits(n: Column) -> Column:
    k = n - 3
    return F.when(n == 258, 0).otherwise(F.greatest(F.floor(F.log2(F.greatest(k, F.lit(1)))) - 2, F.lit(0))).cast("int")


def distance_symbol(n: Column) -> Column:
    """DEFLATE's symbol of a distance from 1 to 32768."""
    k = n - 1
    bits = F.greatest(F.floor(F.log2(F.greatest(k, F.lit(1)))) - 1, F.lit(0))
    return (2 * bits + F.floor(k / F.pow(F.lit(2.0), bits))).cast("int")


def distance_extra_bits(n: Column) -> Column:
    return F.greatest(F.floor(F.log2(F.greatest(n - 1, F.lit(1)))) - 1, F.lit(0)).cast("int")


def adam7_pass(x: Column, y: Column) -> Column:
    """The interlace pass (1 to 7) that stores a pixel."""
    return (
        F.when((x % 8 == 0) & (y % 8 == 0), 1)
        .when((x % 8 == 4) & (y % 8 == 0), 2)
        .when((x % 4 == 0) & (y % 8 == 4), 3)
        .when((x % 4 == 2) & (y % 4 == 0), 4)
        .when((x % 2 == 0) & (y % 4 == 2), 5)
        .when((x % 2 == 1) & (y % 2 == 0), 6)
        .otherwise(7)
    )


def paeth(a: Column, b: Column, c: Column) -> Column:
    """The predictor of left, above and corner; ties go to the left, then above."""
    p = a + b - c
    pa, pb, pc = F.abs(p - a), F.abs(p - b), F.abs(p - c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def required_bits(value: Column) -> Column:
    """Bits a gray sample of 8 bits needs, by divisibility."""
    return F.when(value % 255 == 0, 1).when(value % 85 == 0, 2).when(value % 17 == 0, 4).otherwise(8)


def rgb_key(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16) + F.shiftleft(g, 8) + b


def msb_key(r: Column, g: Column, b: Column) -> Column:
    """The bits of three samples interleaved, highest first."""
    out = F.lit(0)
    for bit in range(8):
        for k, v in enumerate((r, g, b)):
            out = out + F.shiftleft(F.shiftright(v, bit).bitwiseAND(1), 3 * bit + 2 - k)
    return out


def human_size(size: Column) -> Column:
    """Divided by 1024 while above 1024, with K, M or G."""
    return F.when(size > 1 << 30, F.concat(F.format_number(size / (1 << 30), 3), F.lit("G"))).when(size > 1 << 20, F.concat(F.format_number(size / (1 << 20), 3), F.lit("M"))).when(size > 1 << 10, F.concat(F.format_number(size / (1 << 10), 3), F.lit("K"))).otherwise(size.cast("string"))
