"""Sizes of images from their first bytes, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Longest edge and most tokens of a tier, side of a patch.
HIGH, STANDARD = (2576, 4784), (1568, 1568)
PATCH = 28


def _number(data: Column, at, size: int = 1) -> Column:
    """Big-endian number of ``size`` bytes from a position that counts from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(data.substr((at + 1).cast("int"), F.lit(size))), 16, 10).cast("long")


def _little(data: Column, at: int, size: int) -> Column:
    return sum((_number(data, at + i) * (1 << 8 * i) for i in range(1, size)), _number(data, at))


def _jpeg(data: Column) -> Column:
    """Width and height by a walk over segments: a step moves on by a byte, a bare marker or a segment, until the frame."""
    pair = "struct<at: bigint, width: bigint, height: bigint>"
    start = F.struct(F.lit(2).cast("long").alias("at"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height")).cast(pair)

    def step(a: Column, _: Column) -> Column:
        at, mark = a["at"], _number(data, a["at"] + 1)
        bare = mark.isin(0xD8, 0x01) | mark.between(0xD0, 0xD7)
        frame = mark.between(0xC0, 0xCF) & ~mark.isin(0xC4, 0xC8, 0xCC)
        move = lambda to: F.struct(to.alias("at"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height")).cast(pair)
        found = F.struct(at.alias("at"), _number(data, at + 7, 2).alias("width"), _number(data, at + 5, 2).alias("height")).cast(pair)
        done = a["width"].isNotNull() | (at + 9 >= F.length(data))
        return F.when(done, a).when(_number(data, at) != 0xFF, move(at + 1)).when(bare, move(at + 2)).when(frame, found).otherwise(move(at + 2 + _number(data, at + 2, 2)))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(data))), start, step)


def image_size(data: Column) -> Column:
    """struct(width, height, format) of PNG, GIF, WebP or JPEG bytes, else null. The head of a file will do."""
    starts = lambda at, hexed: F.hex(data.substr(F.lit(at + 1), F.lit(len(hexed) // 2))) == hexed
    size = lambda w, h, kind: F.struct(w.alias("width"), h.alias("height"), F.lit(kind).alias("format"))
    webp = starts(0, b"RIFF".hex().upper()) & starts(8, b"WEBP".hex().upper()) & (F.length(data) >= 30)
    walked = F.when(starts(0, "FFD8"), _jpeg(data))
    jpeg = F.when(walked["width"].isNotNull(), size(walked["width"], walked["height"], "jpeg"))
    return F.when(F.length(data) < 24, None).otherwise(
        F.when(starts(0, b"\x89PNG\r\n\x1a\n".hex().upper()), size(_number(data, 16, 4), _number(data, 20, 4), "png"))
        .when(starts(0, b"GIF87a".hex().upper()) | starts(0, b"GIF89a".hex().upper()), size(_little(data, 6, 2), _little(data, 8, 2), "gif"))
        .when(webp & starts(12, b"VP8X".hex().upper()), size(_little(data, 24, 3) + 1, _little(data, 27, 3) + 1, "webp"))
        .when(webp & starts(12, b"VP8 ".hex().upper()), size(_little(data, 26, 2) % 16384, _little(data, 28, 2) % 16384, "webp"))
        .otherwise(jpeg)
    )


def image_tokens(width: Column, height: Column, high: bool = True) -> Column:
    """Patches of an image after it is scaled to the tier's longest edge and, by area, to its most tokens; 0 without a size."""
    edge, most = HIGH if high else STANDARD
    scaled = lambda n, by: F.greatest(F.lit(1), F.floor(n * by)).cast("long")
    patches = lambda w, h: F.ceil(w / PATCH) * F.ceil(h / PATCH)
    longest = F.greatest(width, height)
    w, h = (F.when(longest > edge, scaled(n, F.lit(float(edge)) / longest)).otherwise(n) for n in (width, height))
    by = F.sqrt(F.lit(float(most)) / patches(w, h))
    fitted = F.when(patches(w, h) > most, F.least(F.lit(most), patches(scaled(w, by), scaled(h, by)))).otherwise(patches(w, h))
    return F.when((width > 0) & (height > 0), fitted).otherwise(0).cast("long")
