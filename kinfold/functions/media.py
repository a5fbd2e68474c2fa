"""Scalar functions over media rows, all column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.constants import IMAGE_EXTENSIONS

ZERO_HASH = "0" * 16


def hash_bits(hex16: Column) -> Column:
    """The 64 bits of a hex hash as a signed long."""
    return F.conv(hex16, 16, -10).cast("bigint")


def bits_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def usable_hash(hex16: Column) -> Column:
    """All-zero hashes say nothing about likeness."""
    return hex16.isNotNull() & (hex16 != ZERO_HASH)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit longs."""
    return F.bit_count(a.bitwiseXOR(b))


def dhash(gray: Column) -> Column:
    """The difference hash of 72 gray values, eight rows of nine: a bit is set where a value exceeds its right neighbour."""
    left = lambda i: (F.floor(i / 8) * 9 + i % 8).cast("int")
    bit = lambda i: F.when(F.get(gray, left(i)) > F.get(gray, left(i) + 1), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    word = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(x))
    return F.when(F.size(gray) == 72, bits_hex(word))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap of two boxes (x, y, w, h) over their union; 0 where the union is empty."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    wide = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    high = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - wide * high
    return F.when(union > 0, wide * high / union).otherwise(F.lit(0.0))


def extension(path: Column) -> Column:
    """The lower-case ending of the file name; empty for a name that only starts with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/]([.][^./]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*(f".{e}" for e in IMAGE_EXTENSIONS))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def hsv_hex(hue: Column, saturation: float, value: float) -> Column:
    """``#rrggbb`` of a hue in [0, 1), channels cut to whole numbers."""
    sixth = hue * 6.0
    sector, part = F.floor(sixth), sixth - F.floor(sixth)
    v, p = F.lit(value), F.lit(value * (1.0 - saturation))
    q, t = value * (1.0 - saturation * part), value * (1.0 - saturation * (1.0 - part))
    faces = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    channel = lambda k: F.lower(F.lpad(F.hex(F.floor(_pick(sector % 6, [f[k] for f in faces]) * 255.0).cast("bigint")), 2, "0"))
    return F.concat(F.lit("#"), channel(0), channel(1), channel(2))


def _pick(index: Column, options: list[Column]) -> Column:
    out = options[-1]
    for k in range(len(options) - 1):
        out = F.when(index == k, options[k]).otherwise(out)
    return out


def tag_hue(name: Column) -> Column:
    """The SHA-1 of the name, as a number, modulo 360: digit by digit."""
    digits = F.transform(F.split(F.sha1(name.cast("binary")), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda acc, d: (acc * 16 + d) % 360)


def tag_color(name: Column) -> Column:
    return hsv_hex(tag_hue(name) / 360.0, 0.6, 0.9)


def fallback_color(used: Column) -> Column:
    """A person's colour once the palette is used up, from the number of colours in use."""
    return hsv_hex((used * 47) % 360 / 360.0, 0.65, 0.85)


def coordinates_text(lat: Column, lon: Column) -> Column:
    return F.format_string("%.5f, %.5f", lat, lon)


def full_coordinates(lat: Column, lon: Column) -> Column:
    return F.concat(lat.cast("string"), F.lit(", "), lon.cast("string"))


def map_url(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("https://www.openstreetmap.org/?mlat="), lat.cast("string"), F.lit("&mlon="), lon.cast("string"))


def thumbnail_key(path: Column, mtime_text: Column, side: int) -> Column:
    """The cache name of a thumbnail; ``mtime_text`` is the file time as it is to be printed."""
    return F.sha1(F.concat_ws(":", path, mtime_text, F.lit(str(side))).cast("binary"))


def rescale(length: Column, original: Column, shown: Column) -> Column:
    """A length of the original picture in the shown one; unchanged if the original has no size."""
    return length * F.when(original == 0, F.lit(1.0)).otherwise(shown / original)


def truthy(text: Column) -> Column:
    """Whether a setting's text means yes."""
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("1", "true", "yes", "on")


def user_text(text: Column) -> Column:
    """Trimmed input; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))
