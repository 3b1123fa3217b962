"""Colours and small numeric scales as column expressions. A colour is struct(r, g, b) of numbers 0 to 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_hex(c: Column) -> Column:
    """#RRGGBB as struct(r, g, b)."""
    part = lambda i: (F.conv(F.substring(c, i, 2), 16, 10).cast("int") / 255)
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def to_hex(rgb: Column) -> Column:
    two = lambda x: F.lpad(F.hex(F.round(x * 255).cast("long")), 2, "0")
    return F.concat(F.lit("#"), two(rgb["r"]), two(rgb["g"]), two(rgb["b"]))


def argb(c: Column) -> Column:
    """#RRGGBB as an integer with full alpha."""
    return F.conv(F.concat(F.lit("FF"), F.substring(c, 2, 6)), 16, 10).cast("long")


def from_argb(n: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex(n.bitwiseAND(0xFFFFFF)), 6, "0"))


def mix(a: Column, b: Column, share: float = 0.5) -> Column:
    """`share` of a and the rest of b."""
    return F.struct(*[(share * a[k] + (1 - share) * b[k]).alias(k) for k in "rgb"])


def hsl(rgb: Column) -> Column:
    """Hue, saturation, lightness, each 0 to 1; grey has hue 0."""
    r, g, b = rgb["r"], rgb["g"], rgb["b"]
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d, light = hi - lo, (hi + lo) / 2
    hue = F.when(d == 0, 0.0).when(hi == r, F.pmod((g - b) / d, F.lit(6.0)) / 6).when(hi == g, ((b - r) / d + 2) / 6).otherwise(((r - g) / d + 4) / 6)
    return F.struct(hue.alias("h"), F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * light - 1))).alias("s"), light.alias("l"))


def from_hsl(h: Column, s: Column, light: Column) -> Column:
    a = s * F.least(light, 1 - light)

    def part(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 12, F.lit(12.0))
        return light - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))

    return F.struct(part(0).alias("r"), part(8).alias("g"), part(4).alias("b"))


def hsv(rgb: Column) -> Column:
    """Hue, saturation, value, each 0 to 1."""
    hi, lo = F.greatest(rgb["r"], rgb["g"], rgb["b"]), F.least(rgb["r"], rgb["g"], rgb["b"])
    return F.struct(hsl(rgb)["h"].alias("h"), F.when(hi == 0, 0.0).otherwise((hi - lo) / hi).alias("s"), hi.alias("v"))


def from_hsv(h: Column, s: Column, v: Column) -> Column:
    def part(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 6, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return F.struct(part(5).alias("r"), part(3).alias("g"), part(1).alias("b"))


def with_hue_of(a: Column, b: Column) -> Column:
    """a with b's hue, by hue, saturation and value."""
    return from_hsv(hsv(b)["h"], hsv(a)["s"], hsv(a)["v"])


def with_saturation_of(a: Column, b: Column) -> Column:
    return from_hsv(hsv(a)["h"], hsv(b)["s"], hsv(a)["v"])


def with_lightness(a: Column, light: float) -> Column:
    return from_hsl(hsl(a)["h"], hsl(a)["s"], F.lit(light))


def is_dark(rgb: Column) -> Column:
    """Perceived brightness under the half: weights 299, 587, 114 of 1000 on values 0 to 255."""
    # each channel is scaled before it is weighed: k / 255 * 255 is k again, so that whole values are compared exactly
    r, g, b = (rgb[k] * 255 for k in "rgb")
    return 299 * r + 587 * g + 114 * b < 128_000


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def steps(c: Column, limits: list[tuple[float, str]], last: str) -> Column:
    """The label of the first limit that the value is under, else the last label."""
    first, *rest = limits
    return reduce(lambda w, x: w.when(c < x[0], x[1]), rest, F.when(c < first[0], first[1])).otherwise(last)


def at_least_steps(c: Column, limits: list[tuple[float, str]], last: str) -> Column:
    """The label of the first limit that the value reaches (descending limits), else the last label."""
    first, *rest = limits
    return reduce(lambda w, x: w.when(c >= x[0], x[1]), rest, F.when(c >= first[0], first[1])).otherwise(last)


def above_steps(c: Column, limits: list[tuple[float, str]], last: str) -> Column:
    """The label of the first limit that the value exceeds (descending limits), else the last label."""
    first, *rest = limits
    return reduce(lambda w, x: w.when(c > x[0], x[1]), rest, F.when(c > first[0], first[1])).otherwise(last)


def size_class(width: Column, height: Column, classes: list[tuple[str, int]], largest: str) -> Column:
    """The first class (ascending) that both sides fit, else the largest."""
    first, *rest = classes
    fits = lambda n: (width <= n) & (height <= n)
    return reduce(lambda w, x: w.when(fits(x[1]), x[0]), rest, F.when(fits(first[1]), first[0])).otherwise(largest)


def same_area(width: Column, height: Column, side: int) -> Column:
    """Width and height scaled to the area of a square of that side; smaller pictures stay."""
    ratio = F.sqrt(F.lit(float(side * side)) / (width * height))
    scaled = lambda x: F.when(ratio < 1, F.greatest(F.lit(1), F.bround(x * ratio).cast("int"))).otherwise(x)
    return F.struct(scaled(width).alias("width"), scaled(height).alias("height"))


def gigabytes(kb: Column) -> Column:
    """With one decimal; halves go to the even one, as C's printf has them, where Java's goes up."""
    return F.concat(F.format_string("%.1f", F.bround(kb / (1024 * 1024), 1)), F.lit(" GB"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
