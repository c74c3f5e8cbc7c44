"""Colour transfer, display normalisation and packing, as columns over linear values.

Values may be NaN or infinite; arithmetic is in double. `fin` is the only test of finiteness, because Spark orders NaN above all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def fin(c: Column | str) -> Column:
    return F.abs(d(c)) < F.lit(INFINITY)


def js_round(v: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(v + 0.5)


def clamp(v: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), v))


def clamp01(v: Column) -> Column:
    """0 where v isn't finite."""
    return F.when(fin(v), clamp(v, 0.0, 1.0)).otherwise(F.lit(0.0))


def clamp01_open(v: Column) -> Column:
    """Like clamp01, but infinities go to the nearest end and NaN stays."""
    return F.when(F.isnan(v), v).otherwise(clamp(v, 0.0, 1.0))


def luminance(r="r", g="g", b="b") -> Column:
    return 0.2126 * d(r) + 0.7152 * d(g) + 0.0722 * d(b)


def srgb_to_linear(v: Column | str) -> Column:
    v = d(v)
    return F.when(~fin(v), v).when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column | str) -> Column:
    v = d(v)
    return F.when(~fin(v), v).when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def program_srgb_to_linear(v: Column | str) -> Column:
    """The form that pixel programs use: negatives are 0, and the edge itself is on the power leg."""
    v = F.greatest(d(v), F.lit(0.0))
    return F.when(v >= 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)


def program_linear_to_srgb(v: Column | str) -> Column:
    v = F.greatest(d(v), F.lit(0.0))
    return F.when(v >= 0.0031308, 1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055).otherwise(v * 12.92)


def srgb255(v: Column | str, alpha: bool = False) -> Column:
    """0..255; alpha isn't gamma-coded; non-finite values give 0."""
    return js_round(clamp01(d(v) if alpha else linear_to_srgb(v)) * 255).cast("int")


def srgb_byte(v: Column | str) -> Column:
    v = d(v)
    return F.when(~fin(v) | (v <= 0), 0).when(v >= 1, 255).otherwise(js_round(linear_to_srgb(v) * 255)).cast("int")


def encode(v: Column | str, encoding: str, alpha: bool = False) -> Column:
    """A channel in linear, srgb or srgb255 terms."""
    return srgb255(v, alpha) if encoding == "srgb255" else linear_to_srgb(v) if encoding == "srgb" and not alpha else d(v)


def decode(v: Column | str, encoding: str, alpha: bool = False) -> Column:
    v = d(v) / 255 if encoding == "srgb255" else d(v)
    return v if encoding == "linear" or alpha else srgb_to_linear(v)


def unpremultiply(c: Column | str, a: Column | str) -> Column:
    return F.when(d(a) > 0, d(c) / F.when(d(a) > 0, d(a))).otherwise(F.lit(0.0))


def _range(low: Column, high: Column) -> Column:
    return F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)


def normalize_linear(v: Column, low: Column, high: Column) -> Column:
    return clamp01((F.when(fin(v), v).otherwise(low) - low) / _range(low, high))


def normalize_log(v: Column, low: Column, high: Column) -> Column:
    eps = F.greatest(F.lit(1e-6), F.abs(high) * 1e-6)
    bottom, top = (F.log10(F.greatest(x, F.lit(0.0)) + eps) for x in (low, high))
    return clamp01((F.log10(F.when(fin(v), F.greatest(v, F.lit(0.0))).otherwise(F.lit(0.0)) + eps) - bottom) / _range(bottom, top))


# The colours between which the ramp runs, in order.
RAMP = ((0, 0, 70), (0, 74, 255), (0, 220, 255), (0, 210, 72), (255, 238, 0), (255, 0, 0))


def color_ramp(v: Column) -> Column:
    """struct(r, g, b) of the ramp at v in 0..1."""
    at = clamp01(v) * (len(RAMP) - 1)
    k = F.least(F.lit(len(RAMP) - 2), F.floor(at)).cast("int")
    stops = [F.array(*[F.lit(float(s[c])) for s in RAMP]) for c in range(3)]
    return F.struct(*[js_round(F.get(s, k) + (F.get(s, k + 1) - F.get(s, k)) * (at - k)).cast("int").alias(n) for s, n in zip(stops, "rgb", strict=True)])


def rgbe(r="r", g="g", b="b") -> Column:
    """struct(r, g, b, e): three mantissas under a common exponent. Negatives are 0; the exponent byte stops at 255."""
    parts = [F.greatest(d(c), F.lit(0.0)) for c in (r, g, b)]
    top = F.greatest(*parts)
    none = ~fin(top) | (top < 1e-32)
    exponent = F.floor(F.log2(F.when(none, F.lit(1.0)).otherwise(top))) + 1
    scale = F.pow(F.lit(2.0), exponent - 8)
    byte = [F.when(none | ~fin(p), 0).otherwise(clamp(js_round(p / scale), 0, 255)).cast("int").alias(n) for p, n in zip(parts, "rgb", strict=True)]
    return F.struct(*byte, F.when(none, 0).otherwise(F.least(exponent + 128, F.lit(255))).cast("int").alias("e"))
