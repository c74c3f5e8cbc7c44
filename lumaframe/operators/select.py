"""Crops, projections, alpha weighting, encodings, unions and flips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import color
from lumaframe.schema import CHANNELS, Rect, channels_of


def crop(pixels: DataFrame, rect: Rect) -> DataFrame:
    """The pixels of rect, counted from its corner. The range test reaches the scan if x and y are stored columns."""
    inside = pixels.filter(F.col("y").between(rect.y, rect.y + rect.height - 1) & F.col("x").between(rect.x, rect.x + rect.width - 1))
    return inside.withColumns({"y": F.col("y") - rect.y, "x": F.col("x") - rect.x})


def clamped_rects(rects: DataFrame) -> DataFrame:
    """rects(x, y, w, h, width, height, ...) with x, y, w, h cut to the image, one pixel at least."""
    side = lambda n, size, at: F.greatest(F.lit(1), F.least(F.when(F.coalesce(F.floor(n), F.lit(0)) == 0, 1).otherwise(F.floor(n)), size - at))
    near = lambda v, size: F.greatest(F.lit(0), F.least(size - 1, F.floor(v)))
    at = rects.withColumns({"x": near(F.col("x"), F.col("width")), "y": near(F.col("y"), F.col("height"))})
    return at.withColumns({"w": side(F.col("w"), F.col("width"), F.col("x")), "h": side(F.col("h"), F.col("height"), F.col("y"))})


def weighted(mode: str, c: str) -> Column:
    """A channel as displayed, in double: RGB times alpha in mode rgba only."""
    return color.d(c) * color.d("a") if mode == "rgba" and c != "a" else color.d(c)


def weighted_float(mode: str, c: str) -> Column:
    """The same as statistics see it: the product rounded to float."""
    return (F.col(c) * F.col("a")).cast("float") if mode == "rgba" and c != "a" else F.col(c)


def displayed(pixels: DataFrame, mode: str) -> DataFrame:
    """image_id, y, x and the channels that mode shows."""
    return pixels.select("image_id", "y", "x", *[weighted(mode, c).alias(c) for c in channels_of(mode)])


def encoded(pixels: DataFrame, mode: str, encoding: str) -> DataFrame:
    """The displayed channels in linear, srgb or srgb255 terms."""
    return pixels.select("image_id", "y", "x", *[color.encode(weighted(mode, c), encoding, c == "a").alias(c) for c in channels_of(mode)])


def swizzled(pixels: DataFrame, mode: str) -> DataFrame:
    """r, g, b, a as shown: one channel as grey, alpha 1 unless mode is rgba."""
    r, g, b = (mode,) * 3 if mode in CHANNELS else ("r", "g", "b")
    return pixels.select("image_id", "y", "x", F.col(r).alias("r"), F.col(g).alias("g"), F.col(b).alias("b"), (F.col("a") if mode == "rgba" else F.lit(1.0).cast("float")).alias("a"))


def value_of(mode: str, r="r", g="g", b="b", a="a") -> Column:
    """The scalar of a pixel: the channel, or luminance in modes rgb and rgba."""
    return color.d({"r": r, "g": g, "b": b, "a": a}[mode]) if mode in CHANNELS else color.luminance(r, g, b)


def flipped(pixels: DataFrame, height: int) -> DataFrame:
    return pixels.withColumn("y", F.lit(height - 1) - F.col("y"))


def append(*images: DataFrame) -> DataFrame:
    out = images[0]
    for more in images[1:]:
        out = out.unionByName(more)
    return out


def union_of_channels(modes: DataFrame) -> DataFrame:
    """(channels) that any of modes(mode) shows, in the order r, g, b, a."""
    shown = F.create_map(*[x for m in ("rgba", "rgb", *CHANNELS) for x in (F.lit(m), F.array(*[F.lit(c) for c in channels_of(m)]))])
    found = modes.select(F.explode(shown[F.col("mode")]).alias("c")).agg(F.collect_set("c").alias("found"))  # four letters at most
    return found.select(F.filter(F.array(*map(F.lit, CHANNELS)), lambda c: F.array_contains("found", c)).alias("channels"))


def first_sources(files: DataFrame) -> DataFrame:
    """One of the rows of files(name, type, size, last_modified) that agree in all four."""
    return files.dropDuplicates(["name", "type", "size", "last_modified"])
