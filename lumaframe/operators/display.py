"""Pixels as bytes for display and 8-bit files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import color
from lumaframe.operators.aggregate import display_range, image_range
from lumaframe.schema import CHANNELS


def with_range(pixels: DataFrame, mode: str) -> DataFrame:
    """pixels with low and high of their image; the ranges are one row an image and Spark broadcasts them if they are small."""
    return pixels.join(display_range(image_range(pixels), mode), "image_id")


def display_bytes(pixels: DataFrame, mode: str = "rgba", auto_level: bool = False, brightness: float = 1.0, log: bool = False) -> DataFrame:
    """(image_id, y, x, r, g, b, a) as 0..255. log replaces level and gamma; alpha alone has no gamma; alpha is 255 unless mode is rgba."""
    ranged = with_range(pixels, mode) if log or auto_level else pixels
    low, high = F.col("low"), F.col("high")

    def byte(c: str) -> Column:
        v = color.d(c)
        if log:
            return color.js_round(color.normalize_log(v * brightness, low, high) * 255).cast("int")
        if auto_level:
            leveled = (v - low) * (1 / F.when(high > low, high - low)) * brightness
            v = F.when(high > low, leveled).otherwise(v * brightness)
        else:
            v = v * brightness
        return color.js_round(color.clamp01(v) * 255).cast("int") if mode == "a" else color.srgb_byte(v)

    shown = (mode,) * 3 if mode in CHANNELS else ("r", "g", "b")
    alpha = color.js_round(color.clamp01(color.d("a")) * 255).cast("int") if mode == "rgba" else F.lit(255)
    return ranged.select("image_id", "y", "x", *[byte(c).alias(n) for n, c in zip("rgb", shown, strict=True)], alpha.alias("a"))


def file_bytes(pixels: DataFrame) -> DataFrame:
    """r, g, b, a bytes of an 8-bit file: gamma, no tone mapping, alpha not multiplied in."""
    return pixels.select("image_id", "y", "x", *[color.srgb_byte(c).alias(c) for c in "rgb"], color.js_round(color.clamp01(color.d("a")) * 255).cast("int").alias("a"))
