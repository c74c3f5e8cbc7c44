"""Procedural images and pointwise programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions.color import d, luminance
from lumaframe.schema import PROGRAM_PIXELS


def canvas(spark: SparkSession, width: int, height: int, image_id: str = "generated") -> DataFrame:
    """(image_id, y, x, u, v): every pixel of an image, with its centre in 0..1 from the top left."""
    if width * height > PROGRAM_PIXELS:
        raise ValueError(f"A program may have {PROGRAM_PIXELS} pixels at most.")
    grid = spark.range(width * height).select(F.lit(image_id).alias("image_id"), F.expr(f"cast(id div {width} AS int)").alias("y"), F.expr(f"cast(id % {width} AS int)").alias("x"))
    return grid.withColumns({"u": (F.col("x") + 0.5) / width, "v": (F.col("y") + 0.5) / height})


def _out(df: DataFrame, r, g, b, a) -> DataFrame:
    return df.select("image_id", "y", "x", *[(c if isinstance(c, Column) else F.lit(c)).cast("float").alias(n) for n, c in zip("rgba", (r, g, b, a), strict=True)])


def _grey(df: DataFrame, v: Column) -> DataFrame:
    return _out(df, v, v, v, 1.0)


def _centred(width: int, height: int) -> tuple[Column, Column]:
    return (F.col("u") - 0.5) * (width / height), F.col("v") - 0.5


def gradient(spark: SparkSession, width: int, height: int) -> DataFrame:
    return _out(canvas(spark, width, height), F.col("u"), F.col("v"), 0.0, 1.0)


def radial_light(spark: SparkSession, width: int, height: int) -> DataFrame:
    cx, cy = _centred(width, height)
    return _grey(canvas(spark, width, height), 40.0 / (1.0 + (cx * cx + cy * cy) * 900.0))


def cosine_stripes(spark: SparkSession, width: int, height: int, count: float = 24.0, degrees: float = 20.0) -> DataFrame:
    cx, cy = _centred(width, height)
    angle = F.radians(F.lit(degrees))
    return _grey(canvas(spark, width, height), 0.5 + 0.5 * F.cos((cx * F.cos(angle) + cy * F.sin(angle)) * (count * 6.28318530718)))


def exposure(pixels: DataFrame, stops: float = 1.0) -> DataFrame:
    k = 2.0**stops
    return _out(pixels, *[d(c) * k for c in "rgb"], F.col("a"))


def brightness(pixels: DataFrame, factor: float) -> DataFrame:
    """Factors that aren't positive numbers count as 1."""
    k = factor if factor == factor and 0 < factor < float("inf") else 1.0
    return _out(pixels, *[d(c) * k for c in "rgb"], F.col("a"))


def grayscale(pixels: DataFrame) -> DataFrame:
    lum = luminance()
    return _out(pixels, lum, lum, lum, F.col("a"))


def bgra(pixels: DataFrame) -> DataFrame:
    return _out(pixels, F.col("b"), F.col("g"), F.col("r"), F.col("a"))
