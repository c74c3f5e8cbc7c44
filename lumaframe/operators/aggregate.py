"""Statistics that skip non-finite values, pooled grids, sample grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions.color import d, fin, luminance
from lumaframe.operators.select import value_of, weighted, weighted_float
from lumaframe.schema import CHANNELS, GRID_SIZE, Rect


def _of_finite(how, v: Column) -> Column:
    return F.coalesce(how(F.when(fin(v), d(v))), F.lit(0.0))


def image_range(pixels: DataFrame) -> DataFrame:
    """min_r..max_a, rgb_min, rgb_max of each image; a channel without finite values counts as 0."""
    ends = [_of_finite(how, F.col(c)).alias(f"{name}_{c}") for name, how in (("min", F.min), ("max", F.max)) for c in CHANNELS]
    return pixels.groupBy("image_id").agg(*ends).withColumns({"rgb_min": F.least("min_r", "min_g", "min_b"), "rgb_max": F.greatest("max_r", "max_g", "max_b")})


def display_range(ranges: DataFrame, mode: str) -> DataFrame:
    """(image_id, low, high) by which a mode is normalised."""
    low, high = (f"min_{mode}", f"max_{mode}") if mode in CHANNELS else ("rgb_min", "rgb_max")
    return ranges.select("image_id", F.col(low).alias("low"), F.col(high).alias("high"))


def selection_stats(pixels: DataFrame, mode: str = "rgb") -> DataFrame:
    """count of all pixels, and min, max, avg of each channel and of luminance over finite values, for each image. mode rgba weights by alpha."""
    values = pixels.select("image_id", *[weighted_float(mode, c).alias(c) for c in CHANNELS]).withColumn("lum", luminance())
    out = [_of_finite(how, F.col(c)).alias(f"{name}_{c}") for name, how in (("min", F.min), ("max", F.max), ("avg", F.avg)) for c in (*CHANNELS, "lum")]
    return values.groupBy("image_id").agg(F.count("*").alias("count"), *out)


def mode_stats(stats: DataFrame, mode: str) -> DataFrame:
    """(image_id, low, high, mean) of what a mode graphs."""
    c = mode if mode in CHANNELS else "lum"
    return stats.select("image_id", F.col(f"min_{c}").alias("low"), F.col(f"max_{c}").alias("high"), F.col(f"avg_{c}").alias("mean"))


def pooled_grid(pixels: DataFrame, width: int, height: int, most: int = GRID_SIZE, mode: str = "rgb") -> DataFrame:
    """(image_id, grid_y, grid_x, r, g, b, a): means over finite values of the boxes of an image of this size, as float; 0 for none."""
    bin_of = lambda c, n: F.expr(f"({c} * {min(most, n)}L) div {n}L")
    binned = pixels.select("image_id", bin_of("y", height).alias("grid_y"), bin_of("x", width).alias("grid_x"), *[weighted_float(mode, c).alias(c) for c in CHANNELS])
    return binned.groupBy("image_id", "grid_y", "grid_x").agg(*[_of_finite(F.avg, F.col(c)).cast("float").alias(c) for c in CHANNELS])


def graph_values(grid: DataFrame, mode: str) -> DataFrame:
    """(image_id, grid_y, grid_x, value): luminance is taken of the means."""
    return grid.select("image_id", "grid_y", "grid_x", value_of(mode).alias("value"))


def extent(values: DataFrame, c: str = "value") -> DataFrame:
    """(image_id, low, high) of finite values."""
    return values.groupBy("image_id").agg(_of_finite(F.min, F.col(c)).alias("low"), _of_finite(F.max, F.col(c)).alias("high"))


def sample_places(spark, rect: Rect, most: int = GRID_SIZE, dragging: bool = False) -> DataFrame:
    """(row, col, y, x): the points that a graph of rect samples, at most `most` an axis; all of a small rectangle."""
    stepped = not dragging and rect.width <= most and rect.height <= most
    cols, rows = (rect.width, rect.height) if stepped else (max(2, min(most, rect.width)), max(2, min(most, rect.height)))
    at = lambda k, n, m: F.when(F.lit(m) <= 1, 0).otherwise(F.floor(F.lit(float(n - 1)) * (k / max(m - 1, 1)) + 0.5)).cast("int")
    grid = spark.range(rows * cols).select(F.expr(f"cast(id div {cols} AS int)").alias("row"), F.expr(f"cast(id % {cols} AS int)").alias("col"))
    return grid.withColumns({"y": at(F.col("row"), rect.height, rows) + rect.y, "x": at(F.col("col"), rect.width, cols) + rect.x})


def strided_samples(pixels: DataFrame, rect: Rect, mode: str, most: int = GRID_SIZE, dragging: bool = False) -> DataFrame:
    """(image_id, row, col, value) at the sample places of rect."""
    places = sample_places(pixels.sparkSession, rect, most, dragging)  # most * most rows at most
    shown = [weighted(mode, c).alias(c) for c in CHANNELS]
    return pixels.join(F.broadcast(places), ["y", "x"]).select("image_id", "row", "col", *shown).select("image_id", "row", "col", value_of(mode).alias("value"))


def default_settings(pixels: DataFrame, source_format: str) -> DataFrame:
    """(image_id, channel, auto_level): rgba if any alpha is above 0; level is automatic for hdr and exr."""
    top = image_range(pixels).select("image_id", F.when(F.col("max_a") > 0, "rgba").otherwise("rgb").alias("channel"))
    return top.withColumn("auto_level", F.lit(source_format in ("hdr", "exr")))
