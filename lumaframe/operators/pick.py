"""Pickers: point look-ups, numbers, colours, toggling, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import color
from lumaframe.functions.text import csv_cell, format_number, mode_label
from lumaframe.operators.select import swizzled, weighted
from lumaframe.schema import CHANNELS, MOST_PICKERS, channels_of

# The colours of pickers, in order.
PICKER_COLORS = (
    "#ff365e", "#35d0ff", "#ffe156", "#69f28d", "#c77dff",
    "#ff9f1c", "#2ec4b6", "#f15bb5", "#b8f35a", "#4d96ff",
    "#ff6b6b", "#9bf6ff", "#fdffb6", "#caffbf", "#bdb2ff",
    "#ffc6ff", "#00f5d4", "#f7b801", "#a1ff0a", "#ff70a6",
)


def _few(pickers: DataFrame) -> DataFrame:
    """pickers, after a look that there are no more than all images may have together; so it may be broadcast."""
    if pickers.limit(MOST_PICKERS + 1).count() > MOST_PICKERS:
        raise ValueError(f"There may be {MOST_PICKERS} pickers at most.")
    return F.broadcast(pickers)


def picker_values(pixels: DataFrame, pickers: DataFrame, mode: str = "rgba") -> DataFrame:
    """pickers(picker_id, image_id, x, y) with the displayed channels of their pixels."""
    found = pixels.join(_few(pickers), ["image_id", "y", "x"])
    return found.select("picker_id", "image_id", "x", "y", *[weighted(mode, c).alias(c) for c in CHANNELS])


def next_id(pickers: DataFrame) -> DataFrame:
    """(picker_id): the smallest number from 1 on that no picker has."""
    free = pickers.sparkSession.range(1, MOST_PICKERS + 2).select(F.col("id").alias("picker_id"))
    return free.join(pickers.select(F.col("picker_id").cast("long").alias("picker_id")), "picker_id", "left_anti").agg(F.min("picker_id").alias("picker_id"))


def next_color(pickers: DataFrame) -> DataFrame:
    """(color): the first colour that no picker has, or the first of all."""
    palette = pickers.sparkSession.createDataFrame(list(enumerate(PICKER_COLORS)), "k int, color string")
    free = palette.join(pickers.select("color"), "color", "left_anti").agg(F.min_by("color", "k").alias("color"))
    return free.select(F.coalesce("color", F.lit(PICKER_COLORS[0])).alias("color"))


def toggled(pickers: DataFrame, at: DataFrame) -> DataFrame:
    """pickers with those of at(picker_id, image_id, x, y, ...) added, or taken away where one stands there already."""
    key = ["image_id", "x", "y"]
    return pickers.join(at, key, "left_anti").select(*pickers.columns).unionByName(at.join(pickers, key, "left_anti").select(*pickers.columns))


def removed(pickers: DataFrame, *picker_ids: int) -> DataFrame:
    """pickers without those of the numbers; a picker without a number stays."""
    return pickers.filter(~F.coalesce(F.col("picker_id").isin(*picker_ids), F.lit(False)))


def cleared(pickers: DataFrame, image_id: str) -> DataFrame:
    """pickers without those of an image."""
    return pickers.filter(~F.col("image_id").eqNullSafe(F.lit(image_id)))


def of_images(images: DataFrame) -> DataFrame:
    """(image_id, picker_id, x, y, color) of images(image_id, pickers array of structs): one row for each picker of any image."""
    return images.select("image_id", F.explode("pickers").alias("p")).select("image_id", "p.picker_id", "p.x", "p.y", "p.color")


def largest_id(pickers: DataFrame) -> DataFrame:
    """(picker_id): the largest number that a picker has, 0 if there is none."""
    return pickers.agg(F.coalesce(F.max("picker_id"), F.lit(0)).alias("picker_id"))


def css_color(pixels: DataFrame, mode: str) -> DataFrame:
    """(image_id, y, x, css): the colour in which a display mode shows each pixel."""
    parts = [color.encode(F.col(c), "srgb255", False).cast("string") for c in "rgb"]
    return swizzled(pixels, mode).select("image_id", "y", "x", F.concat(F.lit("rgb("), F.concat_ws(" ", *parts), F.lit(")")).alias("css"))


def inside(pickers: DataFrame, images: DataFrame) -> DataFrame:
    """pickers that stand within images(image_id, width, height)."""
    return pickers.join(images, "image_id").filter("x < width AND y < height").select(*pickers.columns)


def pixel_text(c: Column, encoding: str) -> Column:
    return c.cast("string") if encoding == "srgb255" else format_number(c)


def picker_csv(pixels: DataFrame, pickers: DataFrame, images: DataFrame, mode: str, encoding: str) -> DataFrame:
    """(picker_id, line) of the CSV whose header is csv_header(); images(image_id, name)."""
    values = picker_values(pixels, pickers, mode).join(images.select("image_id", "name"), "image_id")
    cells = [pixel_text(color.encode(c, encoding, c == "a"), encoding) for c in channels_of(mode)]
    line = F.concat_ws(",", csv_cell(F.concat(F.lit("P"), F.col("picker_id").cast("string"))), csv_cell("name"), F.col("x").cast("string"), F.col("y").cast("string"), F.lit(encoding), mode_label(F.lit(mode)), *cells)
    return values.select("picker_id", line.alias("line"))


def picker_tuples(pixels: DataFrame, pickers: DataFrame, mode: str, encoding: str) -> DataFrame:
    """(picker_id, line): the values alone."""
    cells = [pixel_text(color.encode(c, encoding, c == "a"), encoding) for c in channels_of(mode)]
    return picker_values(pixels, pickers, mode).select("picker_id", F.concat_ws(",", *cells).alias("line"))


def csv_header(mode: str) -> str:
    return ",".join(["id", "image", "x", "y", "mode", "display", *channels_of(mode)])


def rect_join(pixels: DataFrame, rects: DataFrame) -> DataFrame:
    """pixels joined to each of rects(rect_id, image_id, x, y, width, height) that holds them, counted from its corner.

    A rectangle is cut into the rows it covers, so the join is on equal image and row; x decides within a row.
    """
    rows = rects.select("rect_id", "image_id", F.col("x").alias("x0"), F.col("y").alias("y0"), "width", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("height") - 1)).alias("row"))
    found = pixels.join(rows.withColumnRenamed("row", "y"), ["image_id", "y"]).filter("x BETWEEN x0 AND x0 + width - 1")
    return found.select("rect_id", "image_id", (F.col("y") - F.col("y0")).cast("int").alias("y"), (F.col("x") - F.col("x0")).cast("int").alias("x"), *CHANNELS)
