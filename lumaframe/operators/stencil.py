"""Neighbourhood operators: clamped neighbours by windows, separable blurs, edges, bilinear resampling, free programs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions.color import d, luminance
from lumaframe.schema import CHANNELS, PIXELS, PROGRAM_PIXELS


def along_x():
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_y():
    return Window.partitionBy("image_id", "x").orderBy("y")


def neighbour(c: Column, k: int, along) -> Column:
    """The value k pixels on, or the border's."""
    if k == 0:
        return c
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lag(c, -k).over(along), F.first(c).over(whole)) if k < 0 else F.coalesce(F.lead(c, k).over(along), F.last(c).over(whole))


def _sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def blur_3(pixels: DataFrame) -> DataFrame:
    """Mean of each pixel and its neighbours left and right, in double."""
    return pixels.select("image_id", "y", "x", *[(_sum([neighbour(d(c), k, along_x()) for k in (-1, 0, 1)]) / 3).alias(c) for c in CHANNELS])


def box_blur(pixels: DataFrame, radius: int = 2) -> DataFrame:
    """Mean of the (2 * radius + 1)^2 pixels around, with borders repeated: sums along rows, then along columns."""
    reach, n = range(-radius, radius + 1), float((2 * radius + 1) ** 2)
    rows = pixels.select("image_id", "y", "x", *[_sum([neighbour(d(c), k, along_x()) for k in reach]).alias(c) for c in CHANNELS])
    return rows.select("image_id", "y", "x", *[(_sum([neighbour(F.col(c), k, along_y()) for k in reach]) / n).alias(c) for c in CHANNELS])


def sobel(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, edge, a): the length of the luminance gradient."""
    lum = pixels.select("image_id", "y", "x", "a", luminance().alias("l"))
    at = lambda k: neighbour(F.col("l"), k, along_x())
    rows = lum.select("image_id", "y", "x", "a", (at(1) - at(-1)).alias("dx"), (at(-1) + 2 * F.col("l") + at(1)).alias("sx"))
    gx = neighbour(F.col("dx"), -1, along_y()) + 2 * F.col("dx") + neighbour(F.col("dx"), 1, along_y())
    gy = neighbour(F.col("sx"), 1, along_y()) - neighbour(F.col("sx"), -1, along_y())
    return rows.select("image_id", "y", "x", gx.alias("gx"), gy.alias("gy"), "a").select("image_id", "y", "x", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("edge"), "a")


def sampled(points: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """points(image_id, u, v, ...) with r, g, b, a read between pixel centres, places outside 0..1 pulled to the border.

    Each point asks for its four pixels; one equi-join and one sum of weighted values answer. Equal points are summed together and
    then given back as often as they were asked for.
    """
    fx, fy = (F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))) * n - 0.5 for c, n in (("u", width), ("v", height)))
    # The caller's columns go along in a struct, so that none of their names clashes with a helper's.
    asked = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("point"), fx.alias("fx"), fy.alias("fy"))
    corner = []
    for dy in (0, 1):
        for dx in (0, 1):
            tx, ty = (F.col(c) - F.floor(c) for c in ("fx", "fy"))
            at = lambda c, k, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c) + k)).cast("int")
            corner.append(F.struct(at("fy", dy, height).alias("y"), at("fx", dx, width).alias("x"), ((tx if dx else 1 - tx) * (ty if dy else 1 - ty)).alias("w")))
    asked = asked.select("point", F.explode(F.array(*corner)).alias("c")).select("point", "c.y", "c.x", "c.w")
    source = pixels.select(F.col("image_id").alias("id"), F.col("y").alias("py"), F.col("x").alias("px"), *[d(c).alias(c) for c in CHANNELS])
    found = asked.join(source, (F.col("point.image_id") == F.col("id")) & (F.col("y") == F.col("py")) & (F.col("x") == F.col("px")))
    times = F.count("*") / 4
    sums = found.groupBy("point").agg(*[(F.sum(F.col("w") * F.col(c)) / times).alias(c) for c in CHANNELS], times.cast("int").alias("times"))
    return sums.select("point", *CHANNELS, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("k")).select("point.*", *CHANNELS)


def resampled(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """The image at another size, bilinear."""
    for w, h in ((width, height), (to_width, to_height)):
        if w * h > PROGRAM_PIXELS:
            raise ValueError(f"A program may have {PROGRAM_PIXELS} pixels at most.")
    rows = pixels.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(to_height - 1))).alias("y"))
    points = rows.select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(to_width - 1))).alias("x"))
    points = points.withColumns({"u": (F.col("x") + 0.5) / to_width, "v": (F.col("y") + 0.5) / to_height})
    return sampled(points, pixels, width, height).select("image_id", "y", "x", *CHANNELS)


def mapped(pixels: DataFrame, **channels: str | Column) -> DataFrame:
    """A pixel program of column expressions over u, v, r, g, b, a, x, y, width, height; a channel that isn't given is 0, alpha 1."""
    known = pixels
    if {"u", "v", "width", "height"} & _names(channels):
        # One row for each image, so that the pixels of a large image needn't meet in one task.
        sizes = pixels.groupBy(F.col("image_id").alias("__image")).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
        known = pixels.drop("width", "height").join(sizes, F.col("image_id").eqNullSafe(F.col("__image"))).drop("__image")
    if known is not pixels:
        known = known.withColumns({"u": (F.col("x") + 0.5) / F.col("width"), "v": (F.col("y") + 0.5) / F.col("height")})
    value = lambda c: F.lit(1.0 if c == "a" else 0.0) if c not in channels else F.expr(channels[c]) if isinstance(channels[c], str) else channels[c]
    return known.select("image_id", "y", "x", *[value(c).cast("float").alias(c) for c in CHANNELS])


def _names(channels: dict) -> set[str]:
    """Words of the expressions, to see whether an image's size is asked for; a Column may name anything."""
    import re

    return {w for e in channels.values() for w in (re.findall(r"\w+", e) if isinstance(e, str) else ("u",))}


def applied(pixels: DataFrame, program: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A program over whole images: a float32 array (height, width, 4) to another. One image of at most PROGRAM_PIXELS is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        if h * w > PROGRAM_PIXELS:
            raise ValueError(f"A program may have {PROGRAM_PIXELS} pixels at most.")
        image = np.zeros((h, w, 4), np.float32)
        image[pdf["y"], pdf["x"]] = pdf[list(CHANNELS)].to_numpy(np.float32)
        out = np.asarray(program(image), np.float32)
        y, x = np.indices(out.shape[:2])
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32)} | {c: out[..., k].ravel() for k, c in enumerate(CHANNELS)})

    return pixels.groupBy("image_id").applyInPandas(run, PIXELS)
