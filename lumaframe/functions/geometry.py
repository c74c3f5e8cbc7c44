"""View geometry as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_scale(view_w: Column, view_h: Column, width: Column, height: Column) -> Column:
    return F.greatest(F.lit(0.01), F.least(view_w / width, view_h / height) * 0.94)


def zoomed(scale: Column, offset: Column, at: Column, wanted: Column) -> Column:
    """struct(scale, offset) after zooming about a point of the view to the wanted scale, which is kept in 0.01..256."""
    new = F.least(F.lit(256.0), F.greatest(F.lit(0.01), wanted))
    return F.struct(new.alias("scale"), (at - (at - offset) / scale * new).alias("offset"))


def pixel_at(view: Column, offset: Column, scale: Column, size: Column) -> Column:
    """The pixel under a view coordinate, null outside."""
    k = F.floor((view - offset) / scale)
    return F.when((k >= 0) & (k < size), k)


def pixel_near(view: Column, offset: Column, scale: Column, size: Column) -> Column:
    """The pixel under or next to a view coordinate."""
    return F.greatest(F.lit(0), F.least(size - 1, F.floor((view - offset) / scale)))


def projected(x: Column, y: Column, z: Column, yaw: float = -0.72, pitch: float = 0.92) -> Column:
    """struct(x, y, depth) of a point of the graph turned about the vertical axis and tilted."""
    cy, sy, cp, sp = (f(F.lit(a)) for a in (yaw, pitch) for f in (F.cos, F.sin))
    back = x * sy + y * cy
    return F.struct((x * cy - y * sy).alias("x"), (back * cp - z * sp).alias("y"), back.alias("depth"))


def needs_side(value: Column, neighbour: Column) -> Column:
    """Whether two steps of a stepped surface differ enough for a face between them."""
    return F.abs(neighbour - value) > 1e-12


def quad_mean(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a + b + c + d) / 4


def painted(faces: DataFrame) -> DataFrame:
    """faces in the order in which they are drawn: by depth, ascending."""
    return faces.orderBy("depth")
