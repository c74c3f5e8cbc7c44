"""The surface of a graph of values: faces of a grid, their places in the view, their colours, and the order in which they are painted.

A grid is a table (image_id, grid_y, grid_x, value), a row for each cell, of images of any number and any size, as pooled_grid and graph_values give it.
Faces come from equi-joins of neighbours, corners and depths are columns.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions import color
from lumaframe.functions.geometry import needs_side, projected, quad_mean

# Sides of the drawn box (the longer one; the shorter one at least; upright) and the view's angles; opacities of faces.
LONG_SIDE, SHORT_SIDE, UPRIGHT, YAW, PITCH = 1.7, 0.42, 0.78, -0.72, 0.92
TOP_ALPHA, SIDE_ALPHA = 1.0, 0.72
CELL = ["image_id", "grid_y", "grid_x"]


def grid_sizes(grid: DataFrame) -> DataFrame:
    """(image_id, columns, lines, low, high) of each grid; low and high are of finite values, 0 without any."""
    finite = F.when(color.fin(F.col("value")), F.col("value"))
    return grid.groupBy("image_id").agg((F.max("grid_x") + 1).alias("columns"), (F.max("grid_y") + 1).alias("lines"), F.coalesce(F.min(finite), F.lit(0.0)).alias("low"), F.coalesce(F.max(finite), F.lit(0.0)).alias("high"))


def _beside(grid: DataFrame, dy: int, dx: int, name: str) -> DataFrame:
    """The values of cells to the right and below, under the key of the cell itself."""
    return grid.select("image_id", (F.col("grid_y") - dy).alias("grid_y"), (F.col("grid_x") - dx).alias("grid_x"), F.col("value").alias(name))


def _corner(x: Column, y: Column, value: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), value.cast("double").alias("value"))


def smooth_faces(grid: DataFrame) -> DataFrame:
    """(image_id, grid_y, grid_x, kind, alpha, shade, corners): a face between each four cells, shaded by their mean. A grid of one line or column has none."""
    near = reduce(lambda out, n: out.join(_beside(grid, *n), CELL), ((0, 1, "right"), (1, 1, "across"), (1, 0, "below")), grid)
    x, y = F.col("grid_x"), F.col("grid_y")
    corners = F.array(_corner(x, y, F.col("value")), _corner(x + 1, y, F.col("right")), _corner(x + 1, y + 1, F.col("across")), _corner(x, y + 1, F.col("below")))
    return near.select(*CELL, F.lit("top").alias("kind"), F.lit(TOP_ALPHA).alias("alpha"), quad_mean(*[F.col(c) for c in ("value", "right", "across", "below")]).alias("shade"), corners.alias("corners"))


def stepped_faces(grid: DataFrame) -> DataFrame:
    """The same columns: a top for each cell, a side where neighbours differ, and sides at the borders down to the smallest value.

    kind is top, left, upper, right or lower, the last two for the sides to the next cells and to the borders.
    """
    low = grid_sizes(grid).select("image_id", "columns", "lines", "low")
    cells = grid.join(low, "image_id").join(_beside(grid, 0, 1, "right"), CELL, "left").join(_beside(grid, 1, 0, "below"), CELL, "left")
    x, y, value = F.col("grid_x"), F.col("grid_y"), F.col("value").cast("double")

    def side(kind: str, x0: Column, y0: Column, x1: Column, y1: Column, other: Column, shade: Column, when: Column) -> Column:
        face = F.struct(F.lit(kind).alias("kind"), F.lit(SIDE_ALPHA).alias("alpha"), shade.alias("shade"), F.array(_corner(x0, y0, value), _corner(x1, y1, value), _corner(x1, y1, other), _corner(x0, y0, other)).alias("corners"))
        return F.when(when, face)

    ends = {"right": x == F.col("columns") - 1, "below": y == F.col("lines") - 1}
    other = {c: F.when(end, F.col("low")).otherwise(F.col(c)) for c, end in ends.items()}
    shade = {c: F.when(end, value).otherwise((value + F.col(c)) / 2) for c, end in ends.items()}
    seen = {c: end | F.coalesce(needs_side(value, F.col(c)), F.lit(False)) for c, end in ends.items()}
    top = F.struct(F.lit("top").alias("kind"), F.lit(TOP_ALPHA).alias("alpha"), value.alias("shade"), F.array(_corner(x, y, value), _corner(x + 1, y, value), _corner(x + 1, y + 1, value), _corner(x, y + 1, value)).alias("corners"))
    faces = F.array(
        top,
        side("left", x, y, x, y + 1, F.col("low"), value, x == 0),
        side("upper", x, y, x + 1, y, F.col("low"), value, y == 0),
        side("right", x + 1, y, x + 1, y + 1, other["right"], shade["right"], seen["right"]),
        side("lower", x, y + 1, x + 1, y + 1, other["below"], shade["below"], seen["below"]),
    )
    return cells.select(*CELL, F.explode(F.filter(faces, lambda f: f.isNotNull())).alias("f")).select(*CELL, "f.*")


def placed(faces: DataFrame, grid: DataFrame, stepped: bool, log: bool = False, yaw: float = YAW, pitch: float = PITCH, upright: float = UPRIGHT) -> DataFrame:
    """(image_id, grid_y, grid_x, kind, alpha, depth, r, g, b, points): faces in the view of the box that holds their grid.

    Values are brought to 0..1 by the smallest and largest one of the image (by their logarithms with `log`); points are x, y of the view, y downwards.
    depth sums the distances of the four corners of the face's rectangle on the ground, larger is nearer.
    """
    sizes = grid_sizes(grid).withColumnRenamed("image_id", "image")
    both = faces.join(sizes, F.col("image_id") == F.col("image"))
    # Tops of steps have a cell's width, so their grid has one line of corners more than cells.
    spans = [F.greatest(F.col(c) - (0 if stepped else 1), F.lit(1)) for c in ("columns", "lines")]
    aspect = F.col("columns") / F.col("lines")
    short = lambda a: F.least(F.lit(LONG_SIDE), F.greatest(F.lit(SHORT_SIDE), LONG_SIDE * a))
    sides = F.when(aspect >= 1, F.lit(LONG_SIDE)).otherwise(short(aspect)), F.when(aspect >= 1, short(1 / aspect)).otherwise(F.lit(LONG_SIDE))
    normal = color.normalize_log if log else color.normalize_linear
    ranged = lambda v: normal(v.cast("double"), F.col("low"), F.col("high"))
    ground = lambda x, y: tuple((p / n - 0.5) * s for p, n, s in zip((x, y), spans, sides, strict=True))

    def point(c: Column) -> Column:
        p = projected(*ground(c["x"], c["y"]), ranged(c["value"]) * upright, yaw, pitch)
        return F.struct(p["x"].alias("x"), p["y"].alias("y"))

    back = lambda x, y: (lambda at: at[0] * math.sin(yaw) + at[1] * math.cos(yaw))(ground(x, y))
    x0, x1, y0, y1 = (F.element_at(f"corners.{c}", k) for c in ("x", "y") for k in (1, 3))
    depth = back(x0, y0) + back(x1, y0) + back(x1, y1) + back(x0, y1)
    found = both.select(*CELL, "kind", "alpha", depth.alias("depth"), color.color_ramp(ranged(F.col("shade"))).alias("ramp"), F.transform("corners", point).alias("points"))
    return found.select(*CELL, "kind", "alpha", "depth", "ramp.r", "ramp.g", "ramp.b", "points")


def painted_in_order(faces: DataFrame) -> DataFrame:
    """(…, place): faces of each image numbered from 0 in the order in which they are painted: by depth ascending, equal ones by line, column and kind.

    A pooled grid has GRID_SIZE squared cells at most, so an image has some 20,000 faces at most, whatever its size; images are sorted side by side.
    """
    order = Window.partitionBy("image_id").orderBy(F.round("depth", 9), "grid_y", "grid_x", "kind")
    return faces.withColumn("place", F.row_number().over(order) - 1)


def surface(grid: DataFrame, stepped: bool, log: bool = False) -> DataFrame:
    """The painted faces of a grid, smooth or stepped. Cells whose value isn't finite are drawn at the smallest one; an empty grid has no faces."""
    grid = grid.select(*CELL, "value")
    faces = stepped_faces(grid) if stepped else smooth_faces(grid)
    return painted_in_order(placed(faces, grid, stepped, log))
