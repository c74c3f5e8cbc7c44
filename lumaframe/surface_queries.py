"""Queries of the graph's surface over the pooled grid of the raster and over tiles, and their DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions import color
from lumaframe.operators import aggregate
from lumaframe.operators.surface import LONG_SIDE, PITCH, SHORT_SIDE, UPRIGHT, YAW, surface
from lumaframe.queries import NONFINITE, TILES, _pooled, pooled_sql, rounded, s6, sclamp, sfin, slum, sround, tiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_ROWS = ("image_id", "grid_y", "grid_x", "kind", "alpha", "depth", "r", "g", "b", "x0", "y0", "x2", "y2")


def _shown(faces: DataFrame) -> DataFrame:
    """Two opposite corners of each face beside what else it has."""
    points = [F.element_at("points", k + 1)[c].alias(f"{c}{k}") for k in (0, 2) for c in ("x", "y")]
    return rounded(faces.select(*_ROWS[:9], *points))


def _tile_grid(s: SparkSession, d: str) -> DataFrame:
    """Each pixel of the tiles is a cell."""
    return tiles(s, d).select("image_id", F.col("y").cast("long").alias("grid_y"), F.col("x").cast("long").alias("grid_x"), F.col("r").cast("double").alias("value"))


_RAMP = {n: f"([{', '.join(str(float(stop[k])) for stop in color.RAMP)}]::DOUBLE[])" for k, n in enumerate("rgb")}


def _placed_sql(faces: str, stepped: bool, log: bool) -> str:
    """From faces(image_id, grid_y, grid_x, kind, alpha, shade, x0, y0, v0, x2, y2, v2) and grid(image_id, grid_y, grid_x, value)."""
    less = 0 if stepped else 1
    eps = "greatest(1e-6::DOUBLE, abs(high) * 1e-6::DOUBLE)"
    level = lambda v: f"(CASE WHEN {sfin(v)} THEN {v} ELSE low END - low) / (CASE WHEN high = low THEN 1 ELSE high - low END)"
    if log:
        bottom, top = (f"log10(greatest({x}, 0) + {eps})" for x in ("low", "high"))
        level = lambda v: f"(log10(CASE WHEN {sfin(v)} THEN greatest({v}, 0) ELSE 0 END + {eps}) - {bottom}) / (CASE WHEN {top} - {bottom} = 0 THEN 1 ELSE {top} - {bottom} END)"
    sy, cy, sp, cp = (f"{f(a)!r}::DOUBLE" for a in (YAW, PITCH) for f in (math.sin, math.cos))
    gx, gy = (lambda x: f"(({x}) / nx - 0.5::DOUBLE) * wx"), (lambda y: f"(({y}) / ny - 0.5::DOUBLE) * wy")
    back = lambda x, y: f"({gx(x)} * {sy} + {gy(y)} * {cy})"
    vx = lambda x, y: f"{gx(x)} * {cy} - {gy(y)} * {sy}"
    vy = lambda x, y, z: f"{back(x, y)} * {cp} - {z} * {UPRIGHT}::DOUBLE * {sp}"
    ramp = lambda n: f"{sround(f'{_RAMP[n]}[i + 1] + ({_RAMP[n]}[i + 2] - {_RAMP[n]}[i + 1]) * (t5 - i)')} AS {n}"
    return f"""sized AS (SELECT image_id, max(grid_x) + 1 AS cols, max(grid_y) + 1 AS lines, coalesce(min(value) FILTER (WHERE {sfin("value")}), 0) AS low, coalesce(max(value) FILTER (WHERE {sfin("value")}), 0) AS high FROM grid GROUP BY image_id),
boxes AS (SELECT *, greatest(cols - {less}, 1)::DOUBLE AS nx, greatest(lines - {less}, 1)::DOUBLE AS ny, CASE WHEN cols >= lines THEN {LONG_SIDE}::DOUBLE ELSE least({LONG_SIDE}, greatest({SHORT_SIDE}, {LONG_SIDE} * (cols::DOUBLE / lines))) END AS wx,
  CASE WHEN cols >= lines THEN least({LONG_SIDE}, greatest({SHORT_SIDE}, {LONG_SIDE} * (lines::DOUBLE / cols))) ELSE {LONG_SIDE}::DOUBLE END AS wy FROM sized),
{faces},
leveled AS (SELECT f.*, nx, ny, wx, wy, {sclamp(level("shade"))} * 5 AS t5, {sclamp(level("v0"))} AS z0, {sclamp(level("v2"))} AS z2 FROM faces f JOIN boxes USING (image_id)),
stops AS (SELECT *, least(4, floor(t5))::INTEGER AS i FROM leveled),
seen AS (SELECT *, {back("x0", "y0")} + {back("x2", "y0")} + {back("x2", "y2")} + {back("x0", "y2")} AS deep FROM stops)
SELECT image_id, grid_y, grid_x, kind, {s6("alpha", "alpha")}, {s6("deep", "depth")}, {ramp("r")}, {ramp("g")}, {ramp("b")}, {s6(vx("x0", "y0"), "x0")}, {s6(vy("x0", "y0", "z0"), "y0")}, {s6(vx("x2", "y2"), "x2")}, {s6(vy("x2", "y2", "z2"), "y2")}"""


_SMOOTH = """faces AS (SELECT a.image_id, a.grid_y, a.grid_x, 'top' AS kind, 1.0::DOUBLE AS alpha, (a.value + b.value + c.value + d.value) / 4 AS shade, a.grid_x AS x0, a.grid_y AS y0, a.value AS v0, a.grid_x + 1 AS x2, a.grid_y + 1 AS y2, c.value AS v2
FROM grid a JOIN grid b ON b.image_id = a.image_id AND b.grid_y = a.grid_y AND b.grid_x = a.grid_x + 1 JOIN grid c ON c.image_id = a.image_id AND c.grid_y = a.grid_y + 1 AND c.grid_x = a.grid_x + 1 JOIN grid d ON d.image_id = a.image_id AND d.grid_y = a.grid_y + 1 AND d.grid_x = a.grid_x)"""
_SIDE = "0.72::DOUBLE"
_STEPPED = f"""beside AS (SELECT a.*, b.value AS rv, d.value AS bv, cols, lines, low FROM grid a JOIN boxes USING (image_id) LEFT JOIN grid b ON b.image_id = a.image_id AND b.grid_y = a.grid_y AND b.grid_x = a.grid_x + 1 LEFT JOIN grid d ON d.image_id = a.image_id AND d.grid_y = a.grid_y + 1 AND d.grid_x = a.grid_x),
faces AS (SELECT image_id, grid_y, grid_x, 'top' AS kind, 1.0::DOUBLE AS alpha, value AS shade, grid_x AS x0, grid_y AS y0, value AS v0, grid_x + 1 AS x2, grid_y + 1 AS y2, value AS v2 FROM beside
UNION ALL SELECT image_id, grid_y, grid_x, 'left', {_SIDE}, value, grid_x, grid_y, value, grid_x, grid_y + 1, low FROM beside WHERE grid_x = 0
UNION ALL SELECT image_id, grid_y, grid_x, 'upper', {_SIDE}, value, grid_x, grid_y, value, grid_x + 1, grid_y, low FROM beside WHERE grid_y = 0
UNION ALL SELECT image_id, grid_y, grid_x, 'right', {_SIDE}, coalesce((value + rv) / 2, value), grid_x + 1, grid_y, value, grid_x + 1, grid_y + 1, coalesce(rv, low) FROM beside WHERE rv IS NULL OR abs(rv - value) > 1e-12
UNION ALL SELECT image_id, grid_y, grid_x, 'lower', {_SIDE}, coalesce((value + bv) / 2, value), grid_x, grid_y + 1, value, grid_x + 1, grid_y + 1, coalesce(bv, low) FROM beside WHERE bv IS NULL OR abs(bv - value) > 1e-12)"""

_PLACE = "(row_number() OVER (PARTITION BY image_id ORDER BY round(deep, 9), grid_y, grid_x, kind) - 1)::BIGINT AS place FROM seen"
_POOLED = f"{NONFINITE}, {pooled_sql().replace('grid AS (SELECT image_id', 'means AS (SELECT image_id')}, grid AS (SELECT image_id, grid_y, grid_x, {slum()} AS value FROM means)"
_CELLS = f"{TILES}, grid AS (SELECT image_id, y::BIGINT AS grid_y, x::BIGINT AS grid_x, r::DOUBLE AS value FROM px)"


def add(name: str, grid: Query, grid_sql: str, stepped: bool, log: bool = False) -> None:
    QUERIES[name] = lambda s, d: _shown(surface(grid(s, d), stepped, log))
    ORACLE_SQL[name] = f"WITH {grid_sql}, {_placed_sql(_STEPPED if stepped else _SMOOTH, stepped, log)} FROM seen"


add("surface_smooth", lambda s, d: aggregate.graph_values(_pooled(s, d), "rgb"), _POOLED, False)
add("surface_smooth_log", lambda s, d: aggregate.graph_values(_pooled(s, d), "rgb"), _POOLED, False, True)
add("surface_stepped", _tile_grid, _CELLS, True)
QUERIES["surface_order"] = lambda s, d: surface(_tile_grid(s, d), True).select("image_id", "grid_y", "grid_x", "kind", F.col("place").cast("long").alias("place"))
ORACLE_SQL["surface_order"] = f"WITH {_CELLS}, {_placed_sql(_STEPPED, True, False).rpartition('SELECT image_id, grid_y')[0]} SELECT image_id, grid_y, grid_x, kind, {_PLACE}"
