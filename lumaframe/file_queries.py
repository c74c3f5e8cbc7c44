"""Queries that write the events raster into files of the shared folder and read those back, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaframe.functions import color
from lumaframe.queries import EVENTS, TILES, WIDTH, events, rounded, s6, tiles
from lumaframe.queries import ORACLE_SQL as RASTER_SQL
from lumaframe.schema import CHANNELS, Rect
from lumaframe.sources import files, matrix
from lumaframe.sources.datasource import register, save_parts, save_selection_csv
from lumaframe.storage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_ALL = ", ".join(s6(c, c) for c in CHANNELS)


def written(pixels: DataFrame, kind: str, suffix: str) -> str:
    """The folder of new files, one for each image."""
    spark = pixels.sparkSession
    register(spark)
    folder = scratch_path(spark, "images")
    if kind in files.EXR_KINDS:
        save_parts(files.exr_parts(pixels, kind), folder, suffix)
    else:
        files.encoded_files(pixels, kind).write.format("image-files").option("suffix", suffix).mode("append").save(folder)
    return folder


def _named(pixels: DataFrame) -> DataFrame:
    """Paths back to the names that the files were written under."""
    return pixels.withColumn("image_id", F.regexp_extract("image_id", r"([^/]*)\.[^./]*$", 1))


def _read(source: Query, kind: str, suffix: str, split: int, where: str = "true") -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        folder = written(source(s, d), kind, suffix)
        return rounded(_named(s.read.format("pixels").option("split", split).load(folder).filter(where)))

    return query


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


#: One file of all events; a task reads 16 KB of it.
add("exr_source", _read(events, "exr", ".exr", 1 << 14), f"WITH {EVENTS} SELECT image_id, y, x, {_ALL} FROM px")
add("exr_source_zip", _read(events, "exr-zip", ".exr", 1 << 12), f"WITH {EVENTS} SELECT image_id, y, x, {_ALL} FROM px")
add("exr_source_piz", _read(events, "exr-piz", ".exr", 1 << 13), f"WITH {EVENTS} SELECT image_id, y, x, {_ALL} FROM px")
#: The lower half of each tile: the blocks of lines above aren't read.
add("exr_source_lines", _read(tiles, "exr", ".exr", 1 << 20, "y >= 5"), f"WITH {TILES} SELECT image_id, y, x, {_ALL} FROM px WHERE y >= 5")
def _hdr_sql() -> str:
    top = "greatest(r::DOUBLE, g::DOUBLE, b::DOUBLE, 0)"
    byte = lambda c: f"CASE WHEN top < 1e-32 OR e + 128 <= 0 THEN 0 ELSE (least(255, greatest(0, floor(greatest({c}::DOUBLE, 0) / pow(2.0::DOUBLE, e - 8) + 0.5))) * pow(2.0::DOUBLE, e - 8))::FLOAT END"
    return f"""WITH {TILES}, tops AS (SELECT *, {top} AS top FROM px), n AS (SELECT *, floor(log2(CASE WHEN top < 1e-32 THEN 1 ELSE top END)) + 1 AS e FROM tops)
SELECT image_id, y, x, {", ".join(s6(byte(c), c) for c in "rgb")}, {s6("1", "a")} FROM n"""


#: Radiance files of all tiles; values are what three mantissas under one exponent hold.
add("hdr_source", _read(tiles, "hdr", ".hdr", 1 << 12), _hdr_sql())


def _csv_lines(s: SparkSession, d: str) -> DataFrame:
    """(line, value): the selection of the whole raster, written as CSV text in ordered parts and read back as one text."""
    folder = scratch_path(s, "selection-csv")
    save_selection_csv(files.selection_rows(events(s, d), Rect(0, 0, WIDTH, 1 << 30), "rgb", "srgb255"), folder)
    parts = s.read.text(f"{folder}/part-*", wholetext=True).select(F.input_file_name().alias("part"), F.split(F.expr("rtrim('\n', value)"), "\n").alias("lines"))
    # A row for each part: how many lines stand before it.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.size("lines").cast("long").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).select("part", "start")
    lines = parts.select("part", F.posexplode("lines").alias("at", "value")).join(starts, "part")
    return lines.select((F.col("start") + F.col("at")).alias("line"), "value")


_CELLS = RASTER_SQL["selection_csv"]
add("selection_csv_parts", _csv_lines, f"SELECT 0::BIGINT AS line, 'x,y,mode,display,r,g,b' AS value UNION ALL SELECT (y * {WIDTH} + x + 1)::BIGINT, concat_ws(',', x, y, mode, display, r, g, b) FROM ({_CELLS})")


def _texts(s: SparkSession, d: str, damaged: bool = False, **options) -> str:
    """The folder of all tiles as matrix texts; with `damaged` every third one lacks its end."""
    register(s)
    folder = scratch_path(s, "matrix-texts")
    texts = matrix.texts_of(tiles(s, d), **options)
    if damaged:
        cut = F.expr("substring(content, 1, length(content) - 40)")
        texts = texts.withColumn("content", F.when(F.col("image_id").cast("int") % 3 == 0, cut).otherwise(F.col("content")))
    texts.write.format("image-files").option("suffix", ".txt").mode("append").save(folder)
    return folder


add("matrix_files", lambda s, d: rounded(_named(matrix.read_matrix_files(s, _texts(s, d)))), f"WITH {TILES} SELECT image_id, y, x, {_ALL} FROM px")
add("matrix_files_plain", lambda s, d: rounded(_named(matrix.read_matrix_files(s, _texts(s, d, channels=(0, 1, 2), header=False)))), f"WITH {TILES} SELECT image_id, y, x, {', '.join(s6(c, c) for c in 'rgb')}, {s6('1', 'a')} FROM px")
add(
    "matrix_file_records",
    lambda s, d: _named(matrix.matrix_records(s, _texts(s, d, damaged=True))).select("image_id", "width", "height", F.size("channels").cast("long").alias("channels"), F.isnull("error").alias("good")),
    f"WITH {TILES} SELECT image_id, CASE WHEN image_id::INTEGER % 3 <> 0 THEN (max(x) + 1)::INTEGER END AS width, CASE WHEN image_id::INTEGER % 3 <> 0 THEN (max(y) + 1)::INTEGER END AS height, CASE WHEN image_id::INTEGER % 3 = 0 THEN NULL ELSE 4 END::BIGINT AS channels, image_id::INTEGER % 3 <> 0 AS good FROM px GROUP BY image_id",
)


#: Bytes that a value of a saved JPEG may lie away from what was saved; blocks of noise at a quality of 0.95 stay below.
JPEG_ERROR = 32


def _jpeg_errors(s: SparkSession, d: str) -> DataFrame:
    """All tiles as JPEG files read by Spark's image source: pixels, and those whose values are all near what was saved."""
    px = tiles(s, d).withColumn("a", F.lit(1.0).cast("float"))
    back = _named(files.read_raster(s, written(px, "jpeg", ".jpg"))).select("image_id", "y", "x", *[color.srgb_byte(c).alias(f"got_{c}") for c in "rgb"])
    both = px.select("image_id", "y", "x", *[color.srgb_byte(c).alias(c) for c in "rgb"]).join(back, ["image_id", "y", "x"])
    near = reduce(lambda a, b: a & b, [F.abs(F.col(c) - F.col(f"got_{c}")) <= JPEG_ERROR for c in "rgb"])
    return both.groupBy("image_id").agg(F.count("*").alias("pixels"), F.count_if(near).alias("near"))


add("jpeg_files", _jpeg_errors, f"WITH {TILES} SELECT image_id, count(*) AS pixels, count(*) AS near FROM px GROUP BY image_id")
