"""Queries over rasters derived from the test tables, and their DuckDB SQL.

Computed doubles are rounded to six digits in both, and -0.0 becomes 0.0. Rasters: `events` (100 wide, HDR values, alpha),
`nonfinite` (the same with NaN and infinities), `part` (50 wide), and `embeddings` (16 wide, a row for each vector).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions import color, geometry, text
from lumaframe.operators import aggregate, display, generate, pick, select, stencil
from lumaframe.plans import share
from lumaframe.plans.catalog import Catalog
from lumaframe.schema import CHANNELS, Rect
from lumaframe.sources import files, matrix

WIDTH = 100
RECT = Rect(3, 2, 40, 7)

# --- rasters ---------------------------------------------------------------------------------------------------------


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.selectExpr(
        "'events' AS image_id", f"CAST(event_id div {WIDTH} AS int) AS y", f"CAST(event_id % {WIDTH} AS int) AS x",
        "CAST(value / 100 AS float) AS r", "CAST((user_id % 16) / 16D AS float) AS g", "CAST((event_id % 7) / 8D - 0.25D AS float) AS b", "CAST((event_id % 5) / 4D AS float) AS a",
    )


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The events raster as images of 50 x 10 pixels."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.selectExpr(
        "CAST(event_id div 500 AS string) AS image_id", "CAST((event_id % 500) div 50 AS int) AS y", "CAST(event_id % 50 AS int) AS x",
        "CAST(value / 100 AS float) AS r", "CAST((user_id % 16) / 16D AS float) AS g", "CAST((event_id % 7) / 8D - 0.25D AS float) AS b", "CAST((event_id % 5) / 4D AS float) AS a",
    )


def nonfinite(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("y") * WIDTH + F.col("x")
    bad = F.when(k % 11 == 0, float("nan")).when(k % 13 == 0, float("inf")).when(k % 17 == 0, float("-inf")).otherwise(F.col("r"))
    return events(spark, sf).withColumn("r", bad.cast("float"))


def part(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.selectExpr("'part' AS image_id", "CAST(p_partkey div 50 AS int) AS y", "CAST(p_partkey % 50 AS int) AS x", "CAST(p_retailprice / 1000 AS float) AS r", "CAST(p_size / 50D AS float) AS g", "CAST(0 AS float) AS b", "CAST(1 AS float) AS a")


def embeddings(spark: SparkSession, sf: str, x0: int = 0, x1: int = 15) -> DataFrame:
    """Only the columns x0..x1 are made; a filter on vec_id reaches the scan."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", F.explode(F.sequence(F.lit(x0), F.lit(x1))).alias("x"))
    return e.select(F.lit("embeddings").alias("image_id"), F.col("vec_id").cast("int").alias("y"), "x", *[F.get("embedding", 4 * F.col("x") + k).alias(c) for k, c in enumerate(CHANNELS)])


_EXPR = "(value / 100)::FLOAT AS r, ((user_id % 16) / 16.0::DOUBLE)::FLOAT AS g, ((event_id % 7) / 8.0::DOUBLE - 0.25::DOUBLE)::FLOAT AS b, ((event_id % 5) / 4.0::DOUBLE)::FLOAT AS a FROM events"
EVENTS = f"px AS (SELECT 'events' AS image_id, (event_id // {WIDTH})::INTEGER AS y, (event_id % {WIDTH})::INTEGER AS x, {_EXPR})"
TILES = f"px AS (SELECT (event_id // 500)::VARCHAR AS image_id, ((event_id % 500) // 50)::INTEGER AS y, (event_id % 50)::INTEGER AS x, {_EXPR})"
NONFINITE = f"""base AS (SELECT 'events' AS image_id, (event_id // {WIDTH})::INTEGER AS y, (event_id % {WIDTH})::INTEGER AS x, event_id, {_EXPR}),
px AS (SELECT image_id, y, x, CASE WHEN event_id % 11 = 0 THEN 'nan'::FLOAT WHEN event_id % 13 = 0 THEN 'inf'::FLOAT WHEN event_id % 17 = 0 THEN '-inf'::FLOAT ELSE r END AS r, g, b, a FROM base)"""
PART = "px AS (SELECT 'part' AS image_id, (p_partkey // 50)::INTEGER AS y, (p_partkey % 50)::INTEGER AS x, (p_retailprice / 1000)::FLOAT AS r, (p_size / 50.0::DOUBLE)::FLOAT AS g, 0::FLOAT AS b, 1::FLOAT AS a FROM part)"
EMBEDDINGS = "px AS (SELECT 'embeddings' AS image_id, vec_id::INTEGER AS y, k::INTEGER AS x, embedding[4*k+1] AS r, embedding[4*k+2] AS g, embedding[4*k+3] AS b, embedding[4*k+4] AS a FROM embeddings, range(16) t(k))"

# --- rounding and small SQL pieces -----------------------------------------------------------------------------------


#: Keeps values off the ties of rounding, which the two engines break differently.
NUDGE = 3e-10


def six(c: Column | str) -> Column:
    v = F.round(color.d(c) + NUDGE, 6)
    return F.when(v == 0, F.lit(0.0)).otherwise(v)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """df with doubles and floats rounded."""
    return df.select(*[six(c).alias(c) if t in ("double", "float") and c not in keep else F.col(c) for c, t in df.dtypes])


def s6(e: str, name: str | None = None) -> str:
    v = f"round(({e})::DOUBLE + {NUDGE}::DOUBLE, 6)"
    return f"CASE WHEN {v} = 0 THEN 0.0::DOUBLE ELSE {v} END" + (f" AS {name}" if name else "")


def sfin(e: str) -> str:
    return f"(abs(({e})::DOUBLE) < 'inf'::DOUBLE)"


def slum(p: str = "", r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"(0.2126::DOUBLE * {p}{r}::DOUBLE + 0.7152::DOUBLE * {p}{g}::DOUBLE + 0.0722::DOUBLE * {p}{b}::DOUBLE)"


def sto_srgb(v: str) -> str:
    return f"(CASE WHEN NOT {sfin(v)} THEN {v} WHEN {v} <= 0.0031308 THEN {v} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({v}, 1/2.4::DOUBLE) - 0.055::DOUBLE END)"


def sto_linear(v: str) -> str:
    return f"(CASE WHEN NOT {sfin(v)} THEN {v} WHEN {v} <= 0.04045 THEN {v} / 12.92::DOUBLE ELSE pow(({v} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"


def sclamp(v: str) -> str:
    return f"(CASE WHEN {sfin(v)} THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, {v})) ELSE 0.0::DOUBLE END)"


def sround(v: str) -> str:
    return f"floor(({v}) + 0.5)::INTEGER"


def sbyte(v: str) -> str:
    return f"(CASE WHEN NOT {sfin(v)} OR {v} <= 0 THEN 0 WHEN {v} >= 1 THEN 255 ELSE {sround(f'{sto_srgb(v)} * 255')} END)"


def s255(v: str, alpha: bool = False) -> str:
    return sround(f"{sclamp(v if alpha else sto_srgb(v))} * 255")


def sagg(how: str, v: str) -> str:
    return f"coalesce({how}(({v})::DOUBLE) FILTER (WHERE {sfin(v)}), 0.0::DOUBLE)"


D = {c: f"{c}::DOUBLE" for c in CHANNELS}
W = {c: f"(r::DOUBLE * a::DOUBLE)".replace("r:", f"{c}:") if c != "a" else D["a"] for c in CHANNELS}
CROP = f"crop AS (SELECT image_id, (y - {RECT.y})::INTEGER AS y, (x - {RECT.x})::INTEGER AS x, r, g, b, a FROM px WHERE y BETWEEN {RECT.y} AND {RECT.y + RECT.height - 1} AND x BETWEEN {RECT.x} AND {RECT.x + RECT.width - 1})"


def stats_sql(source: str, weigh: bool = False) -> str:
    values = ", ".join(f"({c} * a)::FLOAT AS {c}" if weigh and c != "a" else c for c in CHANNELS)
    aggs = ", ".join(s6(sagg(how, c), f"{how}_{c}") for how in ("min", "max", "avg") for c in (*CHANNELS, "lum"))
    return f"v AS (SELECT image_id, {values} FROM {source}), l AS (SELECT *, {slum()} AS lum FROM v) SELECT image_id, count(*) AS count, {aggs} FROM l GROUP BY image_id"


RANGE = "ranges AS (SELECT image_id, " + ", ".join(f"{sagg(h, c)} AS {h}_{c}" for h in ("min", "max") for c in CHANNELS) + " FROM px GROUP BY image_id), ranged AS (SELECT *, least(min_r, min_g, min_b) AS rgb_min, greatest(max_r, max_g, max_b) AS rgb_max FROM ranges)"


def pooled_sql(weigh: bool = False) -> str:
    cols = ", ".join(f"coalesce(avg({c}::DOUBLE) FILTER (WHERE {sfin(c)}), 0.0)::FLOAT AS {c}" for c in CHANNELS)
    return f"dims AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px), grid AS (SELECT image_id, ((y::BIGINT * least(64, h)) // h)::BIGINT AS grid_y, ((x::BIGINT * least(64, w)) // w)::BIGINT AS grid_x, {cols} FROM px, dims GROUP BY 1, 2, 3)"


def _size(pixels: DataFrame) -> tuple[int, int]:
    return tuple(pixels.agg(F.max("x") + 1, F.max("y") + 1).first())


def _pooled(s, d):
    px = nonfinite(s, d)
    return aggregate.pooled_grid(px, *_size(px))


def _pickers(spark: SparkSession) -> DataFrame:
    # The pickers of the fixtures.
    return spark.createDataFrame([(1, "events", 0, 0, "#ff365e"), (2, "events", 99, 9, "#35d0ff"), (4, "events", 3, 2, "#ffe156")], "picker_id int, image_id string, x int, y int, color string")


PICKERS = "pickers(picker_id, image_id, x, y, color) AS (VALUES (1::INTEGER, 'events', 0::INTEGER, 0::INTEGER, '#ff365e'), (2, 'events', 99, 9, '#35d0ff'), (4, 'events', 3, 2, '#ffe156'))"


def _rects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "events", 0, 0, 1, 1), (2, "events", 3, 2, 40, 7), (3, "events", 0, 0, 100, 10), (4, "events", 95, 8, 5, 2)], "rect_id int, image_id string, x int, y int, width int, height int")


RECTS = "rects(rect_id, image_id, x, y, width, height) AS (VALUES (1::INTEGER, 'events', 0::INTEGER, 0::INTEGER, 1::INTEGER, 1::INTEGER), (2, 'events', 3, 2, 40, 7), (3, 'events', 0, 0, 100, 10), (4, 'events', 95, 8, 5, 2))"


def _generated_sql(w: int, h: int, body: str) -> str:
    return f"WITH c AS (SELECT 'generated' AS image_id, (k // {w})::INTEGER AS y, (k % {w})::INTEGER AS x, ((k % {w}) + 0.5::DOUBLE) / {w} AS u, ((k // {w}) + 0.5::DOUBLE) / {h} AS v FROM range({w * h}) t(k)), q AS (SELECT *, (u - 0.5::DOUBLE) * {w / h!r}::DOUBLE AS cx, v - 0.5::DOUBLE AS cy FROM c) SELECT image_id, y, x, {body} FROM q"


def _f6(e: str, c: str) -> str:
    return s6(f"({e})::FLOAT", c)


def _blur_sql(radius_x: int, radius_y: int, n: float) -> str:
    dims = "dims AS (SELECT max(y) AS h, max(x) AS w FROM px)"
    offs = f"offs AS (SELECT i AS dx, j AS dy FROM range({-radius_x}, {radius_x + 1}) p(i), range({-radius_y}, {radius_y + 1}) q(j))"
    return f"WITH {EVENTS}, {dims}, {offs}, asked AS (SELECT image_id, y, x, least(greatest(y + dy, 0), h) AS sy, least(greatest(x + dx, 0), w) AS sx FROM px, dims, offs) SELECT k.image_id, k.y, k.x, {', '.join(s6(f'sum(p.{c}::DOUBLE) / {n}::DOUBLE', c) for c in CHANNELS)} FROM asked k JOIN px p ON p.y = sy AND p.x = sx GROUP BY ALL"


SOBEL = f"""WITH {EVENTS}, dims AS (SELECT max(y) AS h, max(x) AS w FROM px), offs(dx, dy, kx, ky) AS (VALUES (-1,-1,-1,-1),(0,-1,0,-2),(1,-1,1,-1),(-1,0,-2,0),(1,0,2,0),(-1,1,-1,1),(0,1,0,2),(1,1,1,1)),
asked AS (SELECT image_id, y, x, a, kx, ky, least(greatest(y + dy, 0), h) AS sy, least(greatest(x + dx, 0), w) AS sx FROM px, dims, offs),
g AS (SELECT k.image_id, k.y, k.x, k.a, sum(kx * {slum("p.")}) AS gx, sum(ky * {slum("p.")}) AS gy FROM asked k JOIN px p ON p.y = sy AND p.x = sx GROUP BY ALL)
SELECT image_id, y, x, {s6("sqrt(gx * gx + gy * gy)", "edge")}, {s6("a", "a")} FROM g"""

RESAMPLE = f"""WITH {EVENTS}, dims AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px), grid AS (SELECT (k // 30)::INTEGER AS y, (k % 30)::INTEGER AS x FROM range(600) t(k)),
f AS (SELECT y, x, h, w, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (x + 0.5::DOUBLE) / 30)) * w - 0.5::DOUBLE AS fx, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (y + 0.5::DOUBLE) / 20)) * h - 0.5::DOUBLE AS fy FROM grid, dims),
c AS (SELECT y, x, least(greatest(floor(fy) + dy, 0), h - 1)::INTEGER AS sy, least(greatest(floor(fx) + dx, 0), w - 1)::INTEGER AS sx,
  (CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) * (CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) AS wt FROM f, range(2) p(dx), range(2) q(dy))
SELECT p.image_id, c.y, c.x, {", ".join(s6(f"sum(wt * p.{k}::DOUBLE)", k) for k in CHANNELS)} FROM c JOIN px p ON p.y = sy AND p.x = sx GROUP BY ALL"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _list(cols: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in cols.items())


# --- selections and statistics ---------------------------------------------------------------------------------------
add("selection_stats", lambda s, d: rounded(aggregate.selection_stats(select.crop(events(s, d), RECT))), f"WITH {EVENTS}, {CROP}, {stats_sql('crop')}")
add("selection_stats_alpha_weighted", lambda s, d: rounded(aggregate.selection_stats(select.crop(events(s, d), RECT), "rgba")), f"WITH {EVENTS}, {CROP}, {stats_sql('crop', True)}")
add("nonfinite_skip", lambda s, d: rounded(aggregate.selection_stats(nonfinite(s, d))), f"WITH {NONFINITE}, {stats_sql('px')}")
add("tile_stats", lambda s, d: rounded(aggregate.selection_stats(tiles(s, d))), f"WITH {TILES}, {stats_sql('px')}")
add("mode_stats", lambda s, d: rounded(aggregate.mode_stats(aggregate.selection_stats(tiles(s, d)), "rgb")), f"WITH {TILES} SELECT image_id, {s6(sagg('min', slum()), 'low')}, {s6(sagg('max', slum()), 'high')}, {s6(sagg('avg', slum()), 'mean')} FROM px GROUP BY image_id")
add("image_range", lambda s, d: rounded(aggregate.image_range(nonfinite(s, d))), f"WITH {NONFINITE}, {RANGE} SELECT image_id, {', '.join(s6(c, c) for c in [f'{h}_{c}' for h in ('min', 'max') for c in CHANNELS] + ['rgb_min', 'rgb_max'])} FROM ranged")
add("display_range_rgb", lambda s, d: rounded(aggregate.display_range(aggregate.image_range(tiles(s, d)), "rgb")), f"WITH {TILES}, {RANGE} SELECT image_id, {s6('rgb_min', 'low')}, {s6('rgb_max', 'high')} FROM ranged")
add("display_range_g", lambda s, d: rounded(aggregate.display_range(aggregate.image_range(tiles(s, d)), "g")), f"WITH {TILES}, {RANGE} SELECT image_id, {s6('min_g', 'low')}, {s6('max_g', 'high')} FROM ranged")
add("default_settings", lambda s, d: aggregate.default_settings(tiles(s, d), "hdr"), f"WITH {TILES}, {RANGE} SELECT image_id, CASE WHEN max_a > 0 THEN 'rgba' ELSE 'rgb' END AS channel, true AS auto_level FROM ranged")
add("pooled_grid", lambda s, d: rounded(_pooled(s, d)), f"WITH {NONFINITE}, {pooled_sql()} SELECT image_id, grid_y, grid_x, {', '.join(s6(c, c) for c in CHANNELS)} FROM grid")
add("pooled_grid_luminance", lambda s, d: rounded(aggregate.graph_values(_pooled(s, d), "rgb")), f"WITH {NONFINITE}, {pooled_sql()} SELECT image_id, grid_y, grid_x, {s6(slum(), 'value')} FROM grid")
add("graph_extent", lambda s, d: rounded(aggregate.extent(aggregate.graph_values(_pooled(s, d), "rgb"))), f"WITH {NONFINITE}, {pooled_sql()} SELECT image_id, {s6(f'min({slum()})', 'low')}, {s6(f'max({slum()})', 'high')} FROM grid GROUP BY image_id")
add(
    "strided_samples",
    lambda s, d: (lambda px: rounded(aggregate.strided_samples(px, Rect(0, 0, *_size(px)), "rgb", most=20, dragging=True)))(events(s, d)),
    f"WITH {EVENTS}, dims AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px), places AS (SELECT h, w, i::INTEGER AS \"row\", j::INTEGER AS col FROM dims, range(20) p(i), range(20) q(j) WHERE i < h AND j < w) SELECT image_id, p.\"row\", p.col, {s6(slum(), 'value')} FROM px JOIN places p ON px.y = floor((h - 1)::DOUBLE * (p.\"row\" / greatest(least(h, 20) - 1, 1)::DOUBLE) + 0.5) AND px.x = floor((w - 1)::DOUBLE * (p.col / greatest(least(w, 20) - 1, 1)::DOUBLE) + 0.5)",
)
# --- projections -----------------------------------------------------------------------------------------------------
add("crop_linear", lambda s, d: rounded(select.displayed(select.crop(events(s, d), RECT), "rgba")), f"WITH {EVENTS}, {CROP} SELECT image_id, y, x, {', '.join(s6(W[c], c) for c in CHANNELS)} FROM crop")
add("crop_srgb", lambda s, d: rounded(select.encoded(select.crop(events(s, d), RECT), "rgba", "srgb")), f"WITH {EVENTS}, {CROP} SELECT image_id, y, x, {', '.join(s6(sto_srgb(W[c]) if c != 'a' else D['a'], c) for c in CHANNELS)} FROM crop")
add("crop_srgb255", lambda s, d: select.encoded(select.crop(nonfinite(s, d), RECT), "rgba", "srgb255"), f"WITH {NONFINITE}, {CROP} SELECT image_id, y, x, {_list({c: s255(W[c], c == 'a') for c in CHANNELS})} FROM crop")
add("crop_embeddings", lambda s, d: rounded(select.displayed(embeddings(s, d, 2, 5).filter("y BETWEEN 10 AND 99"), "rgb")), f"WITH {EMBEDDINGS} SELECT image_id, y, x, {', '.join(s6(D[c], c) for c in 'rgb')} FROM px WHERE y BETWEEN 10 AND 99 AND x BETWEEN 2 AND 5")
add("channel_r", lambda s, d: rounded(select.displayed(events(s, d), "r")), f"WITH {EVENTS} SELECT image_id, y, x, {s6('r', 'r')} FROM px")
add("channel_rgb", lambda s, d: rounded(select.displayed(events(s, d), "rgb")), f"WITH {EVENTS} SELECT image_id, y, x, {', '.join(s6(c, c) for c in 'rgb')} FROM px")
add("swizzle_g", lambda s, d: rounded(select.swizzled(events(s, d), "g")), f"WITH {EVENTS} SELECT image_id, y, x, {', '.join(s6('g', c) for c in 'rgb')}, {s6('1', 'a')} FROM px")
add("luminance", lambda s, d: rounded(events(s, d).select("image_id", "y", "x", color.luminance().alias("value"))), f"WITH {EVENTS} SELECT image_id, y, x, {s6(slum(), 'value')} FROM px")
add("flip_rows", lambda s, d: (lambda px: rounded(select.flipped(px, _size(px)[1])))(events(s, d)), f"WITH {EVENTS}, dims AS (SELECT max(y) AS h FROM px) SELECT image_id, (h - y)::INTEGER AS y, x, {', '.join(s6(c, c) for c in CHANNELS)} FROM px, dims")
add("image_union", lambda s, d: rounded(select.append(events(s, d), part(s, d), embeddings(s, d))), "WITH " + ", ".join(x.replace("px AS", f"{n} AS", 1) for n, x in (("e", EVENTS), ("p", PART), ("m", EMBEDDINGS))) + f" SELECT image_id, y, x, {', '.join(s6(c, c) for c in CHANNELS)} FROM (SELECT * FROM e UNION ALL SELECT * FROM p UNION ALL SELECT * FROM m)")
add("unpremultiply", lambda s, d: rounded(events(s, d).select("image_id", "y", "x", *[color.unpremultiply(c, "a").alias(c) for c in "rgb"], "a")), f"WITH {EVENTS} SELECT image_id, y, x, {', '.join(s6(f'CASE WHEN a > 0 THEN {c}::DOUBLE / a::DOUBLE ELSE 0 END', c) for c in 'rgb')}, {s6('a', 'a')} FROM px")
add("channel_union", lambda s, d: select.union_of_channels(s.createDataFrame([("b",), ("rgb",)], "mode string")), "SELECT ['r', 'g', 'b'] AS channels")
# --- scalar functions ------------------------------------------------------------------------------------------------
for _name, _f, _g in (
    ("srgb_to_linear", color.srgb_to_linear, sto_linear), ("linear_to_srgb", color.linear_to_srgb, sto_srgb), ("clamp01", lambda c: color.clamp01(color.d(c)), sclamp),
    ("program_srgb_to_linear", color.program_srgb_to_linear, lambda v: f"(CASE WHEN greatest({v}, 0) >= 0.04045 THEN pow((greatest({v}, 0) + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) ELSE greatest({v}, 0) / 12.92::DOUBLE END)"),
    ("program_linear_to_srgb", color.program_linear_to_srgb, lambda v: f"(CASE WHEN greatest({v}, 0) >= 0.0031308 THEN 1.055::DOUBLE * pow(greatest({v}, 0), 1/2.4::DOUBLE) - 0.055::DOUBLE ELSE greatest({v}, 0) * 12.92::DOUBLE END)"),
):
    add(_name, lambda s, d, f=_f: rounded(events(s, d).select("image_id", "y", "x", *[f(c).alias(c) for c in "rgb"])), f"WITH {EVENTS} SELECT image_id, y, x, {', '.join(s6(_g(D[c]), c) for c in 'rgb')} FROM px")
add("srgb_byte", lambda s, d: nonfinite(s, d).select("image_id", "y", "x", *[color.srgb_byte(c).alias(c) for c in "rgb"]), f"WITH {NONFINITE} SELECT image_id, y, x, {_list({c: sbyte(D[c]) for c in 'rgb'})} FROM px")
add("rgbe_encode", lambda s, d: nonfinite(s, d).select("image_id", "y", "x", color.rgbe().alias("v")).select("image_id", "y", "x", "v.*"), f"""WITH {NONFINITE}, t AS (SELECT image_id, y, x, greatest(r::DOUBLE, 0) AS r, greatest(g::DOUBLE, 0) AS g, greatest(b::DOUBLE, 0) AS b FROM px), m AS (SELECT *, greatest(r, g, b) AS top FROM t),
n AS (SELECT *, NOT {sfin("top")} OR top < 1e-32 AS none, floor(log2(CASE WHEN NOT {sfin("top")} OR top < 1e-32 THEN 1 ELSE top END)) + 1 AS e FROM m)
SELECT image_id, y, x, {", ".join(f"(CASE WHEN none THEN 0 ELSE least(255, greatest(0, {sround(f'{c} / pow(2.0::DOUBLE, e - 8)')})) END)::INTEGER AS {c}" for c in "rgb")}, (CASE WHEN none THEN 0 ELSE least(e + 128, 255) END)::INTEGER AS e FROM n""")  # fmt: skip
_NORM = "rn AS (SELECT p.*, rgb_min AS low, rgb_max AS high FROM px p JOIN ranged USING (image_id))"
_LIN = sclamp(f"((CASE WHEN {sfin('r')} THEN r::DOUBLE ELSE low END) - low) / (CASE WHEN high - low = 0 THEN 1 ELSE high - low END)")
_EPS = "greatest(1e-6::DOUBLE, abs(high) * 1e-6::DOUBLE)"
_LOG = sclamp(f"(log10((CASE WHEN {sfin('r')} THEN greatest(r::DOUBLE, 0) ELSE 0 END) + {_EPS}) - log10(greatest(low, 0) + {_EPS})) / (CASE WHEN log10(greatest(high, 0) + {_EPS}) - log10(greatest(low, 0) + {_EPS}) = 0 THEN 1 ELSE log10(greatest(high, 0) + {_EPS}) - log10(greatest(low, 0) + {_EPS}) END)")
add("normalize_linear", lambda s, d: rounded(display.with_range(nonfinite(s, d), "rgb").select("image_id", "y", "x", color.normalize_linear(color.d("r"), F.col("low"), F.col("high")).alias("value"))), f"WITH {NONFINITE}, {RANGE}, {_NORM} SELECT image_id, y, x, {s6(_LIN, 'value')} FROM rn")
add("normalize_log", lambda s, d: rounded(display.with_range(nonfinite(s, d), "rgb").select("image_id", "y", "x", color.normalize_log(color.d("r"), F.col("low"), F.col("high")).alias("value"))), f"WITH {NONFINITE}, {RANGE}, {_NORM} SELECT image_id, y, x, {s6(_LOG, 'value')} FROM rn")
_RAMP = {n: f"([{', '.join(str(float(s[k])) for s in color.RAMP)}]::DOUBLE[])" for k, n in enumerate("rgb")}
add("color_ramp", lambda s, d: nonfinite(s, d).select("image_id", "y", "x", color.color_ramp(color.d("r")).alias("v")).select("image_id", "y", "x", "v.*"), f"WITH {NONFINITE}, t AS (SELECT image_id, y, x, {sclamp(D['r'])} * 5 AS place FROM px), k AS (SELECT *, least(4, floor(place))::INTEGER AS i FROM t) SELECT image_id, y, x, {_list({n: sround(f'{a}[i + 1] + ({a}[i + 2] - {a}[i + 1]) * (place - i)') for n, a in _RAMP.items()})} FROM k")
_LEVEL = lambda c: f"(({c}::DOUBLE - low) * (1 / (high - low)) * 1.5::DOUBLE)"
add("auto_level_bytes", lambda s, d: display.display_bytes(events(s, d), "rgba", auto_level=True, brightness=1.5), f"WITH {EVENTS}, {RANGE}, {_NORM} SELECT image_id, y, x, {_list({c: sbyte(_LEVEL(c)) for c in 'rgb'})}, {sround(sclamp(D['a']) + ' * 255')} AS a FROM rn")
add("alpha_bytes", lambda s, d: display.display_bytes(events(s, d), "a", brightness=2.0), f"WITH {EVENTS} SELECT image_id, y, x, {_list({c: sround(sclamp('(a::DOUBLE * 2)') + ' * 255') for c in 'rgb'})}, 255 AS a FROM px")
add("file_bytes", lambda s, d: display.file_bytes(events(s, d)), f"WITH {EVENTS} SELECT image_id, y, x, {_list({c: sbyte(D[c]) for c in 'rgb'})}, {sround(sclamp(D['a']) + ' * 255')} AS a FROM px")
add(
    "view_geometry",
    lambda s, d: rounded(events(s, d).select("y", "x", F.coalesce(geometry.pixel_at(F.col("x") * 3.5 - 20, F.lit(10.0), F.lit(2.0), F.lit(100)), F.lit(-1)).alias("inside"), geometry.pixel_near(F.col("x") * 3.5 - 20, F.lit(10.0), F.lit(2.0), F.lit(100)).alias("near"), geometry.zoomed(F.lit(2.0), F.lit(10.0), color.d("x"), color.d("y") * 4).alias("z"), geometry.quad_mean(*[color.d(c) for c in CHANNELS]).alias("quad")).select("y", "x", "inside", "near", "z.*", "quad")),
    f"WITH {EVENTS}, t AS (SELECT *, floor((x * 3.5::DOUBLE - 20 - 10) / 2)::BIGINT AS k, least(256.0::DOUBLE, greatest(0.01::DOUBLE, y::DOUBLE * 4)) AS sc FROM px) SELECT y, x, CASE WHEN k >= 0 AND k < 100 THEN k ELSE -1 END AS inside, greatest(0, least(99, k))::BIGINT AS near, {s6('sc', 'scale')}, {s6('x - (x - 10.0::DOUBLE) / 2.0::DOUBLE * sc', '\"offset\"')}, {s6('(r::DOUBLE + g::DOUBLE + b::DOUBLE + a::DOUBLE) / 4', 'quad')} FROM t",
)
add("csv_cells", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", text.csv_cell("props").alias("cell"), text.strip_extension(F.concat_ws(".", "event_type", "props")).alias("stem")), """SELECT event_id, CASE WHEN regexp_matches(props, '[",\r\n]') THEN '"' || replace(props, '"', '""') || '"' ELSE props END AS cell, regexp_replace(concat_ws('.', event_type, props), '\\.[^.]+$', '') AS stem FROM events""")
add("mime_ranks", lambda s, d: s.createDataFrame([(t,) for t in (*text.EXTENSIONS, "application/octet-stream", "text/html", "")], "type string").select("type", text.mime_rank(F.col("type")).alias("rank"), text.mime_extension(F.col("type")).alias("extension")), "WITH t(type, extension) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in text.EXTENSIONS.items()) + ", ('application/octet-stream', NULL), ('text/html', NULL), ('', NULL)) SELECT type, (CASE WHEN regexp_matches(type, 'exr|radiance|hdr') THEN 0 WHEN type IN ('', 'application/octet-stream') THEN 1 WHEN type = 'image/png' THEN 2 WHEN type LIKE 'image/%' THEN 3 ELSE 4 END)::INTEGER AS rank, extension FROM t")
add("base64url", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", share.base64url(F.col("c_name")).alias("packed")), "SELECT c_custkey, rtrim(translate(base64(encode(c_name)), '+/', '-_'), '=') AS packed FROM customer")
# --- pickers and rectangles ------------------------------------------------------------------------------------------
add("picker_values", lambda s, d: rounded(pick.picker_values(events(s, d), _pickers(s))), f"WITH {EVENTS}, {PICKERS} SELECT picker_id, k.image_id, k.x, k.y, {', '.join(s6(W[c].replace(f'{c}:', f'p.{c}:').replace(' a:', ' p.a:').replace('(r:', '(p.r:'), c) for c in CHANNELS)} FROM px p JOIN pickers k ON p.x = k.x AND p.y = k.y")
add("picker_csv", lambda s, d: pick.picker_csv(events(s, d), _pickers(s), s.createDataFrame([("events", 'an "image", new')], "image_id string, name string"), "rgb", "srgb255"), f"WITH {EVENTS}, {PICKERS} SELECT picker_id, concat_ws(',', 'P' || picker_id, '\"an \"\"image\"\", new\"', k.x, k.y, 'srgb255', 'RGB', {', '.join(s255(D[c]) for c in 'rgb')}) AS line FROM px p JOIN pickers k ON p.x = k.x AND p.y = k.y")
add("picker_next_id", lambda s, d: pick.next_id(_pickers(s)), f"WITH {PICKERS} SELECT min(k)::BIGINT AS picker_id FROM range(1, 22) t(k) WHERE k NOT IN (SELECT picker_id FROM pickers)")
add("picker_next_color", lambda s, d: pick.next_color(_pickers(s)), f"WITH {PICKERS}, palette(k, color) AS (VALUES {', '.join(f'({k}, {c!r})' for k, c in enumerate(pick.PICKER_COLORS))}) SELECT coalesce(arg_min(color, k), '{pick.PICKER_COLORS[0]}') AS color FROM palette WHERE color NOT IN (SELECT color FROM pickers)")
add("picker_toggle", lambda s, d: pick.toggled(_pickers(s), s.createDataFrame([(5, "events", 3, 2, "#69f28d"), (6, "events", 7, 7, "#c77dff")], "picker_id int, image_id string, x int, y int, color string")), f"WITH {PICKERS} SELECT * FROM pickers WHERE NOT (x = 3 AND y = 2) UNION ALL SELECT 6, 'events', 7, 7, '#c77dff'")
add("picker_bounds", lambda s, d: pick.inside(_pickers(s), s.createDataFrame([("events", 50, 10)], "image_id string, width int, height int")), f"WITH {PICKERS} SELECT * FROM pickers WHERE x < 50 AND y < 10")
add("rect_clamp", lambda s, d: select.clamped_rects(s.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "value - 50 AS x", "user_id % 30 - 10 AS y", "event_id % 60 AS w", "event_id % 9 AS h", "100 AS width", "10 AS height")).select("event_id", *[F.col(c).cast("long").alias(c) for c in "xywh"]), "WITH t AS (SELECT event_id, greatest(0, least(99, floor(value - 50)))::BIGINT AS x, greatest(0, least(9, user_id % 30 - 10))::BIGINT AS y, event_id % 60 AS w, event_id % 9 AS h FROM events) SELECT event_id, x, y, greatest(1, least(CASE WHEN w = 0 THEN 1 ELSE w END, 100 - x))::BIGINT AS w, greatest(1, least(CASE WHEN h = 0 THEN 1 ELSE h END, 10 - y))::BIGINT AS h FROM t")
add("rect_join", lambda s, d: rounded(pick.rect_join(events(s, d), _rects(s))), f"WITH {EVENTS}, {RECTS} SELECT rect_id, p.image_id, (p.y - k.y)::INTEGER AS y, (p.x - k.x)::INTEGER AS x, {', '.join(s6(f'p.{c}', c) for c in CHANNELS)} FROM px p JOIN rects k ON p.x BETWEEN k.x AND k.x + width - 1 AND p.y BETWEEN k.y AND k.y + height - 1")
# --- programs --------------------------------------------------------------------------------------------------------
_PX = lambda body: f"WITH {EVENTS} SELECT image_id, y, x, {body} FROM px"
add("passthrough", lambda s, d: rounded(stencil.mapped(events(s, d), **{c: c for c in CHANNELS})), _PX(", ".join(s6(c, c) for c in CHANNELS)))
add("exposure_ev", lambda s, d: rounded(generate.exposure(events(s, d))), _PX(", ".join(_f6(f"{D[c]} * 2", c) for c in "rgb") + ", " + s6("a", "a")))
add("brightness", lambda s, d: rounded(generate.brightness(events(s, d), 0.5)), _PX(", ".join(_f6(f"{D[c]} * 0.5::DOUBLE", c) for c in "rgb") + ", " + s6("a", "a")))
add("grayscale", lambda s, d: rounded(generate.grayscale(events(s, d))), _PX(", ".join(_f6(slum(), c) for c in "rgb") + ", " + s6("a", "a")))
add("channel_swap", lambda s, d: rounded(generate.bgra(events(s, d))), _PX(f"{s6('b', 'r')}, {s6('g', 'g')}, {s6('r', 'b')}, {s6('a', 'a')}"))
add("program_expression", lambda s, d: rounded(stencil.mapped(events(s, d), r="r * u", g="g * v", b="1 - b", a="a")), f"WITH {EVENTS}, dims AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px) SELECT image_id, y, x, {_f6('r::DOUBLE * ((x + 0.5::DOUBLE) / w)', 'r')}, {_f6('g::DOUBLE * ((y + 0.5::DOUBLE) / h)', 'g')}, {_f6('1 - b::DOUBLE', 'b')}, {s6('a', 'a')} FROM px, dims")
add("blur3", lambda s, d: rounded(stencil.blur_3(events(s, d))), _blur_sql(1, 0, 3.0))
add("box_blur_r2", lambda s, d: rounded(stencil.box_blur(events(s, d), 2)), _blur_sql(2, 2, 25.0))
add("sobel", lambda s, d: rounded(stencil.sobel(events(s, d))), SOBEL)
add("resample_bilinear", lambda s, d: (lambda px: rounded(stencil.resampled(px, *_size(px), 30, 20)))(events(s, d)), RESAMPLE)
add("gradient", lambda s, d: rounded(generate.gradient(s, 64, 48)), _generated_sql(64, 48, f"{_f6('u', 'r')}, {_f6('v', 'g')}, {s6('0', 'b')}, {s6('1', 'a')}"))
_LIGHT, _STRIPES = "40.0::DOUBLE / (1.0::DOUBLE + (cx * cx + cy * cy) * 900.0::DOUBLE)", "0.5::DOUBLE + 0.5::DOUBLE * cos((cx * cos(radians(20.0::DOUBLE)) + cy * sin(radians(20.0::DOUBLE))) * (24.0::DOUBLE * 6.28318530718::DOUBLE))"
add("radial_light", lambda s, d: rounded(generate.radial_light(s, 64, 48)), _generated_sql(64, 48, ", ".join(_f6(_LIGHT, c) for c in "rgb") + ", " + s6("1", "a")))
add("cosine_stripes", lambda s, d: rounded(generate.cosine_stripes(s, 64, 48)), _generated_sql(64, 48, ", ".join(_f6(_STRIPES, c) for c in "rgb") + ", " + s6("1", "a")))
# --- texts and files -------------------------------------------------------------------------------------------------
add("matrix_preview", lambda s, d: (lambda px: matrix.preview(px, *_size(px), channels=(0, 1, 2), encoding="srgb255"))(events(s, d)), f"""WITH {EVENTS}, dims AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px),
lines AS (SELECT image_id, y, string_agg('(' || concat_ws(',', {", ".join(s255(D[c]) for c in "rgb")}) || ')', ',' ORDER BY x) || ',…,' AS line FROM px WHERE y < 8 AND x < 12 GROUP BY image_id, y)
SELECT * FROM lines UNION ALL SELECT 'events', 8, '… Preview: first 12 x 8 of ' || w || ' x ' || h || '. Copy Matrix copies all values.' FROM dims""")  # fmt: skip


def _value_matrix_roundtrip(s: SparkSession, d: str) -> DataFrame:
    return matrix.read_rows(matrix.rows_of(tiles(s, d)), 50, [0, 1, 2, 3])


def _file_roundtrip(kind: str, source: Query = tiles) -> Query:
    """All tiles as a file each, read back."""

    def query(s: SparkSession, d: str) -> DataFrame:
        encoded = files.encoded_files(source(s, d), kind).select(F.col("image_id").alias("path"), "content", F.lit("raster" if kind == "png" else kind.removesuffix("-zip")).alias("kind"))
        return encoded.mapInPandas(files._strips, files.DECODED).select("image_id", "width", "y0", "strip").mapInPandas(files._explode, files.PIXEL_DDL)

    return query


_WHOLE = f"WITH {TILES} SELECT image_id, y, x, {', '.join(s6(c, c) for c in CHANNELS)} FROM px"
add("value_matrix_roundtrip", lambda s, d: rounded(_value_matrix_roundtrip(s, d)), _WHOLE)
add("gray_matrix_roundtrip", lambda s, d: rounded(matrix.read_rows(matrix.rows_of(tiles(s, d), channels=(0,)), 50)), f"WITH {TILES} SELECT image_id, y, x, {', '.join(s6('r', c) for c in 'rgb')}, {s6('1', 'a')} FROM px")
add("exr_roundtrip", lambda s, d: rounded(_file_roundtrip("exr")(s, d)), _WHOLE)
add("exr_zip_roundtrip", lambda s, d: rounded(_file_roundtrip("exr-zip")(s, d)), _WHOLE)
add("png_roundtrip", lambda s, d: rounded(_file_roundtrip("png")(s, d)), f"WITH {TILES} SELECT image_id, y, x, {', '.join(_f6(sto_linear(f'({sbyte(D[c])} / 255.0::DOUBLE)::FLOAT::DOUBLE'), c) for c in 'rgb')}, {_f6(sround(sclamp(D['a']) + ' * 255') + ' / 255.0::DOUBLE', 'a')} FROM px")
add("selection_csv", lambda s, d: files.selection_rows(events(s, d), Rect(0, 0, WIDTH, 1 << 30), "rgb", "srgb255"), f"WITH {EVENTS} SELECT x, y, 'srgb255' AS mode, 'RGB' AS display, {', '.join(f'({s255(D[c])})::VARCHAR AS {c}' for c in 'rgb')} FROM px")
add("css_color", lambda s, d: pick.css_color(nonfinite(s, d), "rgb"), f"WITH {NONFINITE} SELECT image_id, y, x, concat('rgb(', concat_ws(' ', {', '.join(s255(D[c]) for c in 'rgb')}), ')') AS css FROM px")


def _image_pickers(s: SparkSession, d: str) -> DataFrame:
    """A picker for every hundredth event, dealt to images of 500."""
    e = s.read.parquet(f"{d}/events.parquet").filter("event_id % 100 = 0")
    picker = F.expr("named_struct('picker_id', CAST(event_id div 100 AS int), 'x', CAST(event_id % 50 AS int), 'y', CAST((event_id % 500) div 50 AS int), 'color', '#ff365e')")
    return e.groupBy(F.expr("CAST(event_id div 500 AS string)").alias("image_id")).agg(F.collect_list(picker).alias("pickers"))


_ALL_PICKERS = "k AS (SELECT (event_id // 500)::VARCHAR AS image_id, (event_id // 100)::INTEGER AS picker_id, (event_id % 50)::INTEGER AS x, ((event_id % 500) // 50)::INTEGER AS y, '#ff365e' AS color FROM events WHERE event_id % 100 = 0)"
add("all_pickers", lambda s, d: pick.of_images(_image_pickers(s, d)), f"WITH {_ALL_PICKERS} SELECT * FROM k")
add("picker_remove", lambda s, d: pick.cleared(pick.removed(pick.of_images(_image_pickers(s, d)), 0, 3), "1"), f"WITH {_ALL_PICKERS} SELECT * FROM k WHERE picker_id NOT IN (0, 3) AND image_id <> '1'")
add("picker_largest_id", lambda s, d: pick.largest_id(pick.of_images(_image_pickers(s, d))), f"WITH {_ALL_PICKERS} SELECT max(picker_id) AS picker_id FROM k")


def _generated_pickers(s: SparkSession, d: str) -> DataFrame:
    """Two generated images of a catalog, joined to pickers by their ids."""
    catalog = Catalog(s)
    catalog.generate("it's one", 64, 48, r="u", g="v")
    catalog.generate("two", 32, 24, r="1 - u", b="v")
    both = select.append(*catalog.frames.values())
    pickers = s.createDataFrame([(1, "it's one", 3, 2), (2, "two", 3, 2), (3, "two", 31, 23)], "picker_id int, image_id string, x int, y int")
    return pick.picker_values(both, pickers, "rgba")


add("generated_pickers", lambda s, d: rounded(_generated_pickers(s, d)), f"SELECT picker_id, image_id, x, y, {s6('r::FLOAT', 'r')}, {s6('g::FLOAT', 'g')}, {s6('b::FLOAT', 'b')}, {s6('1', 'a')} FROM (VALUES (1::INTEGER, 'it''s one', 3::INTEGER, 2::INTEGER, 3.5::DOUBLE / 64, 2.5::DOUBLE / 48, 0::DOUBLE), (2, 'two', 3, 2, 1 - 3.5::DOUBLE / 32, 0, 2.5::DOUBLE / 24), (3, 'two', 31, 23, 1 - 31.5::DOUBLE / 32, 0, 23.5::DOUBLE / 24)) t(picker_id, image_id, x, y, r, g, b)")


def _points(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select(F.lit("events").alias("image_id"), F.expr("(event_id % 10) / 9D").alias("u"), F.expr("(user_id % 8) / 8D").alias("v"))


add("sampled_points", lambda s, d: (lambda px: rounded(stencil.sampled(_points(s, d), px, *_size(px))))(events(s, d)), RESAMPLE.replace("grid AS (SELECT (k // 30)::INTEGER AS y, (k % 30)::INTEGER AS x FROM range(600) t(k))", "grid AS (SELECT event_id, (event_id % 10) / 9::DOUBLE AS u, (user_id % 8) / 8::DOUBLE AS v FROM events)").replace("SELECT y, x, h, w", "SELECT event_id, u, v, h, w").replace("(x + 0.5::DOUBLE) / 30", "u").replace("(y + 0.5::DOUBLE) / 20", "v").replace("SELECT y, x, least", "SELECT event_id, u, v, least").replace("SELECT p.image_id, c.y, c.x,", "SELECT image_id, u, v, r, g, b, a FROM (SELECT p.image_id, event_id, " + s6("u", "u") + ", " + s6("v", "v") + ",") + ")")
add("share_roundtrip", lambda s, d: s.createDataFrame([tuple(share.decode(share.encode(64, 32, "r = u; é")).values())], "width int, height int, code string"), "SELECT 64::INTEGER AS width, 32::INTEGER AS height, 'r = u; é' AS code")
