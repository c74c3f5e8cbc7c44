"""Queries of program texts over the events raster, and their DuckDB SQL. Results are floats, rounded to six digits in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumaframe.programs.run import shade
from lumaframe.queries import EVENTS, TILES, events, rounded, slum, tiles
from lumaframe.queries import _f6 as f6
from lumaframe.schema import CHANNELS

TEXTS = {
    "passthrough": "outputColor = inputColor;",
    "exposure": "outputColor = inputColor;\noutputColor.rgb *= exp2(1.0);",
    "grayscale": "float grey = luminance(inputColor.rgb);\noutputColor = vec4(grey, grey, grey, inputColor.a);",
    "bgra": "outputColor = inputColor.bgra;",
    "blur3": "vec2 step1 = vec2(texelSize().x, 0.0);\noutputColor = (sampleInput(uv - step1) + inputColor + sampleInput(uv + step1)) / 3.0;",
    "box_blur": """
        #define RADIUS 2
        vec4 total = vec4(0.0);
        for (int dy = -RADIUS; dy <= RADIUS; dy++)
          for (int dx = -RADIUS; dx <= RADIUS; dx++)
            total += texture(inputTexture, uv + vec2(dx, dy) / inputResolution);
        outputColor = total / pow(float(2 * RADIUS + 1), 2.0);""",
    "blur_r8": """
        const int radius = 8;
        vec4 total = vec4(0.0);
        for (int dy = -radius; dy <= radius; ++dy) {
          for (int dx = -radius; dx <= radius; ++dx) { total += sampleInput(uv + vec2(float(dx), float(dy)) * texelSize()); }
        }
        outputColor = total / float((2 * radius + 1) * (2 * radius + 1));""",
    "sobel": """
        const float weight[3] = float[](1.0, 2.0, 1.0);
        vec2 slope = vec2(0.0);
        for (int k = -1; k <= 1; k++) {
          for (int side = -1; side <= 1; side += 2) {
            float s = float(side) * weight[k + 1];
            slope.x += s * luminance(sampleInput(uv + vec2(float(side), float(k)) * texelSize()).rgb);
            slope.y += s * luminance(sampleInput(uv + vec2(float(k), float(side)) * texelSize()).rgb);
          }
        }
        outputColor = vec4(vec3(length(slope)), inputColor.a);""",
    "gradient": "outputColor.xy = uv;",
    "radial_light": """
        vec2 from_middle = uv - vec2(0.5);
        from_middle.x *= resolution.x / resolution.y;
        outputColor = vec4(vec3(40.0 / (1.0 + 900.0 * dot(from_middle, from_middle))), 1.0);""",
    "cosine_stripes": """
        vec2 from_middle = (uv - 0.5) * vec2(resolution.x / resolution.y, 1.0);
        vec2 along = vec2(cos(radians(20.0)), sin(radians(20.0)));
        outputColor.rgb = vec3(0.5 + 0.5 * cos(24.0 * 6.28318530718 * dot(along, from_middle)));""",
    "swirl": """
        // The image turned about its middle, the more the nearer.
        vec2 p = uv - 0.5;
        float angle = 4.0 * (1.0 - smoothstep(0.0, 0.5, length(p)));
        mat2 turn = mat2(cos(angle), sin(angle), -sin(angle), cos(angle));
        outputColor = sampleInput(turn * p + 0.5);""",
    "displaced": """
        // Places that depend on what was read.
        vec4 first = texture(inputTexture, vec2(1.0 - uv.x, uv.y));
        outputColor = sampleInput(uv + 0.2137 * (first.gb - 0.5));""",
    "orbit": """
        vec2 c = uv * vec2(3.0, 2.4) - vec2(2.2, 1.2), z = vec2(0.0);
        int rounds = 0;
        for (int k = 0; k < 40; k++) {
          if (dot(z, z) > 4.0) break;
          z = vec2(z.x * z.x - z.y * z.y, 2.0 * z.x * z.y) + c;
          rounds++;
        }
        outputColor = vec4(float(rounds) / 40.0, rounds == 40 ? inputColor.r : 0.0, float(rounds % 3), 1.0);""",
    "branches": """
        vec3 c = inputColor.rgb;
        if (c.r > 1.0) { c = c / (1.0 + c); } else if (c.b < 0.0) { c.b = abs(c.b); c.rg = c.gr; }
        else c = mix(c, vec3(luminance(c)), step(0.5, inputColor.a));
        outputColor = vec4(linearToSrgb(c), clamp(inputColor.a, 0.25, 0.75));""",
    "texel_size": "outputColor = vec4(texelSize() * gl_FragCoord.xy, resolution.x / resolution.y, 1.0);",
    "half_size": "outputColor = (sampleInput(uv - 0.25 / resolution) + sampleInput(uv + 0.25 / resolution)) * 0.5;",
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Pixels with the size of their image and their places.
PLACES = "dims AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY image_id), placed AS (SELECT px.*, w, h, (x + 0.5::DOUBLE) / w AS u, (y + 0.5::DOUBLE) / h AS v FROM px JOIN dims USING (image_id))"
#: From asked(image_id, y, x, k, su, sv, w, h): taken(image_id, y, x, k, r, g, b, a), read between pixel centres.
TAKEN = """f AS (SELECT image_id, y, x, k, w, h, least(greatest(su, -1), 2) * w - 0.5::DOUBLE AS fx, least(greatest(sv, -1), 2) * h - 0.5::DOUBLE AS fy FROM asked),
corners AS (SELECT image_id, y, x, k, least(greatest(floor(fy) + dy, 0), h - 1)::INTEGER AS sy, least(greatest(floor(fx) + dx, 0), w - 1)::INTEGER AS sx, abs(1 - dx - (fx - floor(fx))) * abs(1 - dy - (fy - floor(fy))) AS weight FROM f, range(2) p(dx), range(2) q(dy)),
taken AS (SELECT c.image_id, c.y, c.x, c.k, sum(weight * p.r::DOUBLE) AS r, sum(weight * p.g::DOUBLE) AS g, sum(weight * p.b::DOUBLE) AS b, sum(weight * p.a::DOUBLE) AS a FROM corners c JOIN px p ON p.image_id = c.image_id AND p.y = sy AND p.x = sx GROUP BY c.image_id, c.y, c.x, c.k)"""


def channels(**values: str) -> str:
    return ", ".join(f6(values[c], c) for c in CHANNELS)


def add(name: str, sql: str, source: Query = events, size: tuple[int, int] | None = None) -> None:
    QUERIES[f"shader_{name}"] = lambda s, d: rounded(shade(source(s, d), TEXTS[name], size))
    ORACLE_SQL[f"shader_{name}"] = sql


def _alone(body: str) -> str:
    return f"WITH {EVENTS}, {PLACES} SELECT image_id, y, x, {body} FROM placed"


def _blurred(rx: int, ry: int, n: float, source: str = EVENTS) -> str:
    return f"""WITH {source}, {PLACES}, near AS (SELECT image_id, y, x, least(greatest(y + j, 0), h - 1) AS sy, least(greatest(x + i, 0), w - 1) AS sx FROM placed, range({-rx}, {rx + 1}) p(i), range({-ry}, {ry + 1}) q(j))
SELECT k.image_id, k.y, k.x, {channels(**{c: f"sum(p.{c}::DOUBLE) / {n}::DOUBLE" for c in CHANNELS})} FROM near k JOIN px p ON p.image_id = k.image_id AND p.y = sy AND p.x = sx GROUP BY k.image_id, k.y, k.x"""


_GREY = {c: slum() for c in "rgb"}
add("passthrough", _alone(channels(**{c: c for c in CHANNELS})))
add("exposure", _alone(channels(**{c: f"2 * {c}::DOUBLE" for c in "rgb"}, a="a")))
add("grayscale", _alone(channels(**_GREY, a="a")))
add("bgra", _alone(channels(r="b", g="g", b="r", a="a")))
add("blur3", _blurred(1, 0, 3.0))
add("box_blur", _blurred(2, 2, 25.0))
add("blur_r8", _blurred(8, 8, 289.0))
QUERIES["shader_tiles_blur"] = lambda s, d: rounded(shade(tiles(s, d), TEXTS["box_blur"]))
ORACLE_SQL["shader_tiles_blur"] = _blurred(2, 2, 25.0, TILES)
add("sobel", f"""WITH {EVENTS}, {PLACES}, offs(dx, dy, kx, ky) AS (VALUES (-1,-1,-1,-1),(0,-1,0,-2),(1,-1,1,-1),(-1,0,-2,0),(1,0,2,0),(-1,1,-1,1),(0,1,0,2),(1,1,1,1)),
near AS (SELECT image_id, y, x, a, kx, ky, least(greatest(y + dy, 0), h - 1) AS sy, least(greatest(x + dx, 0), w - 1) AS sx FROM placed, offs),
slopes AS (SELECT k.image_id, k.y, k.x, k.a, sum(kx * {slum("p.")}) AS gx, sum(ky * {slum("p.")}) AS gy FROM near k JOIN px p ON p.y = sy AND p.x = sx GROUP BY ALL)
SELECT image_id, y, x, {channels(**{c: "sqrt(gx * gx + gy * gy)" for c in "rgb"}, a="a")} FROM slopes""")
add("gradient", _alone(channels(r="u", g="v", b="0", a="1")))
_CX, _CY = "((u - 0.5::DOUBLE) * (w / h))", "(v - 0.5::DOUBLE)"
add("radial_light", _alone(channels(**{c: f"40.0::DOUBLE / (1.0::DOUBLE + 900.0::DOUBLE * ({_CX} * {_CX} + {_CY} * {_CY}))" for c in "rgb"}, a="1")))
add("cosine_stripes", _alone(channels(**{c: f"0.5::DOUBLE + 0.5::DOUBLE * cos(24.0::DOUBLE * 6.28318530718::DOUBLE * (cos(radians(20.0::DOUBLE)) * {_CX} + sin(radians(20.0::DOUBLE)) * {_CY}))" for c in "rgb"}, a="1")))
add("swirl", f"""WITH {EVENTS}, {PLACES}, polar AS (SELECT *, u - 0.5::DOUBLE AS px_, v - 0.5::DOUBLE AS py_, least(greatest(sqrt((u - 0.5::DOUBLE) * (u - 0.5::DOUBLE) + (v - 0.5::DOUBLE) * (v - 0.5::DOUBLE)) / 0.5::DOUBLE, 0), 1) AS t FROM placed),
turned AS (SELECT *, 4 * (1 - t * t * (3 - 2 * t)) AS angle FROM polar),
asked AS (SELECT image_id, y, x, 0 AS k, w, h, cos(angle) * px_ - sin(angle) * py_ + 0.5::DOUBLE AS su, sin(angle) * px_ + cos(angle) * py_ + 0.5::DOUBLE AS sv FROM turned), {TAKEN}
SELECT image_id, y, x, {channels(**{c: c for c in CHANNELS})} FROM taken""")
add("displaced", f"""WITH {EVENTS}, {PLACES}, mirrored AS (SELECT p.*, m.g::DOUBLE AS mg, m.b::DOUBLE AS mb FROM placed p JOIN px m ON m.image_id = p.image_id AND m.y = p.y AND m.x = p.w - 1 - p.x),
asked AS (SELECT image_id, y, x, 0 AS k, w, h, u + 0.2137::DOUBLE * (mg - 0.5::DOUBLE) AS su, v + 0.2137::DOUBLE * (mb - 0.5::DOUBLE) AS sv FROM mirrored), {TAKEN}
SELECT image_id, y, x, {channels(**{c: c for c in CHANNELS})} FROM taken""")
add("orbit", f"""WITH RECURSIVE {EVENTS}, {PLACES}, z AS (SELECT image_id, y, x, r, u * 3.0::DOUBLE - 2.2::DOUBLE AS cx, v * 2.4::DOUBLE - 1.2::DOUBLE AS cy, 0::DOUBLE AS zx, 0::DOUBLE AS zy, 0 AS rounds FROM placed
UNION ALL SELECT image_id, y, x, r, cx, cy, zx * zx - zy * zy + cx, 2.0::DOUBLE * zx * zy + cy, rounds + 1 FROM z WHERE rounds < 40 AND zx * zx + zy * zy <= 4),
ended AS (SELECT image_id, y, x, any_value(r) AS r, max(rounds) AS n FROM z GROUP BY image_id, y, x)
SELECT image_id, y, x, {channels(r="n / 40::DOUBLE", g="CASE WHEN n = 40 THEN r ELSE 0 END", b="n % 3", a="1")} FROM ended""")
_SRGB = lambda v: f"(CASE WHEN greatest({v}, 0) < 0.0031308 THEN greatest({v}, 0) * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow(greatest({v}, 0), 1 / 2.4::DOUBLE) - 0.055::DOUBLE END)"
_FLAT = lambda c, other: f"(CASE WHEN r > 1 THEN {c}::DOUBLE / (1 + {c}::DOUBLE) WHEN b < 0 THEN {other}::DOUBLE WHEN a >= 0.5 THEN {slum()} ELSE {c}::DOUBLE END)"
add("texel_size", _alone(channels(r="u", g="v", b="w / h", a="1")))
add("branches", _alone(channels(r=_SRGB(_FLAT("r", "g")), g=_SRGB(_FLAT("g", "r")), b=_SRGB(_FLAT("b", "-b")), a="least(greatest(a, 0.25), 0.75)")))
#: Each image of 50 x 10 pixels becomes one of 25 x 20.
QUERIES["shader_resized_tiles"] = lambda s, d: rounded(shade(tiles(s, d), TEXTS["half_size"], (25, 20)))
ORACLE_SQL["shader_resized_tiles"] = f"""WITH {TILES}, {PLACES}, grid AS (SELECT image_id, w, h, j::INTEGER AS y, i::INTEGER AS x FROM dims, range(25) p(i), range(20) q(j)),
asked AS (SELECT image_id, y, x, k, w, h, (x + 0.5::DOUBLE) / 25 + (k - 0.5::DOUBLE) * 0.5::DOUBLE / 25 AS su, (y + 0.5::DOUBLE) / 20 + (k - 0.5::DOUBLE) * 0.5::DOUBLE / 20 AS sv FROM grid, range(2) t(k)), {TAKEN}
SELECT image_id, y, x, {channels(**{c: f"sum({c}) * 0.5::DOUBLE" for c in CHANNELS})} FROM taken GROUP BY image_id, y, x"""
