import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe import program_queries
from lumaframe.plans import share
from lumaframe.plans.catalog import Catalog, Image, ProgramError
from lumaframe.programs.evaluate import as_arrays, as_columns
from lumaframe.programs.lower import Lowering, compile_program
from lumaframe.programs.run import generated, shade
from lumaframe.programs.text import ShaderError, parse
from lumaframe.schema import PIXELS

from .oracle import same


@pytest.mark.parametrize("name", sorted(program_queries.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    same(spark, sf, program_queries.QUERIES[name], program_queries.ORACLE_SQL[name])


def image(spark, width, height, seed=1, image_id="a"):
    values = np.random.default_rng(seed).random((height, width, 4), np.float32)
    rows = [(image_id, y, x, *map(float, values[y, x])) for y in range(height) for x in range(width)]
    return values.astype(np.float64), spark.createDataFrame(rows, PIXELS).repartition(3)


def result(frame, width, height):
    out = np.full((height, width, 4), np.nan)
    rows = frame.collect()
    assert len(rows) == width * height
    for r in rows:
        out[r["y"], r["x"]] = r["r"], r["g"], r["b"], r["a"]
    return out


def one(code, **inputs):
    """outputColor of one pixel."""
    program = compile_program(code)
    given = {c: np.array([0.5]) for c in "rgba"} | {"u": np.array([0.25]), "v": np.array([0.75]), "width": 4.0, "height": 2.0, "x": np.array([0]), "y": np.array([1])} | {k: np.array([v]) for k, v in inputs.items()}
    return [float(c[0]) for c in as_arrays(program.graph, program.out, given, None, 1)]


# --- texts -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("code", "line", "column", "part"),
    [
        ("outputColor = inputColor * 2;", 1, 26, "vec4 and int"), ("float x = 1;", 1, 7, "float"), ("vec3 a = uv;", 1, 6, "vec2"), ("outputColor = blur(uv);", 1, 15, "not a function"),
        ("outputColor.q = 1.0", 1, 20, "';'"), ("outputColor.xz = vec2(1.0);\nuv.xx = uv;", 2, 3, "named twice"), ("\n\n  float y = missing;", 3, 13, "not declared"), ("float uv = 1.0;", 1, 7, "already"),
        ("float a = 1.0;\nfloat a = 2.0;", 2, 7, "already"), ("const float k = 1.0;\nk = 2.0;", 2, 1, "can't be changed"), ("resolution.x = 1.0;", 1, 11, "can't be changed"),
        ("int i = 0;\nwhile (uv.x < float(i)) i++;", 2, 13, "constants"), ("for (;;) {}", 1, 1, "rounds"), ("break;", 1, 1, "outside"), ("if (1.0) {}", 1, 5, "bool"), ("outputColor = vec4(1.0;", 1, 23, "')'"),
        ("vec4 a = vec4(1.0, 2.0);", 1, 10, "components"), ("float s[2] = float[2](1.0);", 1, 14, "2 values"), ("float s[2]; s[2] = 1.0;", 1, 14, "not in"), ("outputColor = inputColor.rgbx;", 1, 25, "component"),
        ("float a = sin(1);", 1, 11, "sin can't take (int)"), ("int a = 5 % 2.0;", 1, 11, "int and float"), ("/* no end", 1, 1, "end"), ("float a = 1.0 @ 2.0;", 1, 15, "'@'"), ("#version 300 es", 1, 1, "directive"), ("{ float a = 1.0;", 1, 17, "'}'"),
        ("float a = uv.x > 0.5 ? 1.0 : 2;", 1, 22, "one type"), ("outputColor", 1, 12, "';'"), ("float a = texture(inputTexture, 0.5).r;", 1, 11, "texture can't take"), ("vec2 a = mat3(1.0) * uv;", 1, 20, "mat3 and vec2"),
        ("#define ONE 1.0\n#define F(x) (x + 1.0)\n\nfloat a = F(ONE, ONE);", 4, 11, "takes 1"), ("int k = 0; int b = true && k++ > 0 ? 1 : 2;", 1, 25, "right of"), ("float " + "a" + " = " + "(" * 100 + "1.0" + ")" * 100 + ";", 1, 50, "nested"),
    ],
)
def test_errors_name_the_place(code, line, column, part):
    with pytest.raises(ShaderError) as e:
        compile_program(code)
    assert (e.value.line, e.value.column) == (line, column) and part in str(e.value)


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("outputColor = vec4(1.0, 2., .5, 1e1);", (1, 2, 0.5, 10)), ("int a = 0x1F; int b = 010; outputColor.xy = vec2(a, b);", (31, 8, 0, 1)), ("outputColor.x = float(7 / 2) + float(-7 / 2) * 10.0 + float(-7 % 3) * 100.0;", (-127, 0, 0, 1)),
        ("#define K 3\n#define SQ(x) ((x) * (x))\n#define TWICE(x) SQ(x) + SQ(x)\noutputColor.x = float(TWICE(K + 1));", (32, 0, 0, 1)), ("#define A 1.0\n#undef A\nfloat A = 2.0;\noutputColor.x = A;", (2, 0, 0, 1)),
        ("float a = 1.0; { float a = 5.0; a += 1.0; } outputColor.x = a;", (1, 0, 0, 1)), ("float a, b = 2.0; a = b = 3.0; outputColor.xy = vec2(a, b);", (3, 3, 0, 1)), ("int i = 3; int j = i++ + ++i; outputColor.xy = vec2(i, j);", (5, 8, 0, 1)),
        ("for (int i = 0; i < 10; i++) { if (i == 3) continue; if (i == 6) break; outputColor.x += float(i); }", (12, 0, 0, 1)), ("int k = 0; do { k++; } while (k < 5); outputColor.x = float(k);", (5, 0, 0, 1)), ("int k = 0; while (k < 7) k += 3; outputColor.x = float(k);", (9, 0, 0, 1)),
        ("outputColor.x = 1.0; if (uv.x < 0.5) return; outputColor.x = 2.0;", (1, 0, 0, 1)), ("outputColor.x = 1.0; if (uv.x > 0.5) return; outputColor.x = 2.0;", (2, 0, 0, 1)),
        ("for (int i = 0; i < 8; i++) { if (float(i) > uv.x * 20.0) break; outputColor.x += 1.0; }", (6, 0, 0, 1)), ("for (int i = 0; i < 4; i++) { if (uv.x < 0.5) { if (i == 2) continue; } outputColor.x += float(i); }", (4, 0, 0, 1)),
        ("for (int i = 0; i < 3; i++) for (int j = 0; j < 3; j++) { if (float(j) > uv.y) break; outputColor.x += 1.0; }", (3, 0, 0, 1)), ("outputColor.bgr = vec3(1.0, 2.0, 3.0);", (3, 2, 1, 1)), ("outputColor.stp = uv.yxy;", (0.75, 0.25, 0.75, 1)),
        ("float w[3] = float[](1.0, 2.0, 4.0); outputColor.x = w[int(uv.y * 2.0)] + float(w.xxx);", None), ("float w[3] = float[](1.0, 2.0, 4.0); w[int(uv.y * 3.0)] = 9.0; outputColor.xyz = vec3(w[0], w[1], w[2]);", (1, 2, 9, 1)),
        ("mat2 m = mat2(1.0, 2.0, 3.0, 4.0); outputColor.xy = m * vec2(1.0, 10.0); outputColor.zw = vec2(1.0, 10.0) * m;", (31, 42, 21, 43)), ("mat2 m = mat2(1.0, 2.0, 3.0, 4.0); mat2 n = m * inverse(m); outputColor = vec4(n[0], n[1]);", (1, 0, 0, 1)),
        ("mat3 m = mat3(2.0); outputColor.x = determinant(m); m[1].x = 5.0; outputColor.yzw = transpose(m)[0];", (8, 2, 5, 0)), ("outputColor = vec4(greaterThan(vec2(1.0, 2.0), vec2(1.5)), any(bvec2(true, false)), all(not(bvec2(false))));", (0, 1, 1, 1)),
        ("outputColor.xyz = cross(vec3(1.0, 0.0, 0.0), vec3(0.0, 1.0, 0.0)); outputColor.w = distance(vec2(0.0), vec2(3.0, 4.0));", (0, 0, 1, 5)), ("outputColor.xyz = mix(vec3(0.0), vec3(1.0, 2.0, 3.0), bvec3(true, false, true));", (1, 0, 3, 1)),
        ("outputColor.x = mod(-1.0, 3.0) + fract(-0.25) * 10.0 + trunc(-1.5) * 100.0 + round(2.4) * 1000.0;", (1909.5, 0, 0, 1)), ("outputColor.x = float((6 & 3) | (1 << 4) ^ 1) + float(~0) * 100.0 + float(-8 >> 1) * 1000.0;", (-4081, 0, 0, 1)),
        ("outputColor.xy = vec2(ivec2(2.9, -2.9)); outputColor.z = float(true) + float(bool(0.5)) * 10.0;", (2, -2, 11, 1)), ("outputColor.xy = gl_FragCoord.xy; outputColor.zw = vec2(textureSize(inputTexture, 0));", (0.5, 1.5, 4, 2)),
        ("outputColor.x = 2147483647 + 1 < 0 ? 1.0 : 0.0;", (1, 0, 0, 1)), ("vec2 a = vec2(3.0, 4.0); outputColor.x = a == vec2(3.0, 4.0) && !(a != a) ^^ false ? length(a) : 0.0;", (5, 0, 0, 1)), ("", (0, 0, 0, 1)), ("outputColor.x = 1.0 / 0.0 > 1e30 ? 1.0 : 0.0;", (1, 0, 0, 1)),
        ("outputColor.xyz = reflect(vec3(1.0, -1.0, 0.0), vec3(0.0, 1.0, 0.0)); outputColor.w = refract(vec2(0.0, -1.0), vec2(0.0, 1.0), 0.5).y;", (1, 1, 0, -1)), ("float a[2]; a[0] = 1.0; float b[2] = a; b[1] = 3.0; outputColor.xy = vec2(a[1], b[1]);", (0, 3, 0, 1)),
    ],
)
def test_values(code, want):
    if want is None:
        with pytest.raises(ShaderError):
            compile_program(code)
    else:
        assert one(code) == pytest.approx(want)


def test_rounds_are_limited_and_large_programs_refused():
    with pytest.raises(ShaderError, match="too large"):
        compile_program("float a = uv.x; for (int i = 0; i < 4000; i++) for (int j = 0; j < 4; j++) { a = sin(a) * cos(a) + a * a - uv.y; a = sqrt(a); } outputColor.x = a;")
    with pytest.raises(ShaderError, match="rounds"):
        compile_program("float a = 0.0; for (int i = 0; i < 5000; i++) a += 1.0;")
    with pytest.raises(ShaderError):
        parse("if " * 5000)


UNARY = ("sin", "cos", "abs", "floor", "ceil", "sqrt", "exp", "log", "sign", "fract", "trunc", "round", "asin", "atan", "tanh", "exp2", "log2", "inversesqrt", "-", "degrees")
BINARY = ("+", "-", "*", "/", "min", "max", "mod", "pow", "atan", "step")


def expression(rng, depth):
    if depth == 0:
        return rng.choice(("r", "g", "b", "a", "uv.x", "uv.y", "2.0", "0.5", "-1.5", "0.0", "float(i)", "float(j)"))
    kind = rng.random()
    if kind < 0.35:
        return f"{rng.choice(UNARY)}({expression(rng, depth - 1)})"
    if kind < 0.85:
        op, x, y = rng.choice(BINARY), expression(rng, depth - 1), expression(rng, depth - 1)
        return f"({x} {op} {y})" if len(op) == 1 else f"{op}({x}, {y})"
    if kind < 0.93:
        return f"({expression(rng, depth - 1)} {rng.choice(('<', '<=', '==', '!='))} {expression(rng, depth - 1)} ? {expression(rng, depth - 1)} : {expression(rng, depth - 1)})"
    return f"float((int({expression(rng, depth - 1)}) {rng.choice('+-*/%&|^')} (i {rng.choice('+-/%')} j)))"


def test_columns_and_arrays_agree(spark):
    """Random expressions, wherever all that they go through is finite; the language leaves the rest open."""
    rng = random.Random(11)
    low = Lowering(True)
    names = [f"e{k}" for k in range(120)]
    code = "float r = inputColor.r, g = inputColor.g, b = inputColor.b, a = inputColor.a; int i = int(r * 100.0), j = int(g * 7.0);\n" + "\n".join(f"float {n} = {expression(rng, 4)};" for n in names)
    low.scopes.append({})
    for s in parse(code):
        low.statement(s)
    out = {n: low.scopes[-1][n].value.parts[0] for n in names}
    values = [0.0, 1.0, -1.0, 0.3, 2.5, -7.25, math.inf, -math.inf, math.nan, 1e30]
    rows = [(k, *[rng.choice(values) for _ in range(4)], rng.random(), rng.random()) for k in range(60)]
    frame = spark.createDataFrame(rows, "x int, r double, g double, b double, a double, u double, v double").selectExpr("'i' AS image_id", "0 AS y", "*")
    got = {r["x"]: r for r in as_columns(frame, low.g, out).collect()}
    given = {c: np.array([r[k + 1] for r in rows]) for k, c in enumerate("rgbauv")}
    within = {n: [k for k in low.g.below([top]) if low.g.kind(k) == "float"] for n, top in out.items()}
    compared = 0
    for n, top in out.items():
        *steps, column = as_arrays(low.g, [*within[n], top], given, None, len(rows))
        finite = np.all(np.isfinite(np.array(steps)), axis=0) if steps else np.ones(len(rows), bool)
        have = np.array([got[k][n] for k in range(len(rows))], float)
        compared += finite.sum()
        assert np.allclose(have[finite], column[finite], rtol=1e-9, atol=1e-12), (n, code.split("\n")[int(n[1:]) + 1])
    assert compared > 1000


@pytest.mark.parametrize(("r", "want"), [(math.nan, (0, 0, 1, 1)), (math.inf, (0, 1, 0, 0)), (2.0, (1, 0, 0, 0)), (-1.0, (0, 0, 0, 1))])
def test_values_that_are_not_finite(spark, r, want):
    code = "float r = inputColor.r; outputColor = vec4(r < 3.0 && r > 0.0, isinf(r), isnan(r), !(r >= 0.0));"
    assert one(code, r=r) == list(want)
    frame = spark.createDataFrame([("a", 0, 0, r, 0.0, 0.0, 1.0)], PIXELS)
    assert tuple(shade(frame, code).first()[3:]) == want


# --- programs over images --------------------------------------------------------------------------------------------
def bilinear(values, u, v):
    h, w, _ = values.shape
    fx, fy = np.clip(u, -1, 2) * w - 0.5, np.clip(v, -1, 2) * h - 0.5
    x, y = np.floor(fx).astype(int), np.floor(fy).astype(int)
    at = lambda j, i: values[np.clip(j, 0, h - 1), np.clip(i, 0, w - 1)]
    tx, ty = (fx - x)[..., None], (fy - y)[..., None]
    return (at(y, x) * (1 - tx) + at(y, x + 1) * tx) * (1 - ty) + (at(y + 1, x) * (1 - tx) + at(y + 1, x + 1) * tx) * ty


def places(width, height):
    v, u = np.meshgrid((np.arange(height) + 0.5) / height, (np.arange(width) + 0.5) / width, indexing="ij")
    return u, v


@pytest.mark.parametrize(("width", "height"), [(1, 1), (3, 300), (290, 140)])
def test_fixed_distances_over_several_tiles(spark, width, height):
    values, frame = image(spark, width, height)
    code = "vec2 t = texelSize(); outputColor = sampleInput(uv + vec2(-3.0, 5.0) * t) - 2.0 * texture(inputTexture, uv + t * vec2(0.25, -1.5)) + vec4(uv, 0.0, inputColor.a);"
    u, v = places(width, height)
    want = bilinear(values, u - 3 / width, v + 5 / height) - 2 * bilinear(values, u + 0.25 / width, v - 1.5 / height)
    want[..., 0] += u
    want[..., 1] += v
    want[..., 3] += values[..., 3]
    assert np.allclose(result(shade(frame, code), width, height), want, atol=1e-5)


def test_a_reach_wider_than_a_tile(spark):
    values, frame = image(spark, 400, 3)
    assert np.allclose(result(shade(frame, "outputColor = sampleInput(uv - vec2(200.0, 0.0) / resolution);"), 400, 3), values[:, np.clip(np.arange(400) - 200, 0, 399)], atol=1e-6)


@pytest.mark.parametrize(("width", "height"), [(1, 1), (150, 140)])
def test_computed_places(spark, width, height):
    values, frame = image(spark, width, height)
    u, v = places(width, height)
    assert np.allclose(result(shade(frame, "outputColor = sampleInput(vec2(1.0 - uv.x, uv.y * uv.x)) + inputColor;"), width, height), bilinear(values, 1 - u, u * v) + values, atol=1e-5)


def test_places_that_depend_on_what_was_read_twice_over(spark):
    values, frame = image(spark, 140, 40)
    u, v = places(140, 40)
    first = bilinear(values, 1 - u, v)
    second = bilinear(values, first[..., 0], v)
    code = "vec4 a = sampleInput(vec2(1.0 - uv.x, uv.y)); vec4 b = sampleInput(vec2(a.r, uv.y)); outputColor = sampleInput(b.gb) + a;"
    assert np.allclose(result(shade(frame, code), 140, 40), bilinear(values, second[..., 1], second[..., 2]) + first, atol=1e-5)


def test_another_size(spark):
    values, frame = image(spark, 30, 20)
    u, v = places(140, 9)
    assert np.allclose(result(shade(frame, "outputColor = inputColor;", (140, 9)), 140, 9), bilinear(values, u, v), atol=1e-6)
    assert np.allclose(result(shade(frame, "outputColor = vec4(uv, inputResolution / resolution);", (140, 9)), 140, 9)[..., 2:], (30 / 140, 20 / 9), atol=1e-6)


def test_texel_fetch_is_0_outside(spark):
    values, frame = image(spark, 5, 4)
    out = result(shade(frame, "outputColor = texelFetch(inputTexture, ivec2(gl_FragCoord.xy) + ivec2(1, 0), 0);"), 5, 4)
    assert np.allclose(out[:, :4], values[:, 1:]) and not out[:, 4].any()


def test_many_images_of_different_sizes_and_clashing_columns(spark):
    (one, a), (two, b) = image(spark, 7, 5, 1, "a"), image(spark, 131, 6, 2, None)
    frame = a.unionByName(b).withColumns({c: F.lit(9) for c in ("u", "v", "width", "height", "in_width", "ty", "tx", "by", "bx", "image", "cells", "n5")})
    for code in ("outputColor = sampleInput(uv + 1.0 / resolution) * uv.x;", "outputColor = sampleInput(uv * uv);", "outputColor = inputColor * resolution.x;"):
        whole = shade(frame, code)
        assert whole.columns == PIXELS.names
        for values, image_id in ((one, "a"), (two, None)):
            h, w, _ = values.shape
            u, v = places(w, h)
            want = {"t": bilinear(values, u + 1 / w, v + 1 / h) * u[..., None], "*": bilinear(values, u * u, v * v), "p": values * w}[{"uv + ": "t", "uv * ": "*"}.get(code[26:31], "p")]
            assert np.allclose(result(whole.filter(F.col("image_id").eqNullSafe(image_id)), w, h), want, atol=1e-4)


@pytest.mark.parametrize("code", ["outputColor = inputColor * uv.x;", "outputColor = sampleInput(uv + texelSize());", "outputColor = sampleInput(uv.yx);"])
def test_no_images(spark, code):
    assert shade(spark.createDataFrame([], PIXELS), code).count() == 0


def test_long_programs_run_over_batches(spark):
    values, frame = image(spark, 9, 4)
    out = shade(frame, "vec3 c = inputColor.rgb; for (int i = 0; i < 60; i++) { if (c.r < 0.1 * float(i % 5)) { c = c.gbr; } else { c *= 0.99; } } outputColor.rgb = c;")
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    want = values[..., :3].copy()
    for i in range(60):
        low = want[..., 0] < 0.1 * (i % 5)
        want = np.where(low[..., None], np.roll(want, -1, axis=-1), want * 0.99)
    assert np.allclose(result(out, 9, 4)[..., :3], want, atol=1e-6)


def test_a_blur_is_one_shuffle_and_no_window(spark, sf):
    plan = program_queries.QUERIES["shader_blur_r8"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan


def test_alone_is_no_shuffle(spark, sf):
    plan = program_queries.QUERIES["shader_exposure"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_sizes_are_limited(spark):
    with pytest.raises(ValueError, match="8388608"):
        generated(spark, "outputColor = vec4(1.0);", 4096, 2049)
    far = spark.createDataFrame([("a", 0, 0, 1.0, 1.0, 1.0, 1.0), ("a", 99_999, 99_999, 1.0, 1.0, 1.0, 1.0)], PIXELS)
    with pytest.raises(Exception, match="8388608"):
        shade(far, "outputColor = inputColor * uv.x;").collect()


def test_generated_images_read_one_black_pixel(spark):
    assert {tuple(r[3:]) for r in generated(spark, "outputColor = inputColor + vec4(inputResolution, sampleInput(uv * 3.0).a, time);", 5, 3).collect()} == {(1.0, 1.0, 1.0, 1.0)}
    assert np.allclose(result(generated(spark, "outputColor = vec4(uv, 0.0, 1.0);", 4, 2), 4, 2)[1, 3], (0.875, 0.75, 0, 1))


# --- catalog ---------------------------------------------------------------------------------------------------------
def test_links_of_program_texts(spark):
    catalog = Catalog(spark)
    code = "// shared\nfloat k = uv.x * 2.0;\noutputColor = vec4(k);"
    assert catalog.open_link("shared", share.encode(4, 2, code))
    assert np.allclose(result(catalog.frames["shared"], 4, 2)[0, :, 0], [0.25, 0.75, 1.25, 1.75])
    assert share.decode(catalog.link_of("shared"))["code"] == code
    assert not catalog.open_link("none", "#other=1")


def test_a_link_that_cannot_be_used_shows_the_default_and_keeps_its_text(spark, tmp_path):
    catalog = Catalog(spark)
    assert catalog.open_link("broken", share.encode(4, 2, "outputColor = vec4(1.0)\n"))
    assert np.allclose(result(catalog.frames["broken"], 4, 2)[1, 3], (0.875, 0.75, 0, 1))
    assert "line 2, column 1" in catalog.images["broken"].program["error"]
    assert share.decode(catalog.link_of("broken"))["code"] == "outputColor = vec4(1.0)\n"
    catalog.save(str(tmp_path))
    back = Catalog.restore(spark, str(tmp_path))
    assert back.frames["broken"].count() == 8 and share.decode(back.link_of("broken"))["code"] == "outputColor = vec4(1.0)\n"


def test_program_texts_in_the_catalog(spark, tmp_path):
    values, frame = image(spark, 6, 4)
    catalog = Catalog(spark)
    catalog.add("a", frame, Image("a", 6, 4, {"kind": "embedded"}))
    catalog.program("a", text="outputColor = sampleInput(uv + vec2(texelSize().x, 0.0));")
    want = values[:, [1, 2, 3, 4, 5, 5]]
    assert np.allclose(result(catalog.frames["a"], 6, 4), want)
    with pytest.raises(ProgramError) as e:
        catalog.program("a", text="outputColor = inputColor;\noutputColor = missing;")
    assert (e.value.line, e.value.column) == (2, 15)
    assert np.allclose(result(catalog.frames["a"], 6, 4), want)
    catalog.save(str(tmp_path))
    assert np.allclose(result(Catalog.restore(spark, str(tmp_path)).frames["a"], 6, 4), want)
