import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.operators import aggregate, display, generate, pick, select, stencil
from lumaframe.queries import nonfinite
from lumaframe.schema import PIXELS, Rect

NAN, INF = float("nan"), float("inf")


def image(spark, a, image_id="i"):
    h, w = a.shape[:2]
    rows = [(image_id, y, x, *map(float, a[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, PIXELS)


def array(df, h, w, names="rgba"):
    out = np.zeros((h, w, len(names)))
    for r in df.collect():
        out[r["y"], r["x"]] = [r[c] for c in names]
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(1).normal(0.4, 0.5, (7, 9, 4)).astype(np.float32)


def test_stats_of_nothing_finite(spark):
    px = image(spark, np.full((1, 2, 4), np.nan))
    s = aggregate.selection_stats(px).first()
    assert s["count"] == 2 and s["min_r"] == s["avg_lum"] == 0
    r = aggregate.image_range(px).first()
    assert r["rgb_min"] == r["rgb_max"] == 0
    assert aggregate.selection_stats(px.limit(0)).count() == 0


def test_weighted_stats_skip_zero_times_infinity(spark):
    px = image(spark, np.array([[[np.inf, 1, 1, 0], [2, 1, 1, 0.5]]]))
    assert aggregate.selection_stats(px, "rgba").first()["max_r"] == 1


def test_crop_of_crop(spark, noise):
    px = image(spark, noise)
    assert select.crop(select.crop(px, Rect(1, 1, 7, 5)), Rect(2, 1, 3, 2)).orderBy("y", "x").collect() == select.crop(px, Rect(3, 2, 3, 2)).orderBy("y", "x").collect()


def test_pooling_by_one_gives_the_pixels(spark, noise):
    px = image(spark, noise)
    grid = aggregate.pooled_grid(px, 9, 7).withColumnsRenamed({"grid_y": "y", "grid_x": "x"})
    assert np.array_equal(array(grid, 7, 9), noise.astype(float))


def test_luminance_of_means_differs_from_mean_of_luminances(spark, sf):
    px = select.crop(nonfinite(spark, sf), Rect(0, 0, 20, 5))
    of_means = aggregate.graph_values(aggregate.pooled_grid(px, 20, 5, most=1), "rgb").first()["value"]
    assert abs(of_means - aggregate.selection_stats(px).first()["avg_lum"]) > 1e-6


def test_stencils_match_numpy(spark, noise):
    px, wide = image(spark, noise), np.pad(noise.astype(float), ((2, 2), (2, 2), (0, 0)), "edge")
    box = sum(wide[i : i + 7, j : j + 9] for i in range(5) for j in range(5)) / 25
    assert np.allclose(array(stencil.box_blur(px, 2), 7, 9), box)
    line = (wide[2:9, 1:10] + wide[2:9, 2:11] + wide[2:9, 3:12]) / 3
    assert np.allclose(array(stencil.blur_3(px), 7, 9), line)
    lum = wide @ [0.2126, 0.7152, 0.0722, 0]
    at = lambda i, j: lum[2 + i : 9 + i, 2 + j : 11 + j]
    gx = at(-1, 1) - at(-1, -1) + 2 * (at(0, 1) - at(0, -1)) + at(1, 1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    assert np.allclose(array(stencil.sobel(px), 7, 9, ["edge"])[..., 0], np.hypot(gx, gy))


def test_resampling_to_the_same_size_is_the_image(spark, noise):
    assert np.allclose(array(stencil.resampled(image(spark, noise), 9, 7, 9, 7), 7, 9), noise)
    with pytest.raises(ValueError):
        stencil.resampled(image(spark, noise), 9, 7, 9000, 9000)


def test_free_programs(spark, noise):
    px = select.append(image(spark, noise), image(spark, noise[:2], "j"))
    out = stencil.applied(px, lambda a: a[::-1] * 2).filter("image_id = 'i'")
    assert np.allclose(array(out, 7, 9), noise[::-1] * 2)
    assert array(stencil.mapped(image(spark, noise), r="g"), 7, 9)[0, 0].tolist() == [float(noise[0, 0, 1]), 0, 0, 1]


def test_generators(spark):
    g = array(generate.gradient(spark, 4, 2), 2, 4)
    assert g[1, 3].tolist() == [0.875, 0.75, 0, 1]
    assert abs(array(generate.radial_light(spark, 3, 3), 3, 3)[1, 1, 0] - 40) < 1e-6
    with pytest.raises(ValueError):
        generate.canvas(spark, 10_000, 10_000)


def test_sampling_places(spark):
    small = aggregate.sample_places(spark, Rect(2, 3, 4, 1)).collect()
    assert sorted((r.y, r.x) for r in small) == [(3, 2), (3, 3), (3, 4), (3, 5)]
    large = aggregate.sample_places(spark, Rect(0, 0, 200, 1)).collect()
    assert len(large) == 128 and {r.y for r in large} == {0} and max(r.x for r in large) == 199


def test_pickers(spark, noise):
    px = image(spark, noise)
    many = spark.createDataFrame([(k, "i", 0, 0, "#ff365e") for k in range(21)], "picker_id int, image_id string, x int, y int, color string")
    with pytest.raises(ValueError):
        pick.picker_values(px, many)
    none = many.limit(0)
    assert pick.next_id(none).first()[0] == 1 and pick.next_color(none).first()[0] == pick.PICKER_COLORS[0]
    assert pick.next_id(many).first()[0] == 21
    line = pick.picker_csv(px, many.limit(1), spark.createDataFrame([("i", "x")], "image_id string, name string"), "r", "linear").first()["line"]
    assert line.startswith("P0,x,0,0,linear,R,") and pick.csv_header("r") == "id,image,x,y,mode,display,r"
    assert pick.picker_tuples(px, many.limit(1), "rgb", "srgb255").first()["line"].count(",") == 2


def test_display(spark):
    px = image(spark, np.array([[[0.5, 2.0, -1.0, 0.25], [NAN, 0.0, 1.0, 2.0]]]))
    rgba = array(display.display_bytes(px), 1, 2)
    assert rgba[0].tolist() == [[188, 255, 0, 64], [0, 0, 255, 255]]
    assert array(display.display_bytes(px, "a"), 1, 2)[0].tolist() == [[64, 64, 64, 255], [255, 255, 255, 255]]
    assert array(display.display_bytes(px, "rgb", auto_level=True), 1, 2)[0, 0, 1] == 255
    assert array(display.display_bytes(px, "rgb", log=True), 1, 2)[0, 0, 1] == 255


def test_small_operators(spark, noise):
    px = image(spark, noise)
    assert array(select.flipped(px, 7), 7, 9)[0].tolist() == noise[6].astype(float).tolist()
    assert array(generate.brightness(px, NAN), 7, 9).tolist() == noise.astype(float).tolist()
    files = spark.createDataFrame([("a", "t", 1, 2), ("a", "t", 1, 2), ("b", "t", 1, 2)], "name string, type string, size int, last_modified int")
    assert select.first_sources(files).count() == 2
    rects = spark.createDataFrame([(1, "i", 7, 5, 2, 2), (2, "i", 0, 0, 1, 1)], "rect_id int, image_id string, x int, y int, width int, height int")
    assert pick.rect_join(px, rects).groupBy("rect_id").count().orderBy("rect_id").collect() == [(1, 4), (2, 1)]
    assert select.crop(px, Rect(0, 0, 9, 7)).agg(F.count("*")).first()[0] == 63


def test_a_program_measures_images_without_a_window(spark):
    px = spark.createDataFrame([(i, y, x, 1.0, 0.5, 0.25, 1.0) for i, w in (("p", 4), ("q", 2), (None, 5)) for y in range(2) for x in range(w)], "image_id string, y int, x int, r float, g float, b float, a float")
    out = stencil.mapped(px, r="u * width", g="v * height", b="width", a="height")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == 22 and all(abs(r["r"] - r["x"] - 0.5) < 1e-5 and r["g"] == r["y"] + 0.5 and r["a"] == 2 and r["b"] == {"p": 4, "q": 2, None: 5}[r["image_id"]] for r in rows)


def test_sampled_points_keep_any_columns(spark):
    v = np.random.default_rng(0).random((3, 4, 4)).astype(np.float32)
    points = spark.createDataFrame([("a", 0.5, 0.5, k) for k in (1, 1, 2)], "image_id string, u double, v double, fx int").withColumns({c: F.lit(7) for c in ("fy", "c", "y", "x", "w", "id", "py", "point", "times", "k", "__fx", "__w")})
    got = stencil.sampled(points, image(spark, v, "a"), 4, 3)
    assert got.columns == [*points.columns, "r", "g", "b", "a"] and got.count() == 3
    assert {r["fx"] for r in got.collect()} == {1, 2} and got.first()["r"] == pytest.approx(float(v[1, 1:3, 0].mean()))
