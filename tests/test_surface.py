import math

import pytest
from pyspark.sql import functions as F

from lumaframe import surface_queries
from lumaframe.operators import surface as s

from .oracle import same


@pytest.mark.parametrize("name", sorted(surface_queries.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    same(spark, sf, surface_queries.QUERIES[name], surface_queries.ORACLE_SQL[name])


def grid(spark, *lines, image_id="a"):
    rows = [(image_id, y, x, v) for y, line in enumerate(lines) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "image_id string, grid_y long, grid_x long, value double")


def kinds(faces):
    return sorted((r["grid_y"], r["grid_x"], r["kind"]) for r in faces.collect())


def test_a_single_cell_has_a_top_and_four_sides(spark):
    faces = s.surface(grid(spark, [2.0]), True)
    assert [k for *_, k in kinds(faces)] == ["left", "lower", "right", "top", "upper"]
    assert s.surface(grid(spark, [2.0]), False).count() == 0
    assert faces.filter("kind = 'top'").first()["alpha"] == 1 and faces.filter("kind = 'left'").first()["alpha"] == 0.72


def test_sides_stand_where_steps_differ(spark):
    faces = s.stepped_faces(grid(spark, [1.0, 1.0, 3.0]))
    got = kinds(faces)
    assert (0, 0, "right") not in got and (0, 1, "right") in got and (0, 2, "right") in got and (0, 0, "lower") in got
    step = faces.filter("grid_x = 1 AND kind = 'right'").first()
    assert step["shade"] == 2 and [c["value"] for c in step["corners"]] == [1, 1, 3, 3] and {c["x"] for c in step["corners"]} == {2.0}
    border = faces.filter("grid_x = 2 AND kind = 'right'").first()
    assert border["shade"] == 3 and [c["value"] for c in border["corners"]] == [3, 3, 1, 1]


def test_smooth_faces_stand_between_four_cells(spark):
    faces = s.smooth_faces(grid(spark, [0.0, 1.0, 2.0], [4.0, 5.0, 6.0]))
    assert kinds(faces) == [(0, 0, "top"), (0, 1, "top")]
    assert faces.filter("grid_x = 0").first()["shade"] == 2.5 and [c["value"] for c in faces.filter("grid_x = 1").first()["corners"]] == [1, 2, 6, 5]


def test_places_in_the_view(spark):
    """With no turn and no tilt the ground is seen from above."""
    flat = grid(spark, [0.0, 1.0], [0.0, 1.0])
    top = s.placed(s.smooth_faces(flat), flat, False, yaw=0.0, pitch=0.0).first()
    assert [(p["x"], p["y"]) for p in top["points"]] == [(-0.85, -0.85), (0.85, -0.85), (0.85, 0.85), (-0.85, 0.85)] and top["depth"] == 0
    upright = s.placed(s.smooth_faces(flat), flat, False, yaw=0.0, pitch=math.pi / 2).first()
    assert [round(p["y"], 9) for p in upright["points"]] == [0, -0.78, -0.78, 0]
    wide = grid(spark, [0.0] * 100, [1.0] * 100)
    assert {round(abs(p["y"]), 6) for r in s.placed(s.smooth_faces(wide), wide, False, yaw=0.0, pitch=0.0).collect() for p in r["points"]} == {0.21}


def test_painters_order_is_total_and_by_depth(spark):
    both = grid(spark, [1.0, 2.0, 5.0], [3.0, 0.0, 4.0]).unionByName(grid(spark, [9.0, 1.0], image_id="b"))
    rows = s.surface(both, True).orderBy("image_id", "place").collect()
    for image_id in "ab":
        own = [r for r in rows if r["image_id"] == image_id]
        assert [r["place"] for r in own] == list(range(len(own)))
        assert all(x["depth"] <= y["depth"] + 1e-9 for x, y in zip(own, own[1:], strict=False))


@pytest.mark.parametrize("log", [False, True])
def test_values_that_are_not_finite_are_drawn_low(spark, log):
    rows = {(r["grid_x"], r["kind"]): r for r in s.surface(grid(spark, [float("nan"), 2.0, float("inf"), 1.0]), True, log).collect()}
    assert (rows[0, "top"]["r"], rows[0, "top"]["g"], rows[0, "top"]["b"]) == (0, 0, 70) and (rows[1, "top"]["r"], rows[1, "top"]["b"]) == (255, 0)


def test_clashing_columns_and_none(spark):
    some = grid(spark, [1.0, 2.0], [3.0, 4.0])
    extra = some.withColumns({c: F.lit(7) for c in ("low", "high", "columns", "lines", "right", "below", "kind", "image", "shade", "r", "place")})
    for stepped in (False, True):
        assert s.surface(extra, stepped).drop("points").exceptAll(s.surface(some, stepped).drop("points")).count() == 0
        assert s.surface(some.limit(0), stepped).count() == 0
