import pytest

from lumaframe import paste_queries
from lumaframe.plans import paste
from lumaframe.sources import matrix

from .oracle import same

SCHEMA = "paste_id string, text string, files array<struct<name string, type string, size long>>, types array<string>, token string, readable boolean"
FILE = [("a.png", "image/png", 10)]


@pytest.mark.parametrize("name", sorted(paste_queries.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    same(spark, sf, paste_queries.QUERIES[name], paste_queries.ORACLE_SQL[name])


def test_the_first_decoder_that_knows_a_paste_takes_it(spark):
    headed = 'VALUE_MATRIX 1\n{"width":2,"height":1,"channels":["R"],"encoding":"linear"}\ndata:\n1,2'
    gone = matrix.internal_text("t", 3, 3)
    rows = {
        "matrix over files": (headed, FILE, [], None, True, ("matrix", "pixels", 2, 1)), "files over plain": ("1,2", FILE, [], None, True, ("files", "files", None, None)), "plain": ("\n1,2\n3,4\n", [], [], None, True, ("plain matrix", "pixels", 2, 2)),
        "damaged": (headed + ",3", FILE, [], None, True, ("matrix", "error", None, None)), "gone": (gone, [], [], None, True, ("matrix", "error", None, None)), "gone with files": (gone, FILE, [], "other", True, ("files", "files", None, None)),
        "at hand": (gone, FILE, [], "t", True, ("matrix", "pixels", None, None)), "prose": ("hello", [], ["text/plain"], "t", False, (None, None, None, None)), "nothing": ("", [], [], "t", False, ("copied values", "pixels", None, None)),
        "nothing but readable": (None, None, None, "t", True, (None, None, None, None)), "nothing at hand": (None, None, None, None, False, (None, None, None, None)), "nulls": (None, FILE, None, None, None, ("files", "files", None, None)),
        "large": ("\n".join(["1," * 1100] * 1000), [], [], None, True, ("plain matrix", "error", None, None)),
    }
    frame = spark.createDataFrame([(k, *v[:5]) for k, v in rows.items()], SCHEMA)
    got = {r["paste_id"]: r for r in paste.resolved(frame).collect()}
    assert {k: (r["decoder"], r["kind"], r["width"], r["height"]) for k, r in got.items()} == {k: v[5] for k, v in rows.items()}
    assert "no longer" in got["gone"]["error"] and got["plain"]["error"] is None and "1048576" in got["large"]["error"]
    assert paste.resolved(frame.limit(0)).count() == 0


def test_one_file_of_each_item(spark):
    rows = [("p", 0, "image/png", 5, None), ("p", 0, "image/x-exr", 9, None), ("p", 0, "text/plain", 1, None), ("p", 1, "", 5, "hdr"), ("p", 1, "image/png", 3, None), ("p", 2, None, 5, None), ("p", 2, "image/jpeg", 5, None), ("q", 0, "text/plain", 1, "exr"), ("p", 3, "image/png", 7, None), ("p", 3, "image/png", 6, None)]
    got = paste.best_items(spark.createDataFrame(rows, "paste_id string, item int, type string, size long, sniffed string")).collect()
    assert sorted((r["item"], r["extension"], r["size"]) for r in got) == [(0, "exr", 9), (1, "hdr", 5), (2, "jpg", 5), (3, "png", 6)] and {r["paste_id"] for r in got} == {"p"}


def test_a_cut_text_ends_inside_a_cell_whatever_its_numbers_are(spark, tmp_path):
    """The last cells of some of these tiles have 40 or 41 characters together."""
    value = [100 * 0.5 ** (1 + k // 10 % 9) for k in range(2, 200, 10)]
    events = [(500 * tile + k, 0, v) for tile, v in zip(range(2, 200, 10), value, strict=True) for k in range(500)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").toPandas().to_parquet(tmp_path / "events.parquet")
    same(spark, str(tmp_path), paste_queries.QUERIES["pastes"], paste_queries.ORACLE_SQL["pastes"])
