import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.sources import matrix
from lumaframe.sources.datasource import register

from .test_operators import array, image


def put(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.txt").write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def text(rows, width=2, channels='["R","G","B","A"]', encoding="linear", height=None, more=""):
    return f'VALUE_MATRIX 1\n{{"width":{width},"height":{len(rows) if height is None else height},"channels":{channels},"encoding":"{encoding}"{more}}}\ndata:\n' + "\n".join(rows)


def records(spark, folder):
    return {r["image_id"].rsplit("/", 1)[1].removesuffix(".txt"): r for r in matrix.matrix_records(spark, folder).collect()}


def pixels(spark, folder):
    out = {}
    for r in matrix.read_matrix_files(spark, folder).collect():
        out.setdefault(r["image_id"].rsplit("/", 1)[1].removesuffix(".txt"), {})[r["y"], r["x"]] = tuple(r[3:])
    return out


def test_files_equal_single_texts(spark, tmp_path):
    texts = {
        "linear": text(["(2.5,0.25,0.125,1),(0,1,4,0.5),", "(1,1,1,1),(0,0,0,0),"]), "bytes": text(["(255,0,51,1),(10,20,30,0.25),"], encoding="srgb255"), "srgb": text(["(0.5,1),(0.25,0.5)"], channels='["G","A"]', encoding="srgb"),
        "weighted": text(["(0.5,0.25,0.125,0.5),(1,1,1,0),"], more=',"alphaWeighted":true'), "gray": "1,2,3,\n4,5,6,\n", "two": "(1,2),(3,4)\n(5,6),(7,8)", "one": "7", "crlf": text(["(1,2,3,4),(5,6,7,8)"]).replace("\n", "\r\n"),
    }
    got = pixels(spark, put(tmp_path, **texts))
    for name, t in texts.items():
        want = {(r["y"], r["x"]): tuple(r[3:]) for r in matrix.read_text(spark, t).select("image_id", "y", "x", "r", "g", "b", "a").collect()}
        assert got[name] == want, name
    assert {n: (r["width"], r["height"], r["headed"], r["error"]) for n, r in records(spark, str(tmp_path)).items()}["gray"] == (3, 2, False, None)
    assert records(spark, str(tmp_path))["srgb"]["channels"] == [1, 3]


def test_blank_lines_and_a_mark_of_byte_order_do_not_count(spark, tmp_path):
    got = pixels(spark, put(tmp_path, a="﻿\n\n" + text(["", "(1,2,3,4),(5,6,7,8),", "  ", "(0,0,0,0),(1,1,1,1),"], height=2) + "\n\n", b="\n 1,2 \n\n3,4\n", c=" \n\n"))
    assert got["a"][1, 1] == (1, 1, 1, 1) and got["b"] == {(0, 0): (1, 1, 1, 1), (0, 1): (2, 2, 2, 1), (1, 0): (3, 3, 3, 1), (1, 1): (4, 4, 4, 1)} and "c" not in got


@pytest.mark.parametrize(
    ("content", "error"),
    [
        (text(["(1,2,3,4),(5,6,7,8)"], height=2), "1 rows of data where 2"), (text(["(1,2,3,4)"]), "another number of cells"), (text(["(1,2,3),(4,5,6)"]), "another number of values"), (text(["(1,2,3,4),(5,6,7,x)"]), "no number"),
        (text(["(1,2,3,4),(5,6,7,8"]), "parenthesis"), (text(["(1,2,3,4),…,"]), "shortened"), (text(["(1,2,3,4),(5,6,7,8)"], channels='["R","R","B","A"]'), "twice"), (text(["1,2"], encoding="other"), "no encoding"), (text([]), "pixels|size|width|height|rows|1 to"),
        ("VALUE_MATRIX 1\nno json\ndata:\n1", "no JSON"), ("VALUE_MATRIX 1\n{}", "begin"), (text(["1"], width=10**6, height=10**6), "pixels|1,?048"), ('VALUE_MATRIX 1\n{"width":1,"height":1,"storage":"internal","token":"t"}\ndata:\n', "no longer"), ("1,2\n3", "another number of cells"),
        ("(1,2),3", "another number of values"), ("(1,2,3,4,5)", "one to four"), ("some prose", "no number"), ("VALUE_MATRIX 1\n[1]\ndata:\n1", "list|get|attribute"),
    ],
)
def test_a_malformed_file_is_an_error_row_and_stops_no_other(spark, tmp_path, content, error):
    folder = put(tmp_path, bad=content, good="1,2")
    found = records(spark, folder)
    assert found["good"]["error"] is None and found["bad"]["width"] is None
    import re

    assert re.search(error, found["bad"]["error"]), found["bad"]["error"]
    assert pixels(spark, folder).keys() == {"good"}


def test_a_file_read_by_several_tasks(spark, tmp_path):
    rows = [",".join(str(y * 40 + x) for x in range(40)) for y in range(700)]
    folder = put(tmp_path, large="\n".join(rows), headed=text([",".join(f"({y},{x})" for x in range(3)) for y in range(900)], 3, '["R","G"]'))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(folder).rdd.getNumPartitions() > 20
        got = matrix.read_matrix_files(spark, folder).cache()
        assert np.array_equal(array(got.filter("image_id LIKE '%large.txt'"), 700, 40)[..., 0], np.arange(28_000).reshape(700, 40))
        assert got.filter("image_id LIKE '%headed.txt'").filter("r <> y OR g <> x OR b <> 0 OR a <> 1").count() == 0 and got.filter("image_id LIKE '%headed.txt'").count() == 2700
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_texts_of_many_images(spark, tmp_path):
    register(spark)
    rng = np.random.default_rng(4)
    one, two = rng.random((3, 5, 4)).astype(np.float32), rng.random((2, 2, 4)).astype(np.float32)
    both = image(spark, one).withColumn("image_id", F.lit('a "b"')).unionByName(image(spark, two).withColumn("image_id", F.lit("c")))
    texts = {r["image_id"]: bytes(r["content"]).decode() for r in matrix.texts_of(both).collect()}
    for name, values in (('a "b"', one), ("c", two)):
        back = matrix.read_text(spark, texts[name])
        assert np.array_equal(array(back, *values.shape[:2]), values.astype(float))
        assert matrix.header_of(texts[name])[0]["name"] == name
    assert bytes(matrix.texts_of(both.limit(0)).first() or b"") == b""


def test_an_image_too_large_for_a_text(spark):
    large = spark.createDataFrame([("a", 0, 0, 1.0, 1.0, 1.0, 1.0), ("a", 1024, 1024, 1.0, 1.0, 1.0, 1.0)], "image_id string, y int, x int, r float, g float, b float, a float")
    with pytest.raises(Exception, match="1048576"):
        matrix.texts_of(large).collect()


@pytest.mark.parametrize(("row", "cells"), [("(1,2),(3,4),", [[1, 2], [3, 4]]), (" ( 1 , 2 ) , 3 ,,", [[1, 2], [3]]), ("", []), (",,", []), ("0x10,NaN,-Infinity,.5,5.,1e-3", None)])
def test_rows(row, cells):
    got = matrix.cells_of(row)
    assert got == cells if cells is not None else len(got) == 6 and got[0] == [16] and got[5] == [0.001]


@pytest.mark.parametrize("row", ["((1,2))", "(1,2", "1)", "(1)2", "1 2", "(1,,2)", "1_000", "inf", "()", "..."])
def test_rows_that_are_none(row):
    with pytest.raises(ValueError):
        matrix.cells_of(row)
