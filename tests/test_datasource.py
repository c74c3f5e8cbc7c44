import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe import file_queries
from lumaframe.sources import files, hdr, png
from lumaframe.sources.datasource import PixelReader, register, save_parts, save_selection_csv
from lumaframe.storage import listed

from .oracle import same
from .test_operators import array


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    register(spark)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """One EXR of 21 blocks by ZIP, a flat and a coded Radiance file, a PNG, and files that are none."""
    at, rng = tmp_path_factory.mktemp("pixels"), np.random.default_rng(2)
    values = rng.random((330, 40, 4)).astype(np.float32)
    (at / "a.exr").write_bytes(hdr.encode_exr(values, hdr.ZIP))
    rgbe = rng.integers(1, 255, (64, 9, 4)).astype(np.uint8)
    rgbe[..., 3] = 128
    (at / "b.hdr").write_bytes(hdr.encode_rgbe(rgbe))
    coded = b"".join(bytes([2, 2, 0, 9]) + b"".join(bytes([9]) + rgbe[y, :, c].tobytes() for c in range(4)) for y in range(64))
    (at / "c.hdr").write_bytes(b"#?RADIANCE\n\n-Y 64 +X 9\n" + coded)
    (at / "d.png").write_bytes(png.encode(np.full((3, 2, 4), 255, np.uint8)))
    (at / "notes.txt").write_bytes(b"none")
    (at / "empty.exr").write_bytes(b"")
    (at / "_hidden.exr").write_bytes(b"none")
    return at, values, hdr.rgbe_values(rgbe)


@pytest.mark.parametrize("name", sorted(file_queries.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    same(spark, sf, file_queries.QUERIES[name], file_queries.ORACLE_SQL[name])


@pytest.mark.parametrize("split", [1 << 30, 4000, 100])
def test_all_files_whole_and_in_pieces(spark, folder, split):
    at, exr, radiance = folder
    px = spark.read.format("pixels").option("split", split).load(str(at)).cache()
    name = lambda n: px.filter(F.col("image_id").endswith(n))
    assert {r["image_id"].rsplit("/", 1)[1]: r["count"] for r in px.groupBy("image_id").count().collect()} == {"a.exr": 13_200, "b.hdr": 576, "c.hdr": 576, "d.png": 6}
    assert np.array_equal(array(name("a.exr"), 330, 40), exr.astype(float))
    assert np.array_equal(array(name("b.hdr"), 64, 9), radiance.astype(float)) and np.array_equal(array(name("c.hdr"), 64, 9), radiance.astype(float))


def test_one_file_is_read_by_several_tasks(spark, folder):
    path = str(folder[0] / "a.exr")
    size = os.path.getsize(path)
    assert spark.read.format("pixels").option("split", size // 5).load(path).rdd.getNumPartitions() >= 5
    assert spark.read.format("pixels").load(path).rdd.getNumPartitions() == 1


@pytest.mark.parametrize(("where", "low", "high"), [("y BETWEEN 100 AND 110", 100, 111), ("y = 17", 17, 18), ("y > 300", 301, 330), ("y >= 320 AND y < 322", 320, 322), ("y < 5 AND x < 40", 0, 5), ("y > 5 AND y < 3", 0, 0), ("y < -1", 0, 0)])
def test_line_filters_are_exact(spark, folder, where, low, high):
    got = spark.read.format("pixels").option("split", 5000).load(str(folder[0] / "a.exr")).filter(where)
    assert sorted((r["y"], r["x"], r["r"]) for r in got.collect()) == [(y, x, folder[1][y, x, 0]) for y in range(low, high) for x in range(40)]


def test_filters_reach_the_source(spark, folder, monkeypatch):
    path = str(folder[0] / "a.exr")
    frame = spark.read.format("pixels").option("split", 5000).load(path).filter("y BETWEEN 100 AND 110")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan pixels" in plan and "Filter (" not in plan and "Filter [" not in plan
    reader = PixelReader({"path": path, "split": "5000"})
    whole = len(reader.partitions())
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    assert not list(reader.pushFilters([GreaterThanOrEqual(("y",), 100), LessThan(("y",), 112)]))
    pieces = reader.partitions()
    # Lines 100 to 111 lie in the blocks of lines 96 to 111 only.
    assert [p.files[0][2:] for p in pieces] == [(6, 7)] and whole > len(pieces)
    unpacked = []
    monkeypatch.setattr(hdr, "exr_block", lambda layout, content, at, f=hdr.exr_block: unpacked.append(1) or f(layout, content, at))
    assert sum(b.num_rows for p in pieces for b in reader.read(p)) == 12 * 40 and len(unpacked) == 1


def test_names_prune_files(spark, folder):
    reader = PixelReader({"path": str(folder[0])})
    from pyspark.sql.datasource import EqualTo, In

    assert not list(reader.pushFilters([In(("image_id",), (str(folder[0] / "b.hdr"), "else")), EqualTo(("image_id",), str(folder[0] / "b.hdr"))]))
    assert [f[0] for p in reader.partitions() for f in p.files] == [str(folder[0] / "b.hdr")]
    rest = [EqualTo(("x",), 3)]
    assert list(reader.pushFilters(rest)) == rest


@pytest.mark.parametrize("split", [1 << 20, 2000])
def test_damaged_files_fail_or_are_skipped(spark, folder, tmp_path, split):
    good = (folder[0] / "a.exr").read_bytes()
    (tmp_path / "good.exr").write_bytes(good)
    (tmp_path / "cut.exr").write_bytes(good[:900])
    (tmp_path / "none.hdr").write_bytes(b"none")
    read = spark.read.format("pixels").option("split", split)
    with pytest.raises(Exception, match="cut.exr|none.hdr"):
        read.load(str(tmp_path)).count()
    found = read.option("damaged", "skip").load(str(tmp_path)).groupBy("image_id").count().collect()
    assert {r["image_id"].rsplit("/", 1)[1]: r["count"] for r in found}["good.exr"] == 13_200


def test_nothing_there(spark, tmp_path):
    with pytest.raises(Exception, match="nothing at"):
        spark.read.format("pixels").load(str(tmp_path / "none")).count()
    assert spark.read.format("pixels").load(str(tmp_path)).count() == 0


def test_listing(tmp_path):
    for name in ("a.exr", "b.hdr", "sub/c.exr", "_temporary/d.exr", ".e.exr"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [p.removeprefix(str(tmp_path)) for p, _ in listed(str(tmp_path))] == ["/a.exr", "/b.hdr", "/sub/c.exr"]
    assert [p.removeprefix(str(tmp_path)) for p, _ in listed(f"file://{tmp_path}/*.exr")] == [f"file://{tmp_path}/a.exr"]
    assert len(listed(str(tmp_path / "a.exr"))) == 1


# --- sinks -----------------------------------------------------------------------------------------------------------
def save(rows, path, mode="append", **options):
    rows.write.format("image-files").options(**options).mode(mode).save(str(path))


def test_files_appear_together(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{k}", bytes([k]) * k) for k in range(20)], "image_id string, content binary").repartition(4)
    save(rows, tmp_path / "out", suffix=".bin")
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"i{k}.bin": bytes([k]) * k for k in range(20)}
    save(rows.limit(1).withColumn("image_id", F.lit("new")), tmp_path / "out")
    assert len(list((tmp_path / "out").iterdir())) == 21
    save(rows.limit(2), tmp_path / "out", "overwrite")
    assert len(list((tmp_path / "out").iterdir())) == 2


def test_a_failed_attempt_leaves_no_file(spark, tmp_path):
    rows = spark.range(12, numPartitions=4).selectExpr("concat('i', id) AS image_id", "CAST(IF(id = 11, raise_error('stop'), 'x') AS binary) AS content")
    with pytest.raises(Exception, match="stop"):
        save(rows, tmp_path / "out")
    assert list((tmp_path / "out").iterdir()) == []


@pytest.mark.parametrize("names", [("a", "a"), ("a", "x/y"), ("a", "_b"), ("a", None)])
def test_names_that_cannot_be_files(spark, tmp_path, names):
    with pytest.raises(Exception, match="name"):
        save(spark.createDataFrame([(n, b"x") for n in names], "image_id string, content binary"), tmp_path / "out")
    assert list((tmp_path / "out").iterdir()) == []


def test_csv_in_order_by_several_tasks(spark, tmp_path):
    rows = spark.range(5000).selectExpr("CAST(id % 50 AS int) AS x", "CAST(id div 50 AS int) AS y", "'linear' AS mode", "'a \"b\"' AS display", "IF(id = 7, NULL, CAST(id AS string)) AS r").orderBy(F.rand(3))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        save_selection_csv(rows, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out").iterdir())
    assert len(parts) > 1
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[0] == "x,y,mode,display,r" and lines[8] == '7,0,linear,"a ""b""",'
    assert [line.split(",")[:2] for line in lines[1:]] == [[str(k % 50), str(k // 50)] for k in range(5000)]
    with pytest.raises(Exception, match="already"):
        save_selection_csv(rows, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == len(parts)


# --- raster files that can't be opened -------------------------------------------------------------------------------
def picture(spark, path, kind, width=3, height=2):
    made = spark._jvm.java.awt.image.BufferedImage(width, height, 5)
    spark._jvm.javax.imageio.ImageIO.write(made, kind, spark._jvm.java.io.File(str(path)))
    return path.read_bytes()


@pytest.mark.parametrize("kind", ["bmp", "gif", "jpg"])
def test_sizes_in_headers(spark, tmp_path, kind):
    content = picture(spark, tmp_path / f"p.{kind}", kind, 37, 21)
    assert files.raster_size(content) == (37, 21)
    assert files.raster_size(content[:5]) is None and files.raster_size(b"else") is None


@pytest.mark.parametrize("kind", ["bmp", "gif", "jpg"])
def test_one_damaged_or_oversized_file_stops_no_other(spark, tmp_path, kind):
    content = picture(spark, tmp_path / f"good.{kind}", kind)
    large = {"bmp": lambda c: c[:18] + struct.pack("<ii", 4096, 2049) + c[26:], "gif": lambda c: c[:6] + struct.pack("<HH", 4096, 2049) + c[10:], "jpg": lambda c: c.replace(struct.pack(">HH", 2, 3), struct.pack(">HH", 2049, 4096), 1)}[kind](content)
    assert files.raster_size(large) == (4096, 2049)
    (tmp_path / f"large.{kind}").write_bytes(large)
    (tmp_path / f"none.{kind}").write_bytes(b"not a picture at all")
    (tmp_path / f"cut.{kind}").write_bytes(content[: len(content) // 2 if kind != "jpg" else 300])
    (tmp_path / "fine.png").write_bytes(png.encode(np.full((2, 2, 4), 255, np.uint8)))
    px = files.read_images(spark, str(tmp_path))
    counts = {r["image_id"].rsplit("/", 1)[1]: r["count"] for r in px.groupBy("image_id").count().collect()}
    assert counts[f"good.{kind}"] == 6 and counts["fine.png"] == 4 and not counts.keys() & {f"large.{kind}", f"none.{kind}"}
    rows = {r["name"]: r for r in files.image_records(spark, str(tmp_path)).collect()}
    assert "pixels" in rows[f"large.{kind}"]["error"] and "damaged" in rows[f"none.{kind}"]["error"] and rows[f"none.{kind}"]["width"] is None
    assert rows[f"good.{kind}"]["error"] is None and rows[f"good.{kind}"]["width"] == 3 and len(rows) == 5
    # What the decoder makes of a file that ends early is its own: pixels or an error, not both.
    assert (rows[f"cut.{kind}"]["error"] is None) == (f"cut.{kind}" in counts)


def test_only_files_that_cannot_be_opened(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"none")
    assert files.read_images(spark, str(tmp_path)).count() == 0
    assert [r["name"] for r in files.image_records(spark, str(tmp_path)).collect()] == ["a.jpg"]


@pytest.mark.parametrize("kind", sorted(files.EXR_KINDS))
def test_a_large_image_is_encoded_in_parts(spark, tmp_path, monkeypatch, kind):
    """Parts of 32 lines or fewer, one of them without a pixel; the file is the one that a single task would write, whatever its size."""
    monkeypatch.setattr(files, "PART_PIXELS", 160)
    values = np.random.default_rng(4).random((130, 5, 4)).astype(np.float32)
    values[64:96] = 0
    values[7, 4] = 0
    rows = [(name, y, x, *map(float, values[y, x])) for name, height in (("long", 130), ("short", 3)) for y in range(height) for x in range(5) if values[y, x].any()]
    parts = files.exr_parts(spark.createDataFrame(rows, "image_id string, y int, x int, r float, g float, b float, a float"), kind)
    assert max(r["n"] for r in parts.groupBy("image_id").count().withColumnRenamed("count", "n").collect()) > 5
    save_parts(parts, str(tmp_path / "out"), ".exr")
    for name, height in (("long", 130), ("short", 3)):
        assert (tmp_path / "out" / f"{name}.exr").read_bytes() == hdr.encode_exr(values[:height], files.EXR_KINDS[kind])
    back = spark.read.format("pixels").option("split", "300").load(str(tmp_path / "out")).filter("y >= 33")
    want = hdr.decode_exr((tmp_path / "out" / "long.exr").read_bytes())
    assert {tuple(r)[1:] for r in back.collect()} == {(y, x, *map(float, want[y, x])) for y in range(33, 130) for x in range(5)}
