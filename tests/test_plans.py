import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.plans import share
from lumaframe.plans.catalog import Catalog, ProgramError
from lumaframe.schema import Rect
from lumaframe.sources import hdr
from lumaframe.streaming import watch

from .test_operators import array


def test_share_links():
    link = share.encode(64, 32, "outputColor = vec4(uv, 0.0, 1.0); // é")
    assert share.decode(link) == {"width": 64, "height": 32, "code": "outputColor = vec4(uv, 0.0, 1.0); // é"}
    assert share.decode("#other") is None and "=" not in link.removeprefix(share.PREFIX)
    for bad in ("#glsl=%%%", "#glsl=AA", share.PREFIX + "e30"):
        with pytest.raises(ValueError):
            share.decode(bad)
    for args in ((0, 1, ""), (10_000, 10_000, ""), (1, 1, "x" * 131_073), (1, 1, None)):
        with pytest.raises(ValueError):
            share.encode(*args)


def test_base64url_columns(spark):
    df = spark.createDataFrame([("a?>é" * 30,), ("",)], "t string").withColumn("p", share.base64url(F.col("t")))
    assert all(r["t"] == r["b"] and not set("+/=\n") & set(r["p"]) for r in df.withColumn("b", share.from_base64url(F.col("p"))).collect())


def test_catalog(spark, tmp_path):
    v = np.random.default_rng(0).random((4, 5, 4)).astype(np.float32)
    (tmp_path / "a.exr").write_bytes(hdr.encode_exr(v))
    c = Catalog(spark)
    c.open("a", str(tmp_path / "a.exr"))
    c.generate("g", 8, 4, r="u", g="v")
    c.paste("p", "2,3,\n4,5,")
    assert c.images["p"].auto_level and c.images["a"].auto_level and not c.images["g"].auto_level
    crop = c.select("a", Rect(3, 3, 9, 9))
    assert c.images["a"].selection == Rect(3, 3, 2, 1) and c.select("a", Rect(3, 3, 9, 9)) is crop
    c.program("a", r="g", g="r", b="b", a="1")
    with pytest.raises(ProgramError):
        c.program("a", r="nonsense(")
    assert np.allclose(array(c.frames["a"], 4, 5)[..., 0], v[..., 1])
    assert c.images["a"].program["tried"] == {"r": "nonsense("} and c.images["a"].program["worked"]["r"] == "g"
    assert c.copy("p").splitlines()[-1] == "(4,4,4,1),(5,5,5,1),"
    c.paste("q", c.copy("p"))
    assert array(c.frames["q"], 2, 2)[1, 1, 0] == 5
    c.save(str(tmp_path / "session"))
    (tmp_path / "a.exr").unlink()
    back = Catalog.restore(spark, str(tmp_path / "session"))
    assert set(back.images) == {"g", "p", "q"}
    assert array(back.frames["g"], 4, 8)[0, 0, 0] == 0.0625 and array(back.frames["p"], 2, 2)[0, 1, 0] == 3
    c.original("a")
    c.close("a")
    assert "a" not in c.frames
    with pytest.raises(ValueError):
        c.paste("bad", "not values")


def test_names_links_and_errors(spark):
    c = Catalog(spark)
    c.generate("it's", 8, 4, r="u", g="v")
    assert c.open_link("two", c.link_of("it's")) and not c.open_link("three", "#other")
    assert {r["image_id"] for f in c.frames.values() for r in f.select("image_id").distinct().collect()} == {"it's", "two"}
    assert np.array_equal(array(c.frames["it's"], 4, 8), array(c.frames["two"], 4, 8))
    c.images["two"].pickers.append({"picker_id": 3, "x": 1, "y": 2, "color": "#ff365e"})
    assert [tuple(r) for r in c.pickers().collect()] == [("two", 3, 1, 2, "#ff365e")]
    for text, place in (("u + + )", 6), ("missing * 2", None)):
        with pytest.raises(ProgramError) as e:
            c.program("two", r="u", g=text)
        assert e.value.channel == "g" and (place is None or e.value.place == place)
    for code in ("q = 1", "r", "r = 1\nr = 2"):
        with pytest.raises(ValueError):
            share.channels_of_code(code)


def test_watched_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.exr").write_bytes(hdr.encode_exr(np.ones((2, 2, 4), np.float32)))
    px = watch.arriving(spark, str(tmp_path / "in"))
    for k in range(2):
        q = watch.watch_stats(px, str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination()
        got = watch.latest(spark.read.parquet(str(tmp_path / "out")))
        assert got.count() == k + 1 and got.agg(F.sum("count")).first()[0] == 4 + 9 * k
        (tmp_path / "in" / "b.exr").write_bytes(hdr.encode_exr(np.full((3, 3, 4), 2, np.float32)))
