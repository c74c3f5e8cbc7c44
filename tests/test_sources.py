import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.sources import files, hdr, matrix, png

from .test_operators import array, image

PAIRS = [(t, d) for t, (_, ds) in png.TYPES.items() for d in ds]


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def make_png(samples, depth, kind, interlaced=0, filters=(0, 1, 2, 3, 4), extra=()):
    """A PNG of whole-number samples (height, width, n), its lines filtered in turn."""
    h, w, n = samples.shape

    def packed(part):
        bits = ((part.reshape(part.shape[0], -1)[..., None] >> np.arange(depth)[::-1]) & 1).reshape(part.shape[0], -1)
        lines, step = np.packbits(bits.astype(np.uint8), axis=1).astype(int), max(1, n * depth // 8)
        out, above = b"", np.zeros(lines.shape[1], int)
        for y, line in enumerate(lines):
            f = filters[y % len(filters)]
            left = np.concatenate((np.zeros(step, int), line))[: len(line)]
            corner = np.concatenate((np.zeros(step, int), above))[: len(line)]
            p = left + above - corner
            pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
            guess = [0 * line, left, above, (left + above) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))][f]
            out += bytes([f]) + ((line - guess) % 256).astype(np.uint8).tobytes()
            above = line
        return out

    if interlaced:
        parts = [samples[y0::dy, x0::dx] for x0, y0, dx, dy in png.PASSES]
        raw = b"".join(packed(p) for p in parts if p.size)
    else:
        raw = packed(samples)
    half = len(z := zlib.compress(raw)) // 2
    return png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, interlaced)) + b"".join(chunk(k, b) for k, b in extra) + chunk(b"IDAT", z[:half]) + chunk(b"IDAT", z[half:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("kind", "depth"), PAIRS)
@pytest.mark.parametrize("interlaced", [0, 1])
@pytest.mark.parametrize("size", [(1, 1), (3, 5), (9, 9)])
def test_png(kind, depth, interlaced, size):
    rng, n = np.random.default_rng(depth + kind), png.TYPES[kind][0]
    v = rng.integers(0, 1 << depth, (*size, n))
    palette = rng.integers(0, 256, (256, 3)).astype(np.uint8)
    got = png.decode(make_png(v, depth, kind, interlaced, extra=[(b"PLTE", palette.tobytes())] if kind == 3 else []))
    top = (1 << depth) - 1
    rgb = palette[v[..., 0]] / 255 if kind == 3 else np.broadcast_to(v[..., : 1 if kind in (0, 4) else 3] / top, (*size, 3))
    alpha = v[..., -1] / top if kind in (4, 6) else np.ones(size)
    assert np.allclose(got["pixels"][..., :3], rgb) and np.allclose(got["pixels"][..., 3], alpha)
    assert got["has_alpha"] == (kind in (4, 6)) and png.type_label(got) == f"png/{png.NAMES[kind]}{depth}"


def test_png_transparency_and_notes():
    v = np.array([[[1], [2]]])
    grey = png.decode(make_png(v, 8, 0, extra=[(b"gAMA", struct.pack(">I", 45455)), (b"tRNS", struct.pack(">H", 2))]))
    assert grey["pixels"][0, :, 3].tolist() == [1, 0] and abs(grey["gamma"] - 0.45455) < 1e-9 and grey["has_alpha"]
    pal = png.decode(make_png(v, 8, 3, extra=[(b"PLTE", bytes(range(9))), (b"tRNS", bytes([0, 51])), (b"iCCP", b"x")]))
    assert np.allclose(pal["pixels"][0, :, 3], [0.2, 1]) and pal["has_icc"]


@pytest.mark.parametrize("content", [b"", b"x" * 40, make_png(np.array([[[5]]]), 8, 3, extra=[(b"PLTE", bytes(3))]), make_png(np.zeros((4, 4, 1), int), 8, 0)[:60], make_png(np.zeros((1, 1, 1), int), 8, 0, filters=(0,)).replace(b"IHDR\0\0\0\1", b"IHDR\0\0\0\0")])
def test_damaged_png(content):
    with pytest.raises(ValueError):
        png.decode(content)


def test_rgbe_flat_and_run_length():
    v = np.random.default_rng(0).integers(1, 255, (2, 9, 4)).astype(np.uint8)
    flat = hdr.encode_rgbe(v)
    runs = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 2 +X 9\n" + b"".join(bytes([2, 2, 0, 9]) + b"".join(bytes([4]) + v[y, :4, c].tobytes() + bytes([5]) + v[y, 4:, c].tobytes() for c in range(4)) for y in range(2))
    assert np.array_equal(hdr.decode_rgbe(flat), hdr.decode_rgbe(runs))
    same = bytes([2, 2, 0, 9]) + b"".join(bytes([128 + 9, k]) for k in (1, 2, 3, 130))
    got = hdr.decode_rgbe(b"#?RGBE\n\n-Y 1 +X 9\n" + same)
    assert np.allclose(got[0, :, :3], np.array([1, 2, 3]) * 2.0 ** (130 - 136))
    for bad in (b"x", b"#?RGBE\n\n+Y 1 +X 9\n", flat[:-1]):
        with pytest.raises(ValueError):
            hdr.decode_rgbe(bad)


def test_exr():
    v = np.random.default_rng(0).normal(size=(3, 2, 4)).astype(np.float32)
    v[0, 0, 0], v[0, 1, 1] = np.nan, np.inf
    assert np.array_equal(hdr.decode_exr(hdr.encode_exr(v)), np.nan_to_num(v, nan=0, posinf=0))
    with pytest.raises(ValueError):
        hdr.decode_exr(b"abcdefgh")


def test_folder_of_images(spark, tmp_path):
    v = np.random.default_rng(0).random((300, 3, 4)).astype(np.float32)
    (tmp_path / "a.exr").write_bytes(hdr.encode_exr(v))
    (tmp_path / "b.png").write_bytes(png.encode(np.full((2, 2, 4), 255, np.uint8)))
    (tmp_path / "c.hdr").write_bytes(b"broken")
    (tmp_path / "d.png").write_bytes(b"")
    px = files.read_images(spark, str(tmp_path)).cache()
    assert px.groupBy("image_id").count().count() == 2
    assert np.array_equal(array(px.filter("image_id LIKE '%a.exr'"), 300, 3), v.astype(float))
    rows = {r["name"]: r for r in files.image_records(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.exr", "b.png", "c.hdr"} and rows["c.hdr"]["error"] and rows["a.exr"]["auto_level"] and not rows["b.png"]["auto_level"]
    assert files.read_raster(spark, str(tmp_path / "b.png")).count() == 0


@pytest.mark.parametrize("kind", ["bmp", "gif", "jpeg"])
def test_all_raster_kinds_open_alike(spark, tmp_path, kind):
    picture = spark._jvm.java.awt.image.BufferedImage(3, 2, 5)  # three bytes a pixel
    picture.setRGB(1, 0, 0xFF0000)
    spark._jvm.javax.imageio.ImageIO.write(picture, kind, spark._jvm.java.io.File(str(tmp_path / f"p.{kind}")))
    (tmp_path / "q.png").write_bytes(png.encode(np.full((2, 2, 4), 255, np.uint8)))
    px = files.read_images(spark, str(tmp_path)).cache()
    assert {r["image_id"].rsplit("/", 1)[1]: r["count"] for r in px.groupBy("image_id").count().collect()} == {f"p.{kind}": 6, "q.png": 4}
    red = array(px.filter(f"image_id LIKE '%p.{kind}'"), 2, 3)
    assert kind == "jpeg" or red[0, 1].tolist() == [1, 0, 0, 1] and red[1, 2].tolist() == [0, 0, 0, 1]
    rows = {r["name"]: r for r in files.image_records(spark, str(tmp_path)).collect()}
    assert rows[f"p.{kind}"]["type"] == f"image/{kind}" and (rows[f"p.{kind}"]["width"], rows["q.png"]["width"]) == (3, 2)
    assert {r["image_id"] for r in px.select("image_id").distinct().collect()} == {r["image_id"] for r in rows.values()}


@pytest.mark.parametrize("compression", [hdr.ZIPS, hdr.ZIP])
def test_packed_exr(compression):
    v = np.linspace(0, 3, 37 * 23 * 4, dtype=np.float32).reshape(37, 23, 4)
    v[5, 5, 0] = np.nan
    packed = hdr.encode_exr(v, compression)
    assert len(packed) < len(hdr.encode_exr(v)) and np.array_equal(hdr.decode_exr(packed), np.nan_to_num(v, nan=0))


@pytest.mark.parametrize(("gamma", "has_icc", "note"), [(None, False, ""), (0.45455, False, ""), (1.0, False, "(gAMA 1.0000 ignored)"), (1.0, True, "(iCCP ignored)")])
def test_transfer_text(gamma, has_icc, note):
    assert png.transfer_text({"gamma": gamma, "has_icc": has_icc}) == note


@pytest.mark.parametrize("step", [1, 3, 4, 8])
def test_png_diagonals_equal_single_lines(monkeypatch, step):
    rng = np.random.default_rng(step)
    lines = rng.integers(0, 256, (60, 37 * step + 1), dtype=np.uint8)
    lines[:, 0] = rng.choice([0, 1, 2, 3, 4], 60, p=[0.02, 0.02, 0.02, 0.47, 0.47])
    lines[20:50, 0] = rng.choice([3, 4], 30)
    fast = png._rows(lines.tobytes(), 60, 37 * step, step)
    monkeypatch.setattr(png, "DIAGONAL", 1000)
    assert np.array_equal(fast, png._rows(lines.tobytes(), 60, 37 * step, step))


def test_exr_runs():
    data = bytes([4, 7, 256 - 3, 1, 2, 3, 0, 9])
    assert hdr._run_lengths(data) == bytes([7] * 5 + [1, 2, 3, 9])
    steps = np.array([10, 130, 128, 126], np.uint8).tobytes()  # 10, 12, 12, 10: halves of 10 12 | 12 10
    assert hdr._unpacked(bytes([256 - 4]) + steps, hdr.RLE, 4) == bytes([10, 12, 12, 10])
    assert hdr._unpacked(steps, hdr.RLE, 4) == steps  # as long as the block: not packed
    assert hdr._unpacked(bytes([256 - 2, 10, 130, 5, 128]), hdr.RLE, 8) == bytes([10, 12] + [12, 12] * 3)


def test_sizes_are_asked_from_the_header():
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    wide = png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", 10_000, 10_000, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"")) + chunk(b"IEND", b"")
    exr = hdr.encode_exr(np.zeros((1, 1, 4), np.float32)).replace(struct.pack("<4i", 0, 0, 0, 0), struct.pack("<4i", 0, 0, 9999, 9999))
    for decode, content in ((png.decode, wide), (hdr.decode_exr, exr), (hdr.decode_rgbe, b"#?RADIANCE\n\n-Y 10000 +X 10000\n")):
        with pytest.raises(ValueError, match="pixels"):
            decode(content)


def test_files_of_frames(spark):
    v = np.random.default_rng(0).random((2, 3, 4)).astype(np.float32)
    px = image(spark, v)
    assert np.array_equal(hdr.decode_exr(files.encoded_files(px, "exr").first()["content"]), v)
    assert np.allclose(hdr.decode_rgbe(files.encoded_files(px, "hdr").first()["content"])[..., :3], v[..., :3], atol=0.01)
    for kind, fmt in (("png", "exr"), ("webp", "values")):
        with pytest.raises(ValueError):
            files.encoded_files(px, kind, fmt)


TEXT = 'VALUE_MATRIX 1\n{"width":2,"height":1,"channels":["R","G","B","A"],"encoding":"linear"}\ndata:\n(2.5,0.25,0.125,1),(0,1,4,1),'


def test_matrix_texts(spark):
    assert array(matrix.read_text(spark, "﻿" + TEXT), 1, 2)[0].tolist() == [[2.5, 0.25, 0.125, 1], [0, 1, 4, 1]]
    assert array(matrix.read_text(spark, "ANY_NAME_" + TEXT), 1, 2).shape == (1, 2, 4)
    assert array(matrix.read_text(spark, "1,2,\n3,4,"), 2, 2)[1, 0].tolist() == [3, 3, 3, 1]
    odd = array(matrix.read_text(spark, "NaN,Infinity,-Infinity,+Infinity,0x10,1e3"), 1, 6)[0, :, 0]
    assert np.isnan(odd[0]) and odd[1:].tolist() == [np.inf, -np.inf, np.inf, 16, 1000]
    weighted = TEXT.replace('"linear"', '"linear","alphaWeighted":true').replace("0.125,1)", "0.125,0.5)").replace("4,1)", "4,0)")
    assert array(matrix.read_text(spark, weighted), 1, 2)[0].tolist() == [[5, 0.5, 0.25, 0.5], [0, 0, 0, 0]]


@pytest.mark.parametrize("text", ["(1,2", "1,2\n3", "(1,2),(1)", "a,b", "", "1,…,", "inf", "1_0"])
def test_malformed_without_header_is_none(spark, text):
    assert matrix.read_text(spark, text) is None


@pytest.mark.parametrize("change", [("1\n{", "10\n{"), ("data:", "date:"), ('"width":2', '"width":3'), ('"height":1', '"height":0'), ('"G"', '"R"'), ('"linear"', '"log"'), ("{", "["), ("(0,1,4,1)", "(0,1,4)"), ("2.5", "x"), ('"width":2,"height":1', '"width":1048577,"height":1')])
def test_malformed_with_header_raises(spark, change):
    from pyspark.errors import PySparkException

    with pytest.raises((ValueError, PySparkException)):
        matrix.read_text(spark, TEXT.replace(*change)).collect()


@pytest.mark.parametrize("encoding", ["linear", "srgb", "srgb255"])
def test_matrix_round_trip(spark, encoding):
    v = np.random.default_rng(0).random((3, 4, 4)).astype(np.float32)
    back = array(matrix.read_text(spark, matrix.write_text(image(spark, v), 4, 3, encoding=encoding)), 3, 4)
    assert np.allclose(back, v, rtol=0, atol={"linear": 0, "srgb": 1e-6, "srgb255": 0.01}[encoding])


def test_internal_reference_and_preview(spark):
    px = image(spark, np.zeros((9, 13, 4), np.float32))
    text = matrix.internal_text("t", 13, 9)
    assert matrix.read_text(spark, text, {"t": px}) is px
    with pytest.raises(ValueError):
        matrix.read_text(spark, text)
    lines = [r["line"] for r in matrix.preview(px, 13, 9, channels=(0,)).orderBy("y").collect()]
    assert len(lines) == 9 and lines[0] == "0," * 12 + "…," and "first 12 x 8 of 13 x 9" in lines[-1]
    assert matrix.preview(px.filter("x < 2 AND y < 2"), 2, 2).count() == 2


def test_csv_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "linear", 'R "x"', "0.5"), (0, 0, "linear", "R", "1")], "x int, y int, mode string, display string, r string")
    files.write_selection_csv(rows, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text().splitlines() == ["x,y,mode,display,r", "0,0,linear,R,1", '1,0,linear,"R ""x""",0.5']
    assert rows.agg(F.count("*")).first()[0] == 2
