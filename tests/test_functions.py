import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.functions import color, geometry, text
from lumaframe.schema import Rect, channels_of, check_channels, check_encoding, check_size

NAN, INF = float("nan"), float("inf")
EDGE = [-INF, -1.0, -1e-30, -0.0, 0.0, 1e-33, 0.0031308, np.nextafter(0.0031308, 1), 0.04045, np.nextafter(0.04045, 1), 0.5, 1.0, 1.5, 1e-6, 123456.789, 1e21, 3.4e38, INF, NAN]


def values(spark, f, data=EDGE):
    df = spark.createDataFrame(list(enumerate(map(float, data))), "k int, v double")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


def close(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) <= 1e-12 * max(abs(a), abs(b), 1e-300)


def to_linear(v):
    return v if not math.isfinite(v) else v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4


def to_srgb(v):
    return v if not math.isfinite(v) else v * 12.92 if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055


def test_transfer_at_the_edges(spark):
    assert all(map(close, values(spark, color.srgb_to_linear), map(to_linear, EDGE)))
    assert all(map(close, values(spark, color.linear_to_srgb), map(to_srgb, EDGE)))
    assert close(values(spark, color.program_srgb_to_linear, [0.04045])[0], ((0.04045 + 0.055) / 1.055) ** 2.4)
    assert values(spark, color.program_srgb_to_linear, [-3.0]) == [0.0]


def test_bytes(spark):
    want = [0 if not math.isfinite(v) or v <= 0 else 255 if v >= 1 else math.floor(to_srgb(v) * 255 + 0.5) for v in EDGE]
    assert values(spark, color.srgb_byte) == want
    assert values(spark, color.srgb255, [INF, -INF, NAN, 2.0]) == [0, 0, 0, 255]
    assert values(spark, lambda v: color.js_round(v), [-0.5, -2.5, 2.5]) == [0, -2, 3]


def test_clamps(spark):
    assert values(spark, color.clamp01, [INF, -INF, NAN, 2.0, -1.0]) == [0, 0, 0, 1, 0]
    open_ = values(spark, color.clamp01_open, [INF, -INF, NAN])
    assert open_[:2] == [1, 0] and math.isnan(open_[2])


def test_normalisers_without_range(spark):
    one = F.lit(2.0)
    assert values(spark, lambda v: color.normalize_linear(v, one, one), [2.0, 2.5, NAN]) == [0.0, 0.5, 0.0]
    assert values(spark, lambda v: color.normalize_log(v, one, one), [2.0, NAN]) == [0.0, 0.0]


def test_rgbe(spark):
    got = [tuple(r) for r in values(spark, lambda v: color.rgbe(v, v / 2, -v), [1.0, 0.0, 1e-33, -5.0, NAN, 3.4e38, 0.9999])]
    assert got[0] == (128, 64, 0, 129)
    assert got[1] == got[2] == got[4] == (0, 0, 0, 0)
    assert got[3] == (0, 0, 160, 131)
    assert got[5][3] == 255  # the exponent byte stops instead of wrapping
    assert got[6] == (255, 128, 0, 128)  # a mantissa that rounds to 256 is kept in a byte


def test_ramp(spark):
    got = [tuple(r) for r in values(spark, color.color_ramp, [-1.0, 0.0, 0.2, 0.5, 1.0, 2.0, NAN])]
    assert got == [(0, 0, 70), (0, 0, 70), (0, 74, 255), (0, 215, 164), (255, 0, 0), (255, 0, 0), (0, 0, 70)]


@pytest.mark.parametrize(("v", "want"), [(0.0, "0"), (-0.0, "0"), (1.005, "1.005"), (0.1, "0.1"), (1234567.891, "1234568"), (123456.789, "123456.8"), (2.5e-7, "0.00000025"), (1e-30, "0"), (-1e-30, "-0"), (NAN, "NaN"), (INF, "Infinity"), (-INF, "-Infinity"), (1e21, "1e+21")])
def test_seven_digits(v, want):
    assert text.seven_digits(v) == want


@pytest.mark.parametrize(("v", "want"), [(1.0, "1"), (float(np.float32(0.1)), "0.10000000149011612"), (1e-7, "1e-7"), (1e-6, "0.000001"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (-2.5, "-2.5"), (1.5e300, "1.5e+300")])
def test_plain(v, want):
    assert text.plain(v) == want


def test_printers_as_columns(spark):
    assert values(spark, text.format_number, [0.5, 1e21]) == ["0.5", "1e+21"]
    assert values(spark, text.format_exact, [0.5, 1e-7]) == ["0.5", "1e-7"]


def test_text_columns(spark):
    df = spark.createDataFrame([("a.b.png", 'q"u', b"\x76\x2f\x31\x01xx"), ("dir/x.PIC", "a,b", b"#?RGBE\n"), ("n", "plain", b"")], "p string, c string, b binary")
    rows = df.select(text.strip_extension(F.col("p")), text.csv_cell("c"), text.sniffed_extension(F.col("b")), text.file_kind(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("a.b", '"q""u"', "exr", "raster"), ("dir/x", '"a,b"', "hdr", "hdr"), ("n", "plain", None, "raster")]
    note = spark.createDataFrame([(0.45455, False), (1.0, False), (None, False), (1.0, True)], "g double, i boolean").select(text.transfer_note(F.col("g"), F.col("i"))).collect()
    assert [r[0] for r in note] == ["", "(gAMA 1.0000 ignored)", "", "(iCCP ignored)"]
    labels = spark.createDataFrame([("rgb",), ("rgba",), ("a",)], "m string").select(text.mode_label(F.col("m"))).collect()
    assert [r[0] for r in labels] == ["RGB", "RGBA (RGB x alpha)", "A"]
    assert text.save_formats("exr") == ["exr"] and "webp" in text.save_formats("glsl")


def test_rects():
    assert Rect.between(5, 9, 2, 3) == Rect(2, 3, 4, 7)
    assert Rect(95, 8, 50, 50).clamped(100, 10) == Rect(95, 8, 5, 2)
    assert Rect(-3, 50, 0, 0).clamped(100, 10) == Rect(0, 9, 1, 1)


def test_validation():
    assert channels_of("rgb") == ("r", "g", "b") and check_channels(["R", 3]) == [0, 3] and check_encoding(None) == "linear"
    for bad in ([], [0, 0], ["x"], [1, 2, 3, 0, 1], "rgb"):
        with pytest.raises(ValueError):
            check_channels(bad)
    for f, a in ((check_encoding, ("xyz",)), (channels_of, ("q",)), (check_size, (0, 1)), (check_size, (1.5, 1)), (check_size, (1_048_577, 1))):
        with pytest.raises(ValueError):
            f(*a)


def test_geometry(spark):
    row = spark.range(1).select(geometry.fit_scale(*map(F.lit, (200.0, 100.0, 100.0, 100.0))), geometry.projected(F.lit(1.0), F.lit(0.0), F.lit(0.5)).alias("p"), geometry.needs_side(F.lit(1.0), F.lit(1.0))).first()
    c, s, cp, sp = math.cos(-0.72), math.sin(-0.72), math.cos(0.92), math.sin(0.92)
    assert row[0] == 0.94 and not row[2]
    assert np.allclose(tuple(row[1]), (c, s * cp - 0.5 * sp, s))


def test_half_floats_match_numpy():
    codes = np.arange(65536, dtype=np.uint16)
    back = np.array([struct.unpack("<e", struct.pack("<H", int(c)))[0] for c in codes[::97]])
    assert np.array_equal(back, codes[::97].view(np.float16).astype(float), equal_nan=True)
