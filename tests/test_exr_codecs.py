import struct

import numpy as np
import pytest

from lumaframe.sources import exr_codecs, hdr
from lumaframe.sources.datasource import register

from .test_operators import array

RNG = np.random.default_rng(5)
SIZES = [(1, 1), (3, 2), (32, 33), (70, 50)]
KINDS = [hdr.NONE, hdr.ZIP, hdr.PIZ, hdr.PXR24, hdr.B44, hdr.B44A]


def smooth(height, width):
    y, x = np.indices((height, width))
    return np.stack([np.sin(x / 9) + 1, np.cos(y / 7) + 1, (x + y) / 50, np.ones_like(x) * 0.5], axis=2).astype(np.float32)


@pytest.mark.parametrize("most", [1, 1000, (1 << 14) - 1, 1 << 14, 65535])
@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (2, 2), (5, 3), (16, 16), (33, 100)])
def test_wavelet(shape, most):
    v = RNG.integers(0, most + 1, shape).astype(np.uint16)
    w = v.copy()
    exr_codecs.wave(w, most)
    exr_codecs.unwave(w, most)
    assert np.array_equal(v, w)


def test_a_wavelet_by_hand():
    # A square of 9 7 / 5 3: means and differences of the lines, then of the columns.
    v = np.array([[9, 7], [5, 3]], np.uint16)
    exr_codecs.wave(v, 9)
    assert v.view(np.int16).tolist() == [[6, 2], [4, 0]]


@pytest.mark.parametrize("values", [[7], [7] * 300, list(range(2000)), [0, 65535], RNG.geometric(0.01, 5000).tolist()])
def test_huffman(values):
    v = np.array(values).astype(np.uint16)
    assert np.array_equal(exr_codecs.unhuff(exr_codecs.huff(v), len(v)), v)


def test_huffman_by_hand_with_a_run():
    # Symbols 1, 2 and the repeating 3 with codes of 1, 2 and 2 bits: longer codes begin with smaller numbers, so 2 is 00, 3 is 01, 1 is 1.
    table = f"{1:06b}{2:06b}{2:06b}".ljust(24, "0")
    bits = "1" + "00" + "01" + f"{4:08b}" + "1"
    data = struct.pack("<5I", 1, 3, 3, len(bits), 0) + int(table, 2).to_bytes(3, "big") + int(bits.ljust(16, "0"), 2).to_bytes(2, "big")
    assert exr_codecs.unhuff(data, 7).tolist() == [1, 2, 2, 2, 2, 2, 1]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("half", [False, True])
@pytest.mark.parametrize("size", SIZES)
def test_files(kind, half, size):
    v = smooth(*size)
    got = hdr.decode_exr(hdr.encode_exr(v, kind, half))
    want = v.astype(np.float16).astype(np.float32) if half else v
    if kind in (hdr.B44, hdr.B44A) and half:
        assert np.allclose(got, want, atol=0.02)
    elif kind == hdr.PXR24 and not half:
        assert np.array_equal(got, (want.view(np.uint32) & 0xFFFFFF00).view(np.float32))
    else:
        assert np.array_equal(got, want)


def test_flat_squares_are_short_and_exact():
    v = np.full((64, 64, 4), 0.75, np.float32)
    flat, plain = hdr.encode_exr(v, hdr.B44A, True), hdr.encode_exr(v, hdr.B44, True)
    assert len(flat) < len(plain) / 3 and np.array_equal(hdr.decode_exr(flat), v) and np.array_equal(hdr.decode_exr(plain), v)


def test_values_that_b44_orders():
    """Negative, zero and large halves; differences within a square are exact where the shift is 0."""
    halves = np.array([[-1.0, -0.99951171875], [0.0, 65504.0]], np.float16).repeat(4, 0).repeat(4, 1)
    data = halves.astype("<f2").tobytes()
    out = exr_codecs.unpack_b44(exr_codecs.pack_b44(data, [("R", "<f2")], 8, 8), [("R", "<f2")], 8, 8)
    assert out == data


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("tile", [(16, 16), (7, 40), (64, 64)])
def test_tiles(kind, tile):
    v = smooth(50, 45)
    assert np.allclose(hdr.decode_exr(hdr.encode_exr(v, kind, tile=tile)), v, rtol=1e-4)


@pytest.mark.parametrize(("mode", "tiles"), [(0, 4), (1, 4 + 1 + 1 + 1 + 1 + 1), (2, None), (0x11, None)])
def test_tiles_of_smaller_sizes(mode, tiles):
    n = hdr._tiles_of_levels(32, 32, 16, 16, mode)
    assert n == (tiles if tiles else {2: sum(-(-max(1, 32 >> i) // 16) * -(-max(1, 32 >> j) // 16) for i in range(6) for j in range(6)), 0x11: 9}[mode])


@pytest.mark.parametrize("kind", [hdr.PIZ, hdr.PXR24, hdr.B44])
def test_damaged_blocks_raise_a_value_error(kind):
    content = hdr.encode_exr(smooth(40, 40), kind, True)
    layout = hdr.exr_layout(content)
    for seed in range(60):
        rng = np.random.default_rng(seed)
        damaged = bytearray(content)
        for at in rng.integers(layout.size + 8, len(content), 3):
            damaged[at] = rng.integers(0, 256)
        try:
            hdr.decode_exr(bytes(damaged))
        except ValueError:
            pass
    with pytest.raises(ValueError):
        hdr.decode_exr(content[: len(content) - 20])


def test_tiled_files_by_the_data_source(spark, tmp_path):
    register(spark)
    v = smooth(200, 90)
    (tmp_path / "t.exr").write_bytes(hdr.encode_exr(v, hdr.ZIP, tile=(32, 16)))
    read = spark.read.format("pixels").option("split", 6000).load(str(tmp_path))
    assert read.rdd.getNumPartitions() > 3 and np.array_equal(array(read, 200, 90), v.astype(float))
    assert {r["y"] for r in read.filter("y BETWEEN 15 AND 17").collect()} == {15, 16, 17} and read.filter("y BETWEEN 15 AND 17").count() == 270
