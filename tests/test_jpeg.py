import numpy as np
import pytest

from lumaframe.sources import files, jpeg

from .test_operators import image


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    """Pictures through a file and Spark's image source."""

    def through(*pictures, quality=0.95):
        folder = tmp_path_factory.mktemp("jpeg")
        for k, p in enumerate(pictures):
            (folder / f"{k}.jpg").write_bytes(jpeg.encode(p, quality))
        rows = spark.read.format("image").load(str(folder)).select("image.*").collect()
        return [np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["height"], r["width"], 3)[..., ::-1].astype(int) for r in sorted(rows, key=lambda r: r["origin"])]

    return through


def test_pictures_come_back_nearly(read):
    rng = np.random.default_rng(0)
    y, x = np.indices((50, 37))
    waves = np.stack([127 + 120 * np.sin(x / 9), 127 + 120 * np.cos(y / 7), 255 - (x + y)], 2).astype(np.uint8)
    pictures = [waves, rng.integers(0, 256, (64, 64, 3)).astype(np.uint8), np.zeros((1, 1, 3), np.uint8), np.full((9, 17, 3), 200, np.uint8), np.tile([[[255, 0, 0]], [[0, 0, 255]]], (8, 16, 1)).astype(np.uint8)]
    for want, got in zip(pictures, read(*pictures), strict=True):
        assert got.shape == want.shape and np.abs(got - want).max() <= 32
    assert np.abs(read(waves)[0] - waves).mean() < 1.5 and np.array_equal(read(pictures[3])[0], pictures[3])


def test_lower_quality_is_smaller_and_worse(read):
    picture = np.random.default_rng(1).integers(0, 256, (64, 64, 3)).astype(np.uint8)
    fine, coarse = (len(jpeg.encode(picture, q)) for q in (0.95, 0.3))
    assert coarse < fine / 2 and np.abs(read(picture, quality=0.3)[0] - picture).mean() > 3 * np.abs(read(picture, quality=1.0)[0] - picture).mean()


def test_codes_have_16_bits_at_most_and_none_of_ones():
    counts = np.zeros(256, np.int64)
    counts[:30] = [int(1.7**k) + 1 for k in range(30)]
    lengths = jpeg._limited(counts)
    codes, per_length, order = jpeg._canonical(lengths)
    assert lengths.max() <= 16 and (lengths > 0).sum() == 30 and sum(per_length) == len(order) == 30
    assert all(codes[s] < (1 << lengths[s]) - 1 for s in order) and sum(2.0 ** -lengths[s] for s in order) <= 1
    assert len({f"{codes[s]:0{lengths[s]}b}" for s in order}) == 30


def test_alpha_stands_on_black_and_sizes_are_limited(spark):
    v = np.zeros((8, 8, 4), np.float32)
    v[..., 0], v[..., 3] = 1.0, 0.5
    content = files.encoded_files(image(spark, v), "jpeg").first()["content"]
    assert files.raster_size(bytes(content)) == (8, 8)
    with pytest.raises(ValueError, match="65535"):
        jpeg.encode(np.zeros((1, 70_000, 3), np.uint8))
