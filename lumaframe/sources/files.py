"""Image files to pixel tables, and pixel tables to files, as bytes that tasks decode and encode."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions import color
from lumaframe.functions.text import file_kind, mode_label, save_formats
from lumaframe.operators.display import file_bytes
from lumaframe.operators.pick import pixel_text
from lumaframe.operators.select import weighted
from lumaframe.schema import CHANNELS, Rect, channels_of, check_file_size, sizes
from lumaframe.sources import hdr, jpeg, png
from lumaframe.storage import scratch_path

#: Files that Spark's image source reads.
RASTER, RASTER_GLOB = r"(?i)\.(jpe?g|gif|bmp)$", "*.{jpg,jpeg,gif,bmp,JPG,JPEG,GIF,BMP}"
#: Rows of pixels that a task gives at a time.
STRIP = 256
DECODED = "image_id string, type string, source_format string, width int, height int, error string, y0 int, strip binary"
FILES = "image_id string, content binary"
PARTS = "image_id string, part int, content binary"
# Fixed value: the quality at which pictures are saved.
JPEG_QUALITY = 0.95
#: Pixels of a part of a file, about; at least a block of lines.
PART_PIXELS = 1 << 17
EXR_KINDS = {"exr": hdr.NONE, "exr-zip": hdr.ZIP, "exr-piz": hdr.PIZ, "exr-pxr24": hdr.PXR24}


def _decode(path: str, content: bytes, kind: str) -> tuple[np.ndarray, str, str]:
    if kind == "exr":
        return hdr.decode_exr(content), "openexr/float", "exr"
    if kind == "hdr":
        return hdr.decode_rgbe(content), "radiance-hdr/float", "hdr"
    if content[:8] != png.MAGIC:
        raise ValueError("No decoder for this format.")
    decoded = png.decode(content)
    return png.linear(decoded["pixels"]), f"{png.type_label(decoded)} {png.transfer_text(decoded)}".rstrip(), "raster"


def _strips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content, kind in zip(pdf["path"], pdf["content"], pdf["kind"], strict=True):
            try:
                pixels, type_, fmt = _decode(path, bytes(content), kind)
            except Exception as e:  # one damaged file doesn't stop the others: its row has the error
                yield pd.DataFrame([(path, None, None, None, None, f"{type(e).__name__}: {e}", None, None)], columns=[c.split()[0] for c in DECODED.split(", ")])
                continue
            h, w = pixels.shape[:2]
            for y in range(0, h, STRIP):
                yield pd.DataFrame([(path, type_, fmt, w, h, None, y, pixels[y : y + STRIP].astype("<f4").tobytes())], columns=[c.split()[0] for c in DECODED.split(", ")])


def decoded(spark: SparkSession, *paths: str) -> DataFrame:
    """Strips of the PNG, Radiance and OpenEXR files at paths (globs allowed), one row each, or a row with the error of a file that can't be read.

    Empty files, and those that read_raster reads, are left out.
    """
    found = spark.read.format("binaryFile").load(list(paths)).filter("length > 0").filter(~F.col("path").rlike(RASTER)).select("path", "content", file_kind(F.col("path")).alias("kind"))
    return found.mapInPandas(_strips, DECODED)


def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for image_id, w, y0, strip in zip(pdf["image_id"], pdf["width"], pdf["y0"], pdf["strip"], strict=True):
            v = np.frombuffer(strip, "<f4").reshape(-1, int(w), 4)
            y, x = np.indices(v.shape[:2])
            yield pd.DataFrame({"image_id": image_id, "y": (y.ravel() + int(y0)).astype(np.int32), "x": x.ravel().astype(np.int32)} | {c: v[..., k].ravel() for k, c in enumerate(CHANNELS)})


PIXEL_DDL = "image_id string, y int, x int, r float, g float, b float, a float"


def read_images(spark: SparkSession, *paths: str) -> DataFrame:
    """The pixel table of all files that can be read; those that can't are left out (image_records() tells why)."""
    own = decoded(spark, *paths).filter("error IS NULL").select("image_id", "width", "y0", "strip").mapInPandas(_explode, PIXEL_DDL)
    return own.unionByName(read_raster(spark, *paths))


def image_records(spark: SparkSession, *paths: str) -> DataFrame:
    """(image_id, name, width, height, type, source_format, auto_level, error) of each file."""
    rows = decoded(spark, *paths).filter("y0 = 0 OR error IS NOT NULL").drop("y0", "strip")
    kind = F.lower(F.regexp_extract("image_id", r"\.([^.]+)$", 1))
    raster = _raster(spark, *paths).select("image_id", F.concat(F.lit("image/"), F.when(kind == "jpg", "jpeg").otherwise(kind), F.when(F.col("nChannels") == 4, " (RGB approximate where alpha < 1)").otherwise("")).alias("type"), F.lit("raster").alias("source_format"), "width", "height", "error")
    raster = raster.select("image_id", *[F.when(F.isnull("error"), F.col(c)).alias(c) for c in ("type", "source_format", "width", "height")], "error")
    return rows.unionByName(raster).select("image_id", F.element_at(F.split("image_id", "/"), -1).alias("name"), "width", "height", "type", "source_format", F.coalesce(F.col("source_format").isin("hdr", "exr"), F.lit(False)).alias("auto_level"), "error")


def raster_size(head: bytes) -> tuple[int, int] | None:
    """(width, height) that the first bytes of a JPEG, GIF or BMP file tell; None where they tell none."""
    if head[:4] == b"GIF8" and len(head) >= 10:
        return struct.unpack_from("<HH", head, 6)
    if head[:2] == b"BM" and len(head) >= 26:
        width, height = struct.unpack_from("<HH" if struct.unpack_from("<I", head, 14)[0] == 12 else "<ii", head, 18)
        return width, abs(height)
    at = 2
    while head[:2] == b"\xff\xd8" and at + 9 <= len(head) and head[at] == 0xFF:
        kind, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        # Frame headers are C0 to CF, but for tables (C4), reserved (C8) and arithmetic conditioning (CC).
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return struct.unpack_from(">HH", head, at + 5)[::-1]
        at += 1 if kind == 0xFF else 2 + size
    return None


def _headers(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, header_error) of the JPEG, GIF and BMP files: why one can't be opened, by its first bytes, or null."""

    def run(batches):
        for pdf in batches:
            errors = []
            for content in pdf["content"]:
                try:
                    size = raster_size(bytes(content))
                    if not size or min(size) < 1:
                        raise ValueError("The file is damaged, or no JPEG, GIF or BMP file.")
                    check_file_size(*size)
                    errors.append(None)
                except (ValueError, struct.error) as e:
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": pdf["path"], "header_error": errors})

    found = spark.read.format("binaryFile").option("pathGlobFilter", RASTER_GLOB).load(list(paths)).filter("length > 0")
    return found.select("path", "content").mapInPandas(run, "path string, header_error string")


def _raster(spark: SparkSession, *paths: str) -> DataFrame:
    """(image_id, width, height, nChannels, data, error) of the JPEG, GIF and BMP files. Those whose header is wrong or too large never reach the decoder."""
    load = lambda some: spark.read.format("image").option("pathGlobFilter", RASTER_GLOB).load(some)
    headers = _headers(spark, *paths)
    refused = headers.filter("header_error IS NOT NULL").select("path", "header_error").persist()
    one_slash = F.regexp_replace("path", "^file:///", "file:/")
    if refused.limit(1).count():
        # The image source takes paths, not rows: the good ones are named to it, as its own listing would.
        good = [r["path"] for r in headers.filter("header_error IS NULL").select("path").collect()]
        images = load(good) if good else load(list(paths)).limit(0)
    else:
        images = load(list(paths))
    damaged = F.when(F.col("image.height") < 1, "ValueError: The file is damaged.").alias("error")
    read = images.select(F.regexp_replace("image.origin", "^file:///", "file:/").alias("image_id"), "image.width", "image.height", "image.nChannels", "image.data", damaged)
    absent = [F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("nChannels", "int"), ("data", "binary"))]
    return read.unionByName(refused.select(one_slash.alias("image_id"), *absent, F.col("header_error").alias("error")))


def read_raster(spark: SparkSession, *paths: str) -> DataFrame:
    """JPEG, GIF and BMP files by Spark's image source: 8 bits, out of sRGB. Damaged and oversized ones are left out. WebP and AVIF have no decoder here."""

    def explode(batches):
        for pdf in batches:
            for image_id, w, h, n, data in zip(pdf["image_id"], pdf["width"], pdf["height"], pdf["nChannels"], pdf["data"], strict=True):
                v = np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(n))
                v = v[..., [2, 1, 0, *([3] if n == 4 else [])]] if n >= 3 else np.repeat(v, 3, axis=2)
                full = np.ones((int(h), int(w), 4))
                full[..., : v.shape[2]] = v / 255
                v = png.linear(full)
                y, x = np.indices(v.shape[:2])
                yield pd.DataFrame({"image_id": image_id, "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32)} | {c: v[..., k].ravel() for k, c in enumerate(CHANNELS)})

    return _raster(spark, *paths).filter("error IS NULL").drop("error").mapInPandas(explode, PIXEL_DDL)


def _jpeg(rgba: np.ndarray) -> bytes:
    """JPEG has no alpha: pixels stand on black. The quality is that of saved pictures."""
    return jpeg.encode(np.rint(rgba[..., :3] * (rgba[..., 3:] / 255)).astype(np.uint8), JPEG_QUALITY)


def encoded_files(pixels: DataFrame, kind: str, source_format: str = "values") -> DataFrame:
    """(image_id, content) of each image as png, jpeg, hdr, exr or exr with a compression's name (exr-zip, exr-piz, exr-pxr24). One image is one group, as it is one file.

    Sizes are looked up before anything is gathered: an image of more than PROGRAM_PIXELS raises; exr_parts() has no such limit.
    """
    if kind.partition("-")[0] not in save_formats(source_format):
        raise ValueError(f"{source_format} images can't be saved as {kind}.")
    if kind not in ("png", "jpeg", "hdr", *EXR_KINDS):
        raise ValueError(f"There is no encoder for {kind}.")
    largest = sizes(pixels).orderBy(F.desc(F.col("width").cast("long") * F.col("height"))).first()
    if largest:
        check_file_size(largest["width"], largest["height"])
    if kind in ("png", "jpeg"):
        values = file_bytes(pixels)
    elif kind == "hdr":
        values = pixels.select("image_id", "y", "x", color.rgbe().alias("v")).select("image_id", "y", "x", "v.r", "v.g", "v.b", F.col("v.e").alias("a"))
    else:
        values = pixels

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        image = np.zeros((h, w, 4), np.float32 if kind in EXR_KINDS else np.uint8)
        image[pdf["y"], pdf["x"]] = pdf[list(CHANNELS)].to_numpy(image.dtype)
        content = {"png": png.encode, "jpeg": _jpeg, "hdr": hdr.encode_rgbe}.get(kind, lambda v: hdr.encode_exr(v, EXR_KINDS[kind]))(image)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "content": [content]})

    return values.groupBy("image_id").applyInPandas(run, FILES)


def exr_parts(pixels: DataFrame, kind: str = "exr") -> DataFrame:
    """(image_id, part, content) of each image as an OpenEXR file, for the image-parts sink: the header is part -1, and runs of lines are encoded by as many tasks as there are.

    Only what the header says of an image is gathered, some bytes for each block of lines. Lines and pixels that are missing are 0.
    """
    compression = EXR_KINDS[kind]
    widest = sizes(pixels).agg(F.max("width")).first()[0] or 1
    block = hdr.BLOCK_LINES[compression]
    lines = block * max(1, PART_PIXELS // widest // block)
    # A row for each part says how large the image is, and makes parts without a pixel.
    zero = [F.lit(0.0).cast("float").alias(c) for c in CHANNELS]
    parts = F.explode(F.sequence(F.lit(0), F.expr(f"CAST((height - 1) div {lines} AS int)")))
    blank = sizes(pixels).select("image_id", parts.alias("part"), F.lit(-1).alias("y"), F.lit(-1).alias("x"), *zero, "width", "height")
    rows = pixels.select("image_id", F.expr(f"CAST(y div {lines} AS int)").alias("part"), "y", "x", *CHANNELS, F.lit(0).alias("width"), F.lit(0).alias("height")).unionByName(blank)

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        part, width, height = int(pdf["part"].iloc[0]), int(pdf["width"].max()), int(pdf["height"].max())
        top, own = part * lines, pdf[pdf["width"] == 0]
        image = np.zeros((min(lines, height - top), width, 4), np.float32)
        image[own["y"] - top, own["x"]] = own[list(CHANNELS)].to_numpy(np.float32)
        blocks = hdr.exr_blocks(image, compression, top=top)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "part": [part], "width": [width], "height": [height], "sizes": [[len(b) for b in blocks]], "content": [b"".join(blocks)]})

    spark, path = pixels.sparkSession, scratch_path(pixels.sparkSession, "exr-parts")
    schema = "image_id string, part int, width int, height int, sizes array<int>, content binary"
    rows.groupBy("image_id", "part").applyInPandas(encode, schema).write.parquet(path)
    encoded = spark.read.schema(schema).parquet(path)
    images = encoded.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "sizes"))), lambda p: p["sizes"])).alias("sizes"))

    def heads(batches):
        for pdf in batches:
            content = [hdr.exr_head(w, h, found, compression) for w, h, found in zip(pdf["width"], pdf["height"], pdf["sizes"], strict=True)]
            yield pd.DataFrame({"image_id": pdf["image_id"], "part": np.full(len(pdf), -1, np.int32), "content": content})

    return images.mapInPandas(heads, PARTS).unionByName(encoded.select("image_id", "part", "content"))


def selection_rows(pixels: DataFrame, rect: Rect, mode: str = "rgba", encoding: str = "linear") -> DataFrame:
    """(x, y, mode, display, channels...) of the pixels in rect, which count from the image's corner; values as text."""
    cells = [pixel_text(color.encode(weighted(mode, c), encoding, c == "a"), encoding).alias(c) for c in channels_of(mode)]
    inside = pixels.filter(F.col("x").between(rect.x, rect.x + rect.width - 1) & F.col("y").between(rect.y, rect.y + rect.height - 1))
    return inside.select("x", "y", F.lit(encoding).alias("mode"), mode_label(F.lit(mode)).alias("display"), *cells)


def write_selection_csv(rows: DataFrame, path: str) -> None:
    """rows(x, y, mode, display, channels...) as one CSV file with a header, quotes doubled."""
    rows.orderBy("y", "x").coalesce(1).write.csv(path, header=True, escape='"')
