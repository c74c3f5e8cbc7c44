"""The pixel table and the values that describe parts of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, IntegerType, StringType, StructField, StructType

CHANNELS = ("r", "g", "b", "a")
#: Linear RGBA values, one row a pixel; (image_id, y, x) is unique, y counts from the top, channels are never null.
PIXELS = StructType([StructField("image_id", StringType()), StructField("y", IntegerType()), StructField("x", IntegerType()), *(StructField(c, FloatType()) for c in CHANNELS)])

# Limits that raise errors.
MATRIX_PIXELS = 1_048_576
PORTABLE_PIXELS = 512 * 512
COPY_PIXELS = 4096 * 2048
PROGRAM_PIXELS = 8_388_608
SHARE_CHARS, SHARE_CODE_CHARS = 256 * 1024, 128 * 1024
MOST_PICKERS = 20
GRID_SIZE = 64
PREVIEW_ROWS, PREVIEW_COLUMNS = 8, 12
MODES = ("rgba", "rgb", "r", "g", "b", "a")
ENCODINGS = ("linear", "srgb", "srgb255")


@dataclass(frozen=True)
class Rect:
    """A rectangle of pixels; corners are inclusive."""

    x: int
    y: int
    width: int
    height: int

    @classmethod
    def between(cls, ax: int, ay: int, bx: int, by: int) -> Rect:
        """The rectangle with these two opposite corners."""
        return cls(min(ax, bx), min(ay, by), abs(ax - bx) + 1, abs(ay - by) + 1)

    def clamped(self, width: int, height: int) -> Rect:
        """The part inside an image, one pixel at least."""
        x, y = min(max(self.x, 0), width - 1), min(max(self.y, 0), height - 1)
        return Rect(x, y, min(max(self.width or 1, 1), width - x), min(max(self.height or 1, 1), height - y))


def channels_of(mode: str) -> tuple[str, ...]:
    """The channels that a display mode shows."""
    if mode not in MODES:
        raise ValueError(f"There is no display mode {mode!r}.")
    return CHANNELS if mode == "rgba" else ("r", "g", "b") if mode == "rgb" else (mode,)


def check_size(width: int, height: int, limit: int | None = MATRIX_PIXELS) -> None:
    if not all(isinstance(n, int) and not isinstance(n, bool) and n >= 1 for n in (width, height)):
        raise ValueError("Width and height have to be whole numbers from 1 on.")
    if limit and width * height > limit:
        raise ValueError(f"A text may hold {limit} pixels at most.")


def check_file_size(width: int, height: int) -> None:
    """Raise for sizes of files that one task shouldn't decode; asked before anything is unpacked."""
    if width < 1 or height < 1 or width * height > PROGRAM_PIXELS:
        raise ValueError(f"{width} x {height} is outside of 1 to {PROGRAM_PIXELS} pixels.")


def check_encoding(encoding: str | None) -> str:
    found = str(encoding or "linear").lower()
    if found not in ENCODINGS:
        raise ValueError(f"There is no encoding {encoding!r}.")
    return found


def check_channels(channels) -> list[int]:
    """Channel numbers of 1 to 4 different letters or numbers."""
    if not isinstance(channels, (list, tuple)) or not 1 <= len(channels) <= 4:
        raise ValueError("A list of one to four channels is asked for.")
    found = []
    for c in channels:
        k = c if isinstance(c, int) and 0 <= c <= 3 else "RGBA".find(str(c or "").upper()) if len(str(c)) == 1 else -1
        if k < 0:
            raise ValueError(f"There is no channel {c!r}.")
        found.append(k)
    if len(set(found)) < len(found):
        raise ValueError("A channel stands twice in the list.")
    return found


def sizes(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height) of each image."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
