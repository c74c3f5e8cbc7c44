"""A catalog of images: frames under names, their records, pickers and selections; saved as plans, not as results."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.operators import generate, pick, select, stencil
from lumaframe.operators.aggregate import image_range
from lumaframe.plans import share
from lumaframe.programs import run
from lumaframe.programs.text import ShaderError
from lumaframe.schema import COPY_PIXELS, PORTABLE_PIXELS, Rect
from lumaframe.sources import files, matrix


def view_name(image_id: str) -> str:
    """The name of an image's view: what a name can't hold becomes its code in hexadecimal."""
    return "image_" + re.sub(r"[^0-9A-Za-z_]", lambda m: f"_{ord(m[0]):x}_", image_id)


@dataclass
class Image:
    """What is known of an image besides its pixels."""

    name: str
    width: int
    height: int
    #: files (path), generated (program) or embedded (a table that save() writes).
    source: dict
    source_format: str = "raster"
    channel: str = "rgba"
    auto_level: bool = False
    brightness: float = 1.0
    selection: Rect | None = None
    pickers: list[dict] = field(default_factory=list)
    #: Program over the original, with the last text that worked and the last one tried.
    program: dict | None = None


#: What a link shows whose own program can't be used.
DEFAULT_TEXT = "outputColor = vec4(uv, 0.0, 1.0);"


class ProgramError(ValueError):
    """A program can't be used; the image keeps the last result.

    Of column expressions, channel says whose it is and place where in it, counted from 0; of a program's text, line and column say where, counted from 1.
    """

    def __init__(self, message: str, channel: str | None = None, place: int | None = None, line: int | None = None, column: int | None = None):
        super().__init__(message)
        self.channel, self.place, self.line, self.column = channel, place, line, column


class Catalog:
    """Open images. Frames are lazy: a program or a crop is a plan until an action asks for it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.images: dict[str, Image] = {}
        self.frames: dict[str, DataFrame] = {}
        self.originals: dict[str, DataFrame] = {}
        self._cached: dict[tuple, DataFrame] = {}

    def add(self, image_id: str, pixels: DataFrame, image: Image) -> None:
        """Show pixels under image_id, which their rows then carry, whatever they are read from."""
        self.close(image_id)
        pixels = pixels.withColumn("image_id", F.lit(image_id))
        self.images[image_id], self.frames[image_id], self.originals[image_id] = image, pixels, pixels
        pixels.createOrReplaceTempView(view_name(image_id))

    def open(self, image_id: str, path: str) -> None:
        record = files.image_records(self.spark, path).first()
        if record is None or record["error"]:
            raise ValueError(record["error"] if record else f"{path} is empty.")
        image = Image(record["name"], record["width"], record["height"], {"kind": "file", "path": path}, record["source_format"], auto_level=record["auto_level"])
        self.add(image_id, files.read_images(self.spark, path), image)

    def paste(self, image_id: str, text: str) -> None:
        pixels = matrix.read_text(self.spark, text, {k: v for k, v in self.frames.items()}, image_id)
        if pixels is None:
            raise ValueError("The text holds no values.")
        size = pixels.selectExpr("max(x) + 1 AS w", "max(y) + 1 AS h").first()
        span = image_range(pixels).selectExpr("least(rgb_min, min_a) AS low", "greatest(rgb_max, max_a) AS high").first()
        self.add(image_id, pixels, Image("pasted values", size["w"], size["h"], {"kind": "embedded"}, "values", auto_level=span["low"] < 0 or span["high"] > 1))

    def generate(self, image_id: str, width: int, height: int, **channels: str) -> None:
        """An image computed from column expressions over u, v, x, y, or from a program's `text`."""
        self.add(image_id, self._checked(lambda some: self._generated(width, height, some), channels), Image(image_id, width, height, {"kind": "generated", "channels": channels}, "glsl"))

    def open_link(self, image_id: str, link: str) -> bool:
        """The image of a shared program; False if the link holds none.

        A text that can't be used is kept for the editor and the image's own link, with the error beside it; the image then shows DEFAULT_TEXT.
        """
        state = share.decode(link)
        if not state:
            return False
        code, size = state["code"], (state["width"], state["height"])
        try:
            channels = share.channels_of_code(code)
        except ValueError:
            channels = {"text": code}
        try:
            self.generate(image_id, *size, **channels)
        except ProgramError as e:
            self.generate(image_id, *size, text=DEFAULT_TEXT)
            self.images[image_id].program = {"tried": channels, "worked": None, "error": str(e)}
        return True

    def link_of(self, image_id: str) -> str:
        """The link of a generated image, of the text tried last."""
        image = self.images[image_id]
        channels = (image.program or {}).get("tried") or image.source["channels"]
        return share.encode(image.width, image.height, channels["text"] if "text" in channels else share.code_of(channels))

    def pickers(self) -> DataFrame:
        """(image_id, picker_id, x, y, color) of all images."""
        rows = [(k, [(p["picker_id"], p["x"], p["y"], p.get("color")) for p in image.pickers]) for k, image in self.images.items()]
        return pick.of_images(self.spark.createDataFrame(rows, "image_id string, pickers array<struct<picker_id int, x int, y int, color string>>"))

    def _generated(self, width: int, height: int, channels: dict[str, str]) -> DataFrame:
        if "text" in channels:
            return run.generated(self.spark, channels["text"], width, height)
        return generate.canvas(self.spark, width, height).selectExpr("image_id", "y", "x", *[f"CAST({channels.get(c, '1' if c == 'a' else '0')} AS float) AS {c}" for c in "rgba"])

    def _checked(self, build: Callable[[dict[str, str]], DataFrame], channels: dict[str, str]) -> DataFrame:
        """The frame of channels; analysis happens here, without a job. If it fails, each channel is tried alone, to say which it is."""
        for part in (channels, *({c: e} for c, e in channels.items())):
            try:
                frame = build(part)
                frame.schema  # noqa: B018
                if part is channels:
                    return frame
            except ShaderError as e:
                raise ProgramError(str(e), line=e.line, column=e.column) from e
            except (AnalysisException, ParseException) as e:
                if part is channels and len(part) > 1:
                    error = e
                    continue
                found = re.search(r"line 1, pos (\d+)", str(e))
                raise ProgramError(f"{e.getCondition()}: {e}", next(iter(part), None), int(found[1]) if found else None) from e
        raise ProgramError(f"{error.getCondition()}: {error}") from error

    def program(self, image_id: str, **channels: str) -> None:
        """Show the image through column expressions or a program's `text`; on an error the last result stays and the text is kept apart."""
        image = self.images[image_id]
        image.program = {"tried": channels, "worked": (image.program or {}).get("worked")}
        shown = lambda some: run.shade(self.originals[image_id], some["text"]) if "text" in some else stencil.mapped(self.originals[image_id], **some)
        frame = self._checked(shown, channels)
        image.program["worked"] = channels
        self._replace(image_id, frame)

    def original(self, image_id: str) -> None:
        self._replace(image_id, self.originals[image_id])

    def _replace(self, image_id: str, frame: DataFrame) -> None:
        self.frames[image_id] = frame
        frame.createOrReplaceTempView(view_name(image_id))
        self._forget(image_id)

    def _forget(self, image_id: str) -> None:
        for key in [k for k in self._cached if k[0] == image_id]:
            self._cached.pop(key).unpersist()

    def select(self, image_id: str, rect: Rect) -> DataFrame:
        """The clamped crop, cached until the image or the rectangle changes."""
        image = self.images[image_id]
        image.selection = rect.clamped(image.width, image.height)
        key = (image_id, image.selection)
        if key not in self._cached:
            self._forget(image_id)
            self._cached[key] = select.crop(self.frames[image_id], image.selection).persist()
        return self._cached[key]

    def copy(self, image_id: str) -> str:
        """A text of the selection: whole if it is small, else a reference to a frame of this catalog."""
        rect = self.images[image_id].selection or Rect(0, 0, self.images[image_id].width, self.images[image_id].height)
        pixels = self.select(image_id, rect)
        if rect.width * rect.height > COPY_PIXELS:
            raise ValueError(f"Copies are limited to {COPY_PIXELS} pixels.")
        if rect.width * rect.height <= PORTABLE_PIXELS:
            return matrix.write_text(pixels, rect.width, rect.height)
        self.frames["copy"] = pixels
        return matrix.internal_text("copy", rect.width, rect.height)

    def close(self, image_id: str) -> None:
        self._forget(image_id)
        if self.images.pop(image_id, None):
            self.frames.pop(image_id), self.originals.pop(image_id)
            self.spark.catalog.dropTempView(view_name(image_id))

    def save(self, path: str) -> None:
        """Plans of all images as a JSON line each; embedded pixels as parquet beside them, generated ones not at all."""
        for image_id, image in self.images.items():
            if image.source["kind"] == "embedded":
                self.originals[image_id].write.mode("overwrite").parquet(f"{path}/pixels/{image_id}")
        rows = [(json.dumps({"version": 1, "id": k} | asdict(v)),) for k, v in self.images.items()]
        self.spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/session")

    @classmethod
    def restore(cls, spark: SparkSession, path: str) -> Catalog:
        """Rebuild the lazy frames. An image whose source is gone is left out; a program that no longer works leaves the original."""
        out = cls(spark)
        for (line,) in spark.read.text(f"{path}/session").collect():  # a line for each open image
            state = json.loads(line)
            image_id, _ = state.pop("id"), state.pop("version")
            state["selection"] = Rect(**state["selection"]) if state["selection"] else None
            image = Image(**state)
            kind = image.source["kind"]
            try:
                frame = spark.read.parquet(f"{path}/pixels/{image_id}") if kind == "embedded" else out._generated(image.width, image.height, image.source["channels"]) if kind == "generated" else files.read_images(spark, image.source["path"])
            except AnalysisException:
                continue
            out.add(image_id, frame, image)
            if image.program and image.program["worked"]:
                try:
                    out.program(image_id, **image.program["worked"])
                except ProgramError:
                    out.original(image_id)
        return out
