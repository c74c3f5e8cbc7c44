"""Image files as a Spark data source, and sinks that commit in two phases.

    register(spark)
    pixels = spark.read.format("pixels").load(folder)               # image_id, y, x, r, g, b, a
    files.encoded_files(pixels, "png").write.format("image-files").option("suffix", ".png").mode("append").save(folder)
    save_parts(files.exr_parts(pixels, "exr-zip"), folder, ".exr")
    lines.write.format("ordered-lines").option("header", "x,y").mode("append").save(folder)

A large OpenEXR file is read by several tasks, each with the blocks of lines or rows of tiles that its offset table names, and a large Radiance file of flat
lines likewise; small files share tasks. Filters on y and image_id reach the source: blocks without a line that is asked for are neither
read nor unpacked. Tasks open files by pyarrow, so paths are local or of a store that it knows (hdfs, s3, gs, abfs); read_images() takes all that Spark reads.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from lumaframe.functions.text import csv_cell
from lumaframe.schema import CHANNELS
from lumaframe.sources import hdr
from lumaframe.sources.files import _decode
from lumaframe.storage import TEMPORARY, listed, opened

PIXEL_DDL = "image_id string, y int, x int, r float, g float, b float, a float"
#: Bytes of files that a task reads, if the option `split` doesn't say.
SPLIT = 16 << 20
#: Bytes that a header is first looked for in.
HEAD = 1 << 16
#: Pixels of a record batch.
BATCH = 1 << 18
#: Endings and the decoders' names for them.
KINDS = {".exr": "exr", ".hdr": "hdr", ".pic": "hdr", ".png": "raster"}


@dataclass
class Piece(InputPartition):
    """Files of a task: (path, bytes, first block, end), with no end where the file is read whole; the layout of a part of an OpenEXR file has the offsets of its blocks alone."""

    files: list[tuple[str, int, int, int | None]]
    layout: hdr.ExrLayout | None = None


def _kind(path: str) -> str | None:
    return KINDS.get(posixpath.splitext(path)[1].lower())


def _layout(file: pa.NativeFile, size: int) -> hdr.ExrLayout:
    """An OpenEXR file's header, from as many of its first bytes as that takes."""
    n = min(HEAD, size)
    while True:
        file.seek(0)
        try:
            return hdr.exr_layout(file.read(n))
        except (IndexError, struct.error, ValueError) as e:
            # A header cut short can look like anything; one that is whole and wrong stays wrong.
            if n >= size:
                raise ValueError(f"OpenEXR header is damaged: {e}") from e
            n = min(4 * n, size)


def _flat(file: pa.NativeFile, size: int) -> tuple[int, int, int] | None:
    """(width, height, place of the first line) of a Radiance file of flat lines, or None."""
    file.seek(0)
    width, height, at = hdr.rgbe_size(file.read(min(HEAD, size)))
    file.seek(at)
    return (width, height, at) if size == at + 4 * width * height and not hdr._coded(file.read(4), width) else None


class PixelReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path") or options.get("paths")
        if not self.path:
            raise ValueError("Give a path to load.")
        self.split = int(options.get("split", SPLIT))
        self.skips = {"fail": False, "skip": True}[options.get("damaged", "fail")]
        #: Lines asked for, the end excluded, and names asked for.
        self.low, self.high, self.names = 0, 1 << 31, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        if isinstance(f, IsNotNull):
            return f.attribute in (("image_id",), ("y",), ("x",))
        if getattr(f, "attribute", None) == ("y",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            return True
        if getattr(f, "attribute", None) == ("image_id",) and isinstance(f, EqualTo | In):
            names = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.names = names if self.names is None else self.names & names
            return True
        return False

    def partitions(self) -> list[Piece]:
        pieces, small, filled = [], [], 0
        for path, size in listed(self.path):
            kind = _kind(path)
            if kind is None or self.names is not None and path not in self.names or self.low >= self.high:
                continue
            if size > self.split and kind in ("exr", "hdr"):
                try:
                    pieces += self._blocks(path, size, kind)
                    continue
                except ValueError:
                    pass  # the task that reads the whole file says what is wrong
            if small and filled + size > self.split:
                pieces.append(Piece(small))
                small, filled = [], 0
            small.append((path, size, 0, None))
            filled += size
        # Spark reads one piece even where there is none.
        return [*pieces, *([Piece(small)] if small or not pieces else [])]

    def _blocks(self, path: str, size: int, kind: str) -> list[Piece]:
        """Runs of blocks of about `split` bytes that have lines that are asked for."""
        system, place = opened(path)
        layout = None
        with system.open_input_file(place) as file:
            if kind == "exr":
                layout = _layout(file, size)
                n, lines, height = len(layout.offsets) // layout.across, layout.lines, layout.height
            else:
                flat = _flat(file, size)
                if not flat:
                    raise ValueError("Coded lines are read one after another.")
                n, lines, height = flat[1], 1, flat[1]
        first, end = min(self.low, height) // lines, -(-min(self.high, height) // lines)
        step = max(1, int(n * self.split / size))
        # Tasks get the offsets of their blocks, so that the table is read once and not by each of them.
        own = lambda k: layout and replace(layout, offsets=layout.offsets[k * layout.across : min(k + step, end) * layout.across])
        return [Piece([(path, size, k, min(k + step, end))], own(k)) for k in range(first, end, step)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        for path, size, first, end in partition.files:
            try:
                yield from self._file(path, size, first, end, partition.layout)
            except (ValueError, IndexError, KeyError, struct.error) as e:
                if not self.skips:
                    raise ValueError(f"{path}: {e}") from e

    def _file(self, path: str, size: int, first: int, end: int | None, layout: hdr.ExrLayout | None = None) -> Iterator[pa.RecordBatch]:
        system, place = opened(path)
        kind = _kind(path)
        with system.open_input_file(place) as file:
            if kind == "exr":
                if layout is None:
                    layout = _layout(file, size)
                    n, lines = len(layout.offsets) // layout.across, layout.lines
                    first, end = max(first, self.low // lines), min(n if end is None else end, -(-self.high // lines))
                    layout = replace(layout, offsets=layout.offsets[first * layout.across : end * layout.across])
                # Blocks needn't lie in the order of their lines, and each says how long it is.
                for at in layout.offsets:
                    file.seek(at)
                    head = file.read(layout.head)
                    if len(head) < layout.head or at < layout.size:
                        raise ValueError("OpenEXR offsets are damaged.")
                    y, x, pixels, _ = hdr.exr_block(layout, head + file.read(struct.unpack("<I", head[-4:])[0]), 0)
                    yield from self._rows(path, y, pixels, x)
            elif kind == "hdr" and (flat := _flat(file, size)):
                width, height, at = flat
                first, end = max(first, self.low), min(height if end is None else end, self.high)
                step = max(1, BATCH // width)
                for y in range(first, end, step):
                    file.seek(at + 4 * width * y)
                    rows = min(step, end - y)
                    yield from self._rows(path, y, hdr.rgbe_values(np.frombuffer(file.read(4 * width * rows), np.uint8).reshape(rows, width, 4)))
            else:
                file.seek(0)
                yield from self._rows(path, 0, _decode(path, file.read(), kind)[0])

    def _rows(self, path: str, y0: int, pixels: np.ndarray, x0: int = 0) -> Iterator[pa.RecordBatch]:
        low, high = max(self.low - y0, 0), min(self.high - y0, len(pixels))
        width = pixels.shape[1]
        step = max(1, BATCH // width)
        for top in range(low, high, step):
            part = pixels[top : min(top + step, high)]
            y, x = np.indices(part.shape[:2], np.int32)
            ids = pa.DictionaryArray.from_arrays(pa.array(np.zeros(y.size, np.int8)), pa.array([path])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(y.ravel() + np.int32(y0 + top)), pa.array(x.ravel() + np.int32(x0)), *(pa.array(np.ascontiguousarray(part[..., k]).ravel(), pa.float32()) for k in range(4))], ["image_id", "y", "x", *CHANNELS])


class PixelSource(DataSource):
    """Options: path (a file, a folder or a pattern), split (bytes a task), damaged (fail or skip)."""

    @classmethod
    def name(cls) -> str:
        return "pixels"

    def schema(self) -> str:
        return PIXEL_DDL

    def reader(self, schema) -> PixelReader:
        return PixelReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """Files that a task wrote aside, with the names that they get."""

    files: list[tuple[str, str]]


class _TwoPhase(DataSourceWriter):
    """Tasks write into folders of their own attempts; the driver moves the files of those that ended well and drops all else.

    A file that has the name of a new one is replaced. A rename is one step on file systems that have it; object stores copy.
    """

    #: Whether the files are one result, which can't be added to.
    whole = False

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite = options, overwrite
        if not options.get("path"):
            raise ValueError("Give a path to save to.")
        system, self.place = opened(options["path"])
        self.aside = f"{self.place}/{TEMPORARY}/{uuid.uuid4().hex}"
        system.create_dir(self.aside, recursive=True)

    def attempt(self):
        """(file system, folder of this attempt, number of the partition)."""
        context = TaskContext.get()
        system, _ = opened(self.options["path"])
        folder = f"{self.aside}/{context.partitionId()}-{context.taskAttemptId()}"
        system.create_dir(folder, recursive=True)
        return system, folder, context.partitionId()

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.options["path"])
        moves = [move for m in messages if m for move in m.files]
        names = [name for _, name in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"Two rows have one name: {next(n for n in names if names.count(n) > 1)}")
        there = {i.base_name: i for i in system.get_file_info(FileSelector(self.place)) if i.base_name != TEMPORARY}
        if self.whole and there and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.place} holds files already.")
        for source, name in moves:
            system.move(source, f"{self.place}/{name}")
        for name in there.keys() - set(names) if self.overwrite else ():
            system.delete_dir(there[name].path) if there[name].type == FileType.Directory else system.delete_file(there[name].path)
        self._clear(system)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(opened(self.options["path"])[0])

    def _clear(self, system) -> None:
        system.delete_dir(self.aside)
        if not system.get_file_info(FileSelector(f"{self.place}/{TEMPORARY}")):
            system.delete_dir(f"{self.place}/{TEMPORARY}")


class FileWriter(_TwoPhase):
    """A row (name, content) is a file."""

    def name_of(self, image_id: str | None) -> str:
        name = f"{image_id}{self.options.get('suffix', '')}"
        if not image_id or "/" in name or name.startswith(("_", ".")):
            raise ValueError(f"{name!r} can't be the name of a file.")
        return name

    def write(self, rows) -> Written:
        system, folder, _ = self.attempt()
        out = []
        for k, row in enumerate(rows):
            name = self.name_of(row["image_id"])
            with system.open_output_stream(f"{folder}/{k}") as file:
                file.write(bytes(row["content"]))
            out.append((f"{folder}/{k}", name))
        return Written(out)


class PartWriter(FileWriter):
    """Rows (name, part, content) that follow each other under one name are a file; a task holds no more of it than a batch of rows."""

    def write(self, rows) -> Written:
        system, folder, _ = self.attempt()
        out = []
        for k, (image_id, parts) in enumerate(groupby(rows, key=lambda row: row["image_id"])):
            out.append((f"{folder}/{k}", self.name_of(image_id)))
            with system.open_output_stream(f"{folder}/{k}") as file:
                for row in parts:
                    file.write(bytes(row["content"]))
        return Written(out)


class LineWriter(_TwoPhase):
    """Lines in the order of partitions: part files whose bytes one after another are one text, with the header in the first."""

    whole = True

    def write(self, rows) -> Written:
        system, folder, number = self.attempt()
        end = self.options.get("lineend", "\n")
        header = self.options.get("header")
        with system.open_output_stream(f"{folder}/part") as file:
            pending, held = [header] if header is not None and number == 0 else [], 0
            for row in rows:
                pending.append(row["value"])
                held += len(row["value"])
                if held > 1 << 20:
                    file.write("".join(line + end for line in pending).encode())
                    pending, held = [], 0
            file.write("".join(line + end for line in pending).encode())
        return Written([(f"{folder}/part", f"part-{number:06d}.txt")])


class FileSink(DataSource):
    """Options: path, suffix (of all names). Rows: image_id string, content binary, as files.encoded_files() gives them."""

    @classmethod
    def name(cls) -> str:
        return "image-files"

    def schema(self) -> str:
        return "image_id string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options), overwrite)


class PartSink(DataSource):
    """Options: path, suffix (of all names). Rows: image_id string, part int, content binary, as save_parts() deals them."""

    @classmethod
    def name(cls) -> str:
        return "image-parts"

    def schema(self) -> str:
        return "image_id string, part int, content binary"

    def writer(self, schema, overwrite: bool) -> PartWriter:
        return PartWriter(dict(self.options), overwrite)


class LineSink(DataSource):
    """Options: path, header (a line), lineend. Rows: value string, dealt by range and sorted within partitions."""

    @classmethod
    def name(cls) -> str:
        return "ordered-lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats pixels, image-files, image-parts and ordered-lines known to a session, and filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PixelSource, FileSink, PartSink, LineSink):
        spark.dataSource.register(source)


def save_parts(parts: DataFrame, path: str, suffix: str) -> None:
    """parts(image_id, part, content) as files of their parts in order. One task writes a file, part by part."""
    register(parts.sparkSession)
    dealt = parts.repartition("image_id").sortWithinPartitions("image_id", "part")
    dealt.write.format("image-parts").option("suffix", suffix).mode("append").save(path)


def save_selection_csv(rows: DataFrame, path: str) -> None:
    """rows(x, y, mode, display, channels...) as CSV text in ordered parts, by as many tasks as the rows take: sorted by y and x, with one header, quotes doubled."""
    register(rows.sparkSession)
    line = F.concat_ws(",", *[csv_cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in rows.columns])
    ordered = rows.select(line.alias("value"), "y", "x").repartitionByRange("y", "x").sortWithinPartitions("y", "x").select("value")
    ordered.write.format("ordered-lines").option("header", ",".join(rows.columns)).mode("append").save(path)
