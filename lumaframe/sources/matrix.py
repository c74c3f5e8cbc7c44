r"""Value Matrix texts: a magic line, a line of JSON, `data:`, and rows of cells such as `(2.5,0.25,0.125,1),`.

The writer joins cells and rows as columns; the reader splits one row's text in a small helper, a row of the matrix at a time.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaframe.functions import color
from lumaframe.functions.text import format_exact, format_number
from lumaframe.operators.select import weighted_float
from lumaframe.schema import CHANNELS, ENCODINGS, MATRIX_PIXELS, PREVIEW_COLUMNS, PREVIEW_ROWS, check_channels, check_encoding, check_size

#: The magic line; the reader takes any name in capitals before it.
MAGIC = "VALUE_MATRIX 1"
_MAGIC_START = re.compile(r"[A-Z0-9_]*VALUE_MATRIX 1")
#: A cell up to its comma: values in parentheses, or one value.
_CELL = re.compile(r"\s*(?:\(([^()]*)\)\s*|([^(),]*))(?:,|$)")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def is_matrix_text(text: str) -> bool:
    return bool(_MAGIC_START.match(text.removeprefix("﻿").lstrip()))


def number(text: str) -> float:
    """A number as JavaScript reads it; raises for anything else."""
    t = text.strip()
    if _NUMBER.fullmatch(t):
        return float(t)
    if t in ("NaN", "Infinity", "+Infinity", "-Infinity"):
        return float(t.replace("Infinity", "inf"))
    if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", t):
        return float(int(t, 0))
    raise ValueError(f"{text!r} is no number.")


def cells_of(row: str) -> list[list[float]]:
    """The cells of a row of text; empty cells don't count."""
    if "…" in row or "..." in row:
        raise ValueError("The text is shortened and lacks values.")
    cells, at = [], 0
    while at < len(row):
        m = _CELL.match(row, at)
        if not m:
            raise ValueError("A row opens or closes a parenthesis too many.")
        if m[1] is not None:
            cells.append([number(x) for x in m[1].split(",")])
        elif m[2].strip():
            cells.append([number(m[2])])
        at = m.end()
    return cells


def header_of(text: str) -> tuple[dict | None, list[str]]:
    """The metadata of a text, None without a magic line, and the rows of data."""
    lines = text.removeprefix("﻿").strip().splitlines()
    if not is_matrix_text(text):
        return None, [x for x in lines if x.strip()]
    if len(lines) < 3 or not _MAGIC_START.fullmatch(lines[0].strip()) or lines[2].strip() != "data:":
        raise ValueError("The text has to begin with the magic line, a line of JSON and `data:`.")
    try:
        meta = json.loads(lines[1])
    except ValueError as e:
        raise ValueError("The second line is no JSON.") from e
    return meta, [x for x in lines[3:] if x.strip()]


def read_rows(lines: DataFrame, width: int, channels: list[int] | None = None, encoding: str = "linear", alpha_weighted: bool = False) -> DataFrame:
    """The pixels of lines(image_id, y, line), rows of `width` cells as rows_of() writes them; channels None: one gray number a cell.

    Tasks read the lines, so a table of many texts is never gathered. A row that can't be read, or of another shape, raises.
    """
    n = 1 if channels is None else len(channels)

    def parse(batches):
        for pdf in batches:
            found = [cells_of(line) for line in pdf["line"]]
            if any(len(c) != width for c in found):
                raise ValueError("A row has another number of cells than the width says.")
            if any(len(c) != n for row in found for c in row):
                raise ValueError("A cell has another number of values than there are channels.")
            values = np.array(found, np.float64).reshape(len(found) * width, n)
            keys = pdf[["image_id", "y"]].loc[pdf.index.repeat(width)].reset_index(drop=True)
            yield keys.assign(x=np.tile(np.arange(width, dtype=np.int32), len(found)), **{f"c{k}": values[:, k] for k in range(n)})

    cells = lines.select("image_id", F.col("y").cast("int").alias("y"), "line").mapInPandas(parse, "image_id string, y int, x int, " + ", ".join(f"c{k} double" for k in range(n)))
    out: dict[str, Column] = {}
    for k, c in enumerate(CHANNELS):
        at = 0 if channels is None and k < 3 else channels.index(k) if channels and k in channels else None
        out[c] = F.lit(1.0 if c == "a" else 0.0) if at is None else color.decode(F.col(f"c{at}"), encoding, k == 3)
    pixels = cells.select("image_id", "y", "x", *[v.cast("float").alias(c) for c, v in out.items()])
    if alpha_weighted and channels and 3 in channels:
        pixels = pixels.withColumns({c: color.unpremultiply(c, "a").cast("float") for k, c in enumerate("rgb") if k in channels})
    return pixels


def _shape(lines: DataFrame) -> tuple[int, int] | None:
    """(cells of a row, numbers of a cell) if all lines agree on them and can be read."""

    def shapes(batches):
        for pdf in batches:
            out = []
            for line in pdf["line"]:
                try:
                    cells = cells_of(line)
                    out += [(len(cells), n) for n in {len(c) for c in cells}] or [(0, 0)]
                except ValueError:
                    out.append((-1, -1))
            yield pd.DataFrame(out, columns=["cells", "numbers"], dtype=np.int64)

    found = lines.select("line").mapInPandas(shapes, "cells long, numbers long").distinct().limit(2).collect()
    return tuple(found[0]) if len(found) == 1 and found[0]["cells"] > 0 and 1 <= found[0]["numbers"] <= 4 else None


def read_text(spark: SparkSession, text: str, views: dict[str, DataFrame] | None = None, image_id: str = "values") -> DataFrame | None:
    """The pixels of a Value Matrix text, at most MATRIX_PIXELS of them; views: frames that internal texts refer to by token.

    A text without a magic line is linear and its shape is inferred; None if it is malformed. Damaged rows behind a header raise when read.
    """
    meta, rows = header_of(text)
    lines = spark.createDataFrame([(image_id, y, line) for y, line in enumerate(rows)], "image_id string, y int, line string")
    if meta is None:
        shape = _shape(lines)
        if shape is None:
            return None
        check_size(shape[0], len(rows))
        return read_rows(lines, shape[0], None if shape[1] == 1 else list(range(shape[1])))
    internal = meta.get("storage") == "internal"
    check_size(meta.get("width"), meta.get("height"), None if internal else MATRIX_PIXELS)
    if internal:
        if not views or meta.get("token") not in views:
            raise ValueError(INTERNAL_GONE)
        return views[meta["token"]]
    if len(rows) != meta["height"]:
        raise ValueError(f"There are {len(rows)} rows of data where {meta['height']} are due.")
    return read_rows(lines, meta["width"], check_channels(meta.get("channels")), check_encoding(meta.get("encoding")), bool(meta.get("alphaWeighted")))


def _cell(mode: str, channels: list[int], encoding: str, number_text) -> Column:
    parts = []
    for k in channels:
        v = color.encode(weighted_float(mode, CHANNELS[k]), encoding, k == 3)
        parts.append(v.cast("string") if encoding == "srgb255" else number_text(v))
    return F.concat(F.lit("("), F.concat_ws(",", *parts), F.lit(")")) if len(parts) > 1 else parts[0]


def rows_of(pixels: DataFrame, channels=(0, 1, 2, 3), encoding: str = "linear", mode: str = "rgb", number_text=format_exact) -> DataFrame:
    """(image_id, y, line): a row's cells, each followed by a comma. Rows of an image are gathered one by one, never the whole image."""
    text = _cell(mode, check_channels(list(channels)), check_encoding(encoding), number_text)
    cells = pixels.select("image_id", "y", F.struct("x", text.alias("t")).alias("c")).groupBy("image_id", "y").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return cells.select("image_id", "y", F.concat(F.array_join("c.t", ","), F.lit(",")).alias("line"))


def preview(pixels: DataFrame, width: int, height: int, channels=(0, 1, 2, 3), encoding: str = "linear", mode: str = "rgb", rows: int = PREVIEW_ROWS, columns: int = PREVIEW_COLUMNS) -> DataFrame:
    """(image_id, y, line) of the first rows and columns, with a mark where more follow, and a last row that says so."""
    lines = rows_of(pixels.filter((F.col("y") < rows) & (F.col("x") < columns)), channels, encoding, mode, format_number)
    if width > columns:
        lines = lines.withColumn("line", F.concat("line", F.lit("…,")))
    if width > columns or height > rows:
        # Fixed value: the text of the last row.
        note = f"… Preview: first {min(columns, width)} x {min(rows, height)} of {width} x {height}. Copy Matrix copies all values."
        lines = lines.unionByName(lines.select("image_id").distinct().select("image_id", F.lit(min(rows, height)).alias("y"), F.lit(note).alias("line")))
    return lines


def write_text(pixels: DataFrame, width: int, height: int, channels=(0, 1, 2, 3), encoding: str = "linear", mode: str = "rgb", name: str = "copied values", type_: str = "clipboard-values/linear", magic: str = MAGIC) -> str:
    """The text of one image, at most MATRIX_PIXELS large."""
    check_size(width, height)
    found = check_channels(list(channels))
    meta = {"width": width, "height": height, "channels": ["RGBA"[k] for k in found], "encoding": check_encoding(encoding), "alphaWeighted": mode == "rgba", "name": (name or "copied values")[:240], "type": (type_ or "clipboard-values/linear")[:120]}
    rows = rows_of(pixels, channels, encoding, mode).orderBy("y").select("line").collect()
    if len(rows) != height:
        raise ValueError("Rows of the image are missing.")
    return "\n".join([magic, json.dumps(meta, separators=(",", ":"), ensure_ascii=False), "data:", *(r[0] for r in rows)])


def internal_text(token: str, width: int, height: int, name: str = "copied values", magic: str = MAGIC) -> str:
    """A text that refers to a registered frame."""
    check_size(width, height, None)
    meta = {"width": width, "height": height, "channels": list("RGBA"), "encoding": "linear", "alphaWeighted": False, "name": name[:240], "storage": "internal", "token": token}
    return "\n".join([magic, json.dumps(meta, separators=(",", ":"), ensure_ascii=False), "data:"])


def texts_of(pixels: DataFrame, channels=(0, 1, 2, 3), encoding: str = "linear", mode: str = "rgb", type_: str = "clipboard-values/linear", header: bool = True) -> DataFrame:
    """(image_id, content): the whole text of each image in UTF-8, for the image-files sink. An image is one text, of MATRIX_PIXELS at most; a larger one raises."""
    found, rows = check_channels(list(channels)), rows_of(pixels, channels, encoding, mode)
    meta = F.struct(
        F.col("width"), F.col("height"), F.array(*[F.lit("RGBA"[k]) for k in found]).alias("channels"), F.lit(check_encoding(encoding)).alias("encoding"), F.lit(mode == "rgba").alias("alphaWeighted"),
        F.substring(F.col("image_id"), 1, 240).alias("name"), F.lit(type_[:120]).alias("type"),
    )
    sizes = pixels.groupBy(F.col("image_id").alias("image")).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    large = F.raise_error(F.lit(f"A text may have {MATRIX_PIXELS} pixels at most.")).cast("int")
    sizes = sizes.withColumn("width", F.when(F.col("width").cast("long") * F.col("height") > MATRIX_PIXELS, large).otherwise(F.col("width")))
    # The size is joined before lines are gathered, so that an image that is too large is never gathered.
    sized = rows.join(sizes, F.col("image_id").eqNullSafe(F.col("image"))).drop("image")
    texts = sized.groupBy("image_id", "width", "height").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda r: r["line"]), "\n").alias("rows"))
    whole = F.concat_ws("\n", F.lit(MAGIC), F.to_json(meta), F.lit("data:"), "rows") if header else F.col("rows")
    return texts.select("image_id", F.encode(whole, "UTF-8").alias("content"))


def _numbered(spark: SparkSession, *paths: str) -> DataFrame:
    """(image_id, at, line): the lines of text files with something in them, numbered in each file.

    A file may be read by several tasks. Each numbers the lines of its split; how many stand in the splits before is a prefix sum over the splits.
    """
    read = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("image_id"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = read.filter(F.col("value").rlike(r"[^\s\uFEFF]"))

    def number_lines(batches):
        now, k = None, 0
        for pdf in batches:
            places = []
            for split in zip(pdf["image_id"], pdf["block"], strict=True):
                k = k + 1 if split == now else 0
                now = split
                places.append(k)
            yield pdf.assign(k=np.array(places, np.int64))

    counted = lines.groupBy("image_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("image_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("image_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = lines.mapInPandas(number_lines, "image_id string, block long, value string, k long")
    return inside.join(starts, ["image_id", "block"]).select("image_id", (F.col("start") + F.col("k")).alias("at"), F.col("value").alias("line"))


# Fixed value: what is said of a text that refers to values which aren't there.
INTERNAL_GONE = "The copied values are no longer at hand."
META = "image_id string, headed boolean, token string, width int, height int, channels array<int>, encoding string, alpha boolean, name string, type string, error string"


def _heads(numbered: DataFrame) -> DataFrame:
    """What the first lines of each file say; one row for each file."""
    first = numbered.filter("at < 3").groupBy("image_id").agg(*[F.max(F.when(F.col("at") == k, F.col("line"))).alias(f"l{k}") for k in range(3)])

    def parse(batches):
        for pdf in batches:
            out = []
            for image_id, *lines in zip(pdf["image_id"], pdf["l0"], pdf["l1"], pdf["l2"], strict=True):
                row = dict.fromkeys([c.split()[0] for c in META.split(", ")]) | {"image_id": image_id, "headed": is_matrix_text(lines[0])}
                try:
                    if row["headed"]:
                        meta, _ = header_of("\n".join(x for x in lines if x is not None))
                        if meta.get("storage") == "internal":
                            check_size(meta.get("width"), meta.get("height"), None)
                            row |= {"token": str(meta.get("token") or ""), "width": meta["width"], "height": meta["height"]}
                            raise ValueError(INTERNAL_GONE)
                        check_size(meta.get("width"), meta.get("height"))
                        row |= {"width": meta["width"], "height": meta["height"], "channels": check_channels(meta.get("channels")), "encoding": check_encoding(meta.get("encoding")), "alpha": bool(meta.get("alphaWeighted")), "name": str(meta.get("name") or "copied values"), "type": str(meta.get("type") or "clipboard-values/linear")}
                    else:
                        row |= {"encoding": "linear", "alpha": False, "name": "pasted value matrix", "type": "clipboard-values/linear"}
                except (ValueError, AttributeError, TypeError) as e:
                    row["error"] = str(e)
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in META.split(", ")])

    return first.mapInPandas(parse, META)


def _rows_of_files(numbered: DataFrame, heads: DataFrame) -> DataFrame:
    """(image_id, y, line) of the rows of data."""
    headed = heads.filter("error IS NULL").select("image_id", "headed")
    return numbered.join(headed, "image_id").filter("NOT headed OR at >= 3").select("image_id", (F.col("at") - F.when(F.col("headed"), 3).otherwise(0)).cast("int").alias("y"), "line")


def _shapes(rows: DataFrame) -> DataFrame:
    """(image_id, rows, fewest, most, few_numbers, many_numbers, wrong) of each file's rows, by partial aggregates."""

    def shape(batches):
        for pdf in batches:
            out = []
            for image_id, line in zip(pdf["image_id"], pdf["line"], strict=True):
                try:
                    cells = cells_of(line)
                    numbers = [len(c) for c in cells] or [0]
                    out.append((image_id, len(cells), min(numbers), max(numbers), None))
                except ValueError as e:
                    out.append((image_id, 0, 0, 0, str(e)))
            yield pd.DataFrame(out, columns=["image_id", "cells", "low", "high", "wrong"])

    found = rows.select("image_id", "line").mapInPandas(shape, "image_id string, cells int, low int, high int, wrong string")
    return found.groupBy("image_id").agg(F.count("*").alias("rows"), F.min("cells").alias("fewest"), F.max("cells").alias("most"), F.min("low").alias("few_numbers"), F.max("high").alias("many_numbers"), F.min("wrong").alias("wrong"))


def judged(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rows) of the lines (image_id, at, line) of any number of texts: META with sizes and errors filled, and the rows of data."""
    heads = _heads(numbered)
    rows = _rows_of_files(numbered, heads)
    shapes = _shapes(rows).withColumnRenamed("image_id", "image")
    both = heads.join(shapes, F.col("image_id") == F.col("image"), "left")
    n = F.coalesce(F.size("channels"), F.lit(0))
    too_large = F.col("most").cast("long") * F.col("rows") > MATRIX_PIXELS
    error = (
        F.when(F.isnotnull("error"), F.col("error"))
        .when(F.isnull("rows"), F.lit("There are no rows of data."))
        .when(F.isnotnull("wrong"), F.col("wrong"))
        .when(F.col("headed") & (F.col("rows") != F.col("height")), F.format_string("There are %d rows of data where %d are due.", "rows", "height"))
        .when((F.col("fewest") != F.col("most")) | F.col("headed") & (F.col("most") != F.col("width")), "A row has another number of cells than the width says.")
        .when((F.col("few_numbers") != F.col("many_numbers")) | F.col("headed") & (F.col("many_numbers") != n), "A cell has another number of values than there are channels.")
        .when(~F.col("headed") & ((F.col("many_numbers") < 1) | (F.col("many_numbers") > 4)), "A cell has one to four values.")
        .when(too_large, f"A text may have {MATRIX_PIXELS} pixels at most.")
    )
    inferred = F.when(F.col("many_numbers") > 1, F.sequence(F.lit(0), F.col("many_numbers") - 1))
    filled = {"width": F.coalesce("width", "most"), "height": F.coalesce("height", F.col("rows").cast("int")), "channels": F.when(F.col("headed"), F.col("channels")).otherwise(inferred)}
    records = both.withColumn("error", error).withColumns({c: F.when(F.isnull("error"), v) for c, v in filled.items()})  # sizes of texts that can't be read say nothing
    return records.select(*[c.split()[0] for c in META.split(", ")]), rows


def lines_of(texts: DataFrame) -> DataFrame:
    """(image_id, at, line): the lines with something in them of texts(image_id, text), numbered in each text."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda line: line.rlike(r"[^\s\uFEFF]"))
    return texts.select("image_id", F.posexplode(lines).alias("at", "line")).select("image_id", F.col("at").cast("long").alias("at"), "line")


def matrix_records(spark: SparkSession, *paths: str) -> DataFrame:
    """META of each text file with something in it: sizes and channels, from the header or from the shape of the rows, or why the file can't be read.

    channels is null where a cell is one gray number. Blank lines don't count.
    """
    return judged(_numbered(spark, *paths))[0]


def read_matrix_files(spark: SparkSession, *paths: str) -> DataFrame:
    """The pixels of all text files that can be read; matrix_records() says why others can't. Lines are numbered, shaped and read in tasks."""
    records, rows = judged(_numbered(spark, *paths))
    good = records.filter("error IS NULL").select("image_id", "channels", "encoding", "alpha")
    cells = rows.join(good, "image_id")

    def parse(batches):
        for pdf in batches:
            parts = []
            for line, channels in zip(pdf["line"], pdf["channels"], strict=True):
                values, own = np.array(cells_of(line), np.float64), [0, 0, 0] if channels is None else list(channels)
                part = np.zeros((len(values), 4))
                part[:, 3] = 1
                for k in range(4) if channels is not None else range(3):
                    if channels is None or k in own:
                        part[:, k] = values[:, 0 if channels is None else own.index(k)]
                parts.append(part)
            held = np.array([7 if c is None else sum(1 << k for k in c) for c in pdf["channels"]], np.int32)
            n = np.array([len(p) for p in parts])
            keys = pd.DataFrame({"image_id": pdf["image_id"], "y": pdf["y"].astype(np.int32), "encoding": pdf["encoding"], "held": held, "weighted": pdf["alpha"].astype(bool) & (held >= 8)})
            cells = np.concatenate([*parts, np.zeros((0, 4))])
            x = np.arange(len(cells), dtype=np.int32) - np.repeat(np.cumsum(n) - n, n).astype(np.int32)
            yield keys.loc[keys.index.repeat(n)].reset_index(drop=True).assign(x=x, **{c: cells[:, k] for k, c in enumerate(CHANNELS)})

    numbers = cells.mapInPandas(parse, "image_id string, y int, x int, r double, g double, b double, a double, encoding string, held int, weighted boolean")
    linear = {}
    for k, c in enumerate(CHANNELS):
        held = F.col("held").bitwiseAND(F.lit(1 << k)) > 0
        by = F.lit(None).cast("double")
        for encoding in ENCODINGS:
            by = F.when(F.col("encoding") == encoding, color.decode(c, encoding, k == 3)).otherwise(by)
        linear[c] = F.when(held, by).otherwise(F.col(c)).cast("float").alias(c)
    decoded = numbers.select("image_id", "y", "x", *linear.values(), "held", "weighted")
    out = {c: F.when(F.col("weighted") & (F.col("held").bitwiseAND(F.lit(1 << k)) > 0), color.unpremultiply(c, "a").cast("float")).otherwise(F.col(c)).alias(c) for k, c in enumerate("rgb")}
    return decoded.select("image_id", "y", "x", *out.values(), "a")
