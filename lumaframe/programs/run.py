"""Programs over images of any number.

A program that reads each pixel alone becomes columns, or numpy over batches of rows where it is long. One that reads places a fixed number
of pixels away gets the image in tiles with borders as wide as it reaches: a pixel is sent to the tiles that need it, in one shuffle. One that computes
its places first says, tile by tile and without any pixel, which blocks of the image it will read; blocks and requests meet by key and
each block goes once to each tile that asked for it. Places that depend on what was read are asked in rounds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.operators.generate import canvas
from lumaframe.programs.evaluate import as_arrays, as_columns
from lumaframe.programs.lower import Program, compile_program
from lumaframe.schema import CHANNELS, PIXELS, PROGRAM_PIXELS

#: Pixels of a tile's side, and of the blocks in which far places are read.
TILE, BLOCK = 128, 32
#: Nodes of a program that still becomes columns.
COLUMN_NODES = 400
SIZES = ("width", "height", "in_width", "in_height")
KEY = ("image_id", "ty", "tx")


def _check(width: int, height: int) -> None:
    if width < 1 or height < 1 or width * height > PROGRAM_PIXELS:
        raise ValueError(f"A program may have 1 to {PROGRAM_PIXELS} pixels.")


def _sizes(pixels: DataFrame, size: tuple[int, int] | None) -> DataFrame:
    """(image_id, width, height, in_width, in_height) of each image; width and height are those of the result. An image that is too large raises when it is read."""
    found = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("in_width"), (F.max("y") + 1).alias("in_height"))
    large = F.raise_error(F.lit(f"A program may have {PROGRAM_PIXELS} pixels at most.")).cast("int")
    found = found.withColumn("in_width", F.when(F.col("in_width").cast("long") * F.col("in_height") > PROGRAM_PIXELS, large).otherwise(F.col("in_width")))
    width, height = map(F.lit, size) if size else (F.col("in_width"), F.col("in_height"))
    return found.select("image_id", width.cast("int").alias("width"), height.cast("int").alias("height"), "in_width", "in_height")


def _sized(pixels: DataFrame) -> DataFrame:
    sizes = _sizes(pixels, None).withColumnRenamed("image_id", "image")
    return pixels.select(*PIXELS.names).join(sizes, F.col("image_id").eqNullSafe(F.col("image"))).drop("image")


def _places(x: np.ndarray, y: np.ndarray, width, height) -> dict[str, np.ndarray]:
    return {"x": x, "y": y, "u": (x + 0.5) / width, "v": (y + 0.5) / height, "width": width, "height": height}


def _result(image_id, y: np.ndarray, x: np.ndarray, channels: list[np.ndarray]) -> pa.Table:
    ids = pa.array([image_id], pa.string()).take(pa.array(np.zeros(len(y), np.int64)))
    return pa.table([ids, pa.array(y, pa.int32()), pa.array(x, pa.int32()), *(pa.array(c.astype(np.float32)) for c in channels)], PIXELS.names)


def _alone(program: Program, frame: DataFrame) -> DataFrame:
    """A program without taps over rows that have its inputs."""
    graph, inputs = program.graph, sorted(program.inputs() - {"x", "y"})
    if sum(graph.nodes[n].op not in ("const", "input") for n in graph.below(program.out)) <= COLUMN_NODES:
        made = as_columns(frame, graph, dict(zip(CHANNELS, program.out, strict=True)))
        return made.select("image_id", "y", "x", *[F.col(c).cast("float").alias(c) for c in CHANNELS])

    def run(batches):
        for b in batches:
            given = {c: b.column(c).to_numpy(zero_copy_only=False).astype(np.int64 if c in "xy" else np.float64) for c in ("x", "y", *inputs)}
            channels = as_arrays(graph, program.out, given, None, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c.astype(np.float32)) for c in channels)], PIXELS.names)

    return frame.select("image_id", "y", "x", *inputs).mapInArrow(run, PIXELS)


def _near(program: Program, pixels: DataFrame) -> DataFrame:
    """Taps at fixed distances: tiles with borders, in one shuffle."""
    graph = program.graph
    offsets = {tuple(graph.nodes[n].args[:2]): graph.offset(*graph.nodes[n].args[:2]) for n in program.taps()}
    reach = [max(math.ceil(abs(o[k])) for o in offsets.values()) for k in (0, 1)]
    # The image's size is needed only if something else than the places of taps asks for it.
    needed = program.inputs(lambda n: graph.nodes[n].op != "tap")
    sized = bool(needed & {"u", "v", *SIZES})
    rows = _sized(pixels) if sized else pixels.select(*PIXELS.names)
    tile = lambda c, k: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - k) / TILE).cast("int")), F.floor((F.col(c) + k) / TILE).cast("int"))
    dealt = rows.withColumn("ty", F.explode(tile("y", reach[1]))).withColumn("tx", F.explode(tile("x", reach[0])))

    def run(key, table):
        image_id, ty, tx = (k.as_py() for k in key)
        column = lambda c: table.column(c).to_numpy()
        y, x = column("y").astype(np.int64), column("x").astype(np.int64)
        own = (y // TILE == ty) & (x // TILE == tx)
        if not own.any():
            return _result(image_id, y[:0], x[:0], [np.zeros(0)] * 4)
        top, left, bottom, right = y.min(), x.min(), y.max(), x.max()
        patch = np.zeros((bottom - top + 1, right - left + 1, 4))
        patch[y - top, x - left] = np.stack([column(c) for c in CHANNELS], axis=1)
        y, x = y[own], x[own]

        def texels(dx: int, dy: int, c: int) -> np.ndarray:
            return patch[np.clip(y + dy, top, bottom) - top, np.clip(x + dx, left, right) - left, c]

        def tap(u, v, c, _):
            dx, dy = offsets[u, v]
            fx, fy = math.floor(dx), math.floor(dy)
            out = 0.0
            for ky, wy in ((0, 1 - (dy - fy)), (1, dy - fy)):
                for kx, wx in ((0, 1 - (dx - fx)), (1, dx - fx)):
                    if wx * wy:
                        out = out + wx * wy * texels(fx + kx, fy + ky, c)
            return out

        given = {c: texels(0, 0, k) for k, c in enumerate(CHANNELS)} | {"x": x, "y": y}
        if sized:
            width, height = (float(column(c)[0]) for c in ("width", "height"))
            given |= _places(x, y, width, height) | {"in_width": width, "in_height": height}
        return _result(image_id, y, x, as_arrays(graph, program.out, given, tap, len(y), stops=True))

    kept = [*KEY, "y", "x", *CHANNELS, *(SIZES if sized else ())]
    return dealt.select(*kept).groupBy(*KEY).applyInArrow(run, PIXELS)


class _Blocks:
    """The blocks of an image that a tile asked for."""

    def __init__(self, rows: list[tuple[int, int, bytes]], width: int, height: int):
        self.width, self.height = width, height
        self.slot = np.zeros((-(-height // BLOCK), -(-width // BLOCK)), np.int64)
        self.cells = np.zeros((len(rows) or 1, BLOCK, BLOCK, 4), np.float32)
        for k, (by, bx, cells) in enumerate(rows):
            h, w = min(BLOCK, height - by * BLOCK), min(BLOCK, width - bx * BLOCK)
            self.slot[by, bx] = k
            self.cells[k, :h, :w] = np.frombuffer(cells, np.float32).reshape(h, w, 4)

    def corners(self, u: np.ndarray, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(y, x, weight) of the four pixels around each place; a place that is no number is the first corner."""
        at = [np.clip(np.nan_to_num(np.asarray(p, np.float64), nan=0.0), -1.0, 2.0) * n - 0.5 for p, n in ((u, self.width), (v, self.height))]
        low = [np.floor(a) for a in at]
        out = []
        for ky in (0, 1):
            for kx in (0, 1):
                x, y = (np.clip(f.astype(np.int64) + k, 0, n - 1) for f, k, n in zip(low, (kx, ky), (self.width, self.height), strict=True))
                tx, ty = (a - f for a, f in zip(at, low, strict=True))
                out.append((y, x, (tx if kx else 1 - tx) * (ty if ky else 1 - ty)))
        return out

    def texels(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.cells[self.slot[y // BLOCK, x // BLOCK], y % BLOCK, x % BLOCK].astype(np.float64)


class _Tile:
    """A tile of the result: its pixels, and its program over the blocks that are there."""

    def __init__(self, program: Program, ty: int, tx: int, sizes: tuple[int, int, int, int], rows: list[tuple[int, int, bytes]]):
        self.program, (width, height, in_width, in_height) = program, sizes
        y, x = np.meshgrid(np.arange(ty * TILE, min(height, (ty + 1) * TILE)), np.arange(tx * TILE, min(width, (tx + 1) * TILE)), indexing="ij")
        self.y, self.x = y.ravel(), x.ravel()
        self.blocks = _Blocks(rows, in_width, in_height)
        self.given = _places(self.x, self.y, float(width), float(height)) | {"in_width": float(in_width), "in_height": float(in_height)}
        self.found: dict[tuple[int, int], np.ndarray] = {}
        if program.same_size:
            own = self.blocks.texels(self.y, self.x)
            self.given |= {c: own[:, k] for k, c in enumerate(CHANNELS)}

    def _tap(self, u: int, v: int, c: int, value) -> np.ndarray:
        if (u, v) not in self.found:
            pu, pv = (np.broadcast_to(value(k), self.y.shape) for k in (u, v))
            self.found[u, v] = sum(w[:, None] * self.blocks.texels(y, x) for y, x, w in self.blocks.corners(pu, pv))
        return self.found[u, v][:, c]

    def values(self, nodes: list[int]) -> list[np.ndarray]:
        return as_arrays(self.program.graph, nodes, self.given, self._tap, len(self.y))

    def asked(self, places: list[tuple[int, int]], own: bool) -> set[tuple[int, int]]:
        """The blocks that these places, and with `own` the pixels themselves, lie in."""
        nodes = [n for p in places for n in p]
        values = self.values(nodes) if nodes else []
        spots = [(y, x) for k in range(len(places)) for y, x, _ in self.blocks.corners(values[2 * k], values[2 * k + 1])]
        spots += [(self.y, self.x)] if own else []
        across = self.blocks.slot.shape[1]
        codes = np.unique(np.concatenate([y // BLOCK * across + x // BLOCK for y, x in spots])) if spots else []
        return {divmod(int(c), across) for c in codes}


def _rounds(program: Program) -> list[list[tuple[int, int]]]:
    """The places of taps, by how many rounds of reading they depend on."""
    graph, depth = program.graph, {}
    for n in graph.below(program.out):
        depth[n] = max((depth[a] + (graph.nodes[a].op == "tap") for a in graph.arguments(n)), default=0)
    rounds: dict[int, list] = {}
    for n in program.taps():
        rounds.setdefault(depth[n], []).append(tuple(graph.nodes[n].args[:2]))
    return [rounds[k] for k in sorted(rounds)]


def _far(program: Program, pixels: DataFrame, size: tuple[int, int] | None) -> DataFrame:
    """Taps at computed places: tiles ask for blocks, round by round."""
    rounds, names = _rounds(program), pixels.select(*PIXELS.names)
    requests = "image_id string, ty int, tx int, by int, bx int, width int, height int, in_width int, in_height int"
    grid = lambda n: F.sequence(F.lit(0), F.floor((F.col(n) - 1) / TILE).cast("int"))
    tiles = _sizes(names, size).withColumn("ty", F.explode(grid("height"))).withColumn("tx", F.explode(grid("width"))).repartition("image_id", "ty", "tx")

    def rows(image_id, ty, tx, sizes, blocks):
        at = pa.array(np.zeros(len(blocks), np.int64))
        one = lambda v, t: pa.array([v], t).take(at)
        return pa.RecordBatch.from_arrays(
            [one(image_id, pa.string()), one(ty, pa.int32()), one(tx, pa.int32()), *(pa.array([b[k] for b in blocks], pa.int32()) for k in (0, 1)), *(one(s, pa.int32()) for s in sizes)],
            ["image_id", "ty", "tx", "by", "bx", *SIZES],
        )

    own = program.same_size

    def first(batches):
        for b in batches:
            for t in b.to_pylist():
                sizes = tuple(t[s] for s in SIZES)
                tile = _Tile(program, t["ty"], t["tx"], sizes, [])
                yield rows(t["image_id"], t["ty"], t["tx"], sizes, sorted(tile.asked(rounds[0], own)))

    def pack(key, block, asked):
        """One block, as often as tiles asked for it."""
        if not block.num_rows or not asked.num_rows:
            return asked.slice(0, 0).append_column("cells", pa.array([], pa.binary()))
        y, x = (block.column(c).to_numpy().astype(np.int64) % BLOCK for c in ("y", "x"))
        cells = np.zeros((y.max() + 1, x.max() + 1, 4), np.float32)
        cells[y, x] = np.stack([block.column(c).to_numpy() for c in CHANNELS], axis=1)
        return asked.append_column("cells", pa.array([cells.tobytes()], pa.binary()).take(pa.array(np.zeros(asked.num_rows, np.int64))))

    def tile_of(key, table):
        sizes = tuple(int(table.column(s)[0].as_py()) for s in SIZES)
        blocks = list(zip(*(table.column(c).to_pylist() for c in ("by", "bx", "cells")), strict=True))
        return _Tile(program, key[1].as_py(), key[2].as_py(), sizes, blocks), sizes, {b[:2] for b in blocks}

    block_keys = [F.col("image_id"), F.floor(F.col("y") / BLOCK).cast("int").alias("by"), F.floor(F.col("x") / BLOCK).cast("int").alias("bx")]
    source = names.select(*block_keys, "y", "x", *CHANNELS)

    def gathered(asked: DataFrame):
        met = source.groupBy("image_id", "by", "bx").cogroup(asked.groupBy("image_id", "by", "bx")).applyInArrow(pack, requests + ", cells binary")
        return met.groupBy(*KEY)

    def more(places):
        def run(key, table):
            tile, sizes, there = tile_of(key, table)
            return pa.Table.from_batches([rows(*(v.as_py() for v in key), sizes, sorted(there | tile.asked(places, False)))])

        return run

    asked = tiles.select(*KEY, *SIZES).mapInArrow(first, requests)
    for places in rounds[1:]:
        asked = gathered(asked).applyInArrow(more(places), requests)

    def finish(key, table):
        tile, _, _ = tile_of(key, table)
        return _result(key[0].as_py(), tile.y, tile.x, tile.values(program.out))

    return gathered(asked).applyInArrow(finish, PIXELS)


def shade(pixels: DataFrame, code: str | Program, size: tuple[int, int] | None = None) -> DataFrame:
    """The images of pixels(image_id, y, x, r, g, b, a) through a program's text; a result of another (width, height) with `size`.

    Images are dense and have PROGRAM_PIXELS pixels at most; values are computed in double and kept as float. A null image_id is an image too. No images give
    no rows; other columns are ignored. A text that can't be used raises ShaderError here, before any job.
    """
    if size:
        _check(*size)
    program = code if isinstance(code, Program) else compile_program(code, same_size=size is None)
    taps = program.taps()
    if taps and program.same_size and all(program.graph.offset(*program.graph.nodes[n].args[:2]) for n in taps):
        return _near(program, pixels)
    if taps:
        return _far(program, pixels, size)
    needed = program.inputs()
    if size:
        rows = _sizes(pixels, size).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(size[1] - 1)))).repartition("image_id", "y").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size[0] - 1))))
    else:
        rows = _sized(pixels) if needed & {"u", "v", *SIZES} else pixels.select(*PIXELS.names)
    for n, place, side in (("u", "x", "width"), ("v", "y", "height")):
        if n in needed:
            rows = rows.withColumn(n, (F.col(place) + 0.5) / F.col(side))
    return _alone(program, rows)


def generated(spark: SparkSession, code: str, width: int, height: int, image_id: str = "generated") -> DataFrame:
    """An image of a program alone: what it reads is one black, opaque pixel."""
    _check(width, height)
    program = compile_program(code, same_size=False)
    if program.taps():
        black = spark.range(1).select(F.lit(image_id).alias("image_id"), *[F.lit(v).cast(t).alias(c) for c, v, t in (("y", 0, "int"), ("x", 0, "int"), *((c, float(c == "a"), "float") for c in CHANNELS))])
        return _far(program, black, (width, height))
    sized = canvas(spark, width, height, image_id).withColumns({n: F.lit(v) for n, v in zip(SIZES, (width, height, 1, 1), strict=True)})
    return _alone(program, sized)
