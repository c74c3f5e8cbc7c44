"""Radiance RGBE and OpenEXR (scanlines and tiles; uncompressed, RLE, ZIPS, ZIP, PIZ, PXR24, B44, B44A), as float32 arrays (height, width, 4)."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from lumaframe.schema import check_file_size
from lumaframe.sources import exr_codecs

EXR_MAGIC = 20000630
# Numbers of the compressions, and the scanlines of a block of each.
NONE, RLE, ZIPS, ZIP, PIZ, PXR24, B44, B44A = range(8)
BLOCK_LINES = {NONE: 1, RLE: 1, ZIPS: 1, ZIP: 16, PIZ: 32, PXR24: 16, B44: 32, B44A: 32}
# Bits of the version that stand for tiles, and for deep data and several parts.
TILED, OTHERS = 0x200, 0x1800


def rgbe_size(head: bytes) -> tuple[int, int, int]:
    """(width, height, bytes of the header) of a file that begins so."""
    if not head.startswith((b"#?RADIANCE", b"#?RGBE")):
        raise ValueError("Not a Radiance file.")
    found = re.search(rb"\n\n-Y (\d+) \+X (\d+)\n", head)
    if not found:
        raise ValueError("Radiance file has no size, or an orientation that isn't supported.")
    return int(found[2]), int(found[1]), found.end()


def rgbe_values(rgbe: np.ndarray) -> np.ndarray:
    """float32 (..., 4) of uint8 (..., 4): three mantissas and an exponent."""
    exponent = rgbe[..., 3].astype(np.int64)
    pixels = np.ones(rgbe.shape, np.float32)
    pixels[..., :3] = np.where(exponent[..., None] > 0, np.ldexp(rgbe[..., :3].astype(np.float64), exponent[..., None] - 136), 0)
    return pixels


def _coded(line: bytes, width: int) -> bool:
    """Whether a scanline that begins so is run-length coded."""
    return 8 <= width < 32768 and len(line) >= 4 and line[0] == line[1] == 2 and line[2] << 8 | line[3] == width


def decode_rgbe(content: bytes) -> np.ndarray:
    """Flat or run-length coded scanlines, top to bottom."""
    width, height, at = rgbe_size(content)
    check_file_size(width, height)
    out = np.zeros((height, width, 4), np.uint8)
    for y in range(height):
        if not _coded(content[at : at + 4], width):
            flat = np.frombuffer(content, np.uint8, 4 * width, at) if len(content) >= at + 4 * width else None
            if flat is None:
                raise ValueError("Radiance data is too short.")
            out[y], at = flat.reshape(width, 4), at + 4 * width
            continue
        at += 4
        for c in range(4):
            x = 0
            while x < width:
                if at + 1 >= len(content):
                    raise ValueError("Radiance data is too short.")
                n = content[at]
                if n > 128:
                    out[y, x : x + n - 128, c], at, x = content[at + 1], at + 2, x + n - 128
                else:
                    out[y, x : x + n, c], at, x = np.frombuffer(content, np.uint8, n, at + 1), at + 1 + n, x + max(n, 1)
    return rgbe_values(out)


def encode_rgbe(rgbe: np.ndarray) -> bytes:
    """A file of flat scanlines of a uint8 array (height, width, 4)."""
    h, w = rgbe.shape[:2]
    return f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {h} +X {w}\n".encode() + rgbe.astype(np.uint8).tobytes()


def _exr_header(content: bytes) -> tuple[dict[str, bytes], int]:
    if len(content) < 8 or struct.unpack("<I", content[:4])[0] != EXR_MAGIC:
        raise ValueError("Not an OpenEXR file.")
    if struct.unpack("<I", content[4:8])[0] & OTHERS:
        raise ValueError("Deep and multi-part OpenEXR files are not supported.")
    at, out = 8, {}
    while content[at] != 0:
        end = content.index(b"\0", at)
        name, at = content[at:end].decode(), end + 1
        at = content.index(b"\0", at) + 1
        n = struct.unpack("<I", content[at : at + 4])[0]
        out[name], at = content[at + 4 : at + 4 + n], at + 4 + n
    return out, at + 1


def _run_lengths(data: bytes) -> bytes:
    """Runs: a count n and a byte for n + 1 of it, or -n and n bytes."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2] * (n + 1))
            at += 2
        else:
            out.append(data[at + 1 : at + 257 - n])
            at += 257 - n
    return b"".join(out)


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    """A block's bytes. Packed ones hold differences from byte to byte, of all bytes at even places and then those at odd ones."""
    if compression == NONE or len(data) == size:
        return data
    steps = np.frombuffer(_run_lengths(data) if compression == RLE else zlib.decompressobj().decompress(data, size), np.uint8).astype(np.int64)
    if len(steps) != size:
        raise ValueError("OpenEXR block is damaged.")
    steps[1:] -= 128
    values, out = (np.cumsum(steps) & 255).astype(np.uint8), np.zeros(size, np.uint8)
    out[0::2], out[1::2] = values[: (size + 1) // 2], values[(size + 1) // 2 :]
    return out.tobytes()


def _packed(data: bytes) -> bytes:
    """The other way round, by ZIP; data itself if it doesn't get smaller."""
    v = np.frombuffer(data, np.uint8)
    values = np.concatenate((v[0::2], v[1::2])).astype(np.int64)
    steps = values.copy()
    steps[1:] = values[1:] - values[:-1] + 128
    packed = zlib.compress((steps & 255).astype(np.uint8).tobytes())
    return packed if len(packed) < len(data) else data


@dataclass(frozen=True)
class ExrLayout:
    """What the header of a scanline file says, and where its blocks begin."""

    width: int
    height: int
    y0: int
    compression: int
    #: Names and numpy types of the channels, in the order of the file, and whether B44 takes their logarithm.
    channels: tuple[tuple[str, str], ...]
    logarithmic: tuple[bool, ...]
    #: Width and height of a tile, None for scanlines.
    tile: tuple[int, int] | None
    #: Where the blocks of the full size begin, row by row.
    offsets: tuple[int, ...]
    #: Bytes of header and offsets.
    size: int

    @property
    def lines(self) -> int:
        """Lines of a block."""
        return self.tile[1] if self.tile else BLOCK_LINES[self.compression]

    @property
    def across(self) -> int:
        """Blocks beside each other."""
        return -(-self.width // self.tile[0]) if self.tile else 1

    @property
    def head(self) -> int:
        """Bytes before a block's data."""
        return 20 if self.tile else 8


def exr_layout(head: bytes, limited: bool = False) -> ExrLayout:
    """The layout of a file that begins with these bytes; IndexError or struct.error where they end too early. With `limited` a file of too many pixels raises."""
    header, at = _exr_header(head)
    compression = header["compression"][0]
    if compression not in BLOCK_LINES:
        raise ValueError(f"OpenEXR compression {compression} is not supported.")
    x0, y0, x1, y1 = struct.unpack("<4i", header["dataWindow"])
    width, height = x1 - x0 + 1, y1 - y0 + 1
    if width < 1 or height < 1:
        raise ValueError("OpenEXR file has no pixels.")
    if limited:
        check_file_size(width, height)
    channels, logarithmic, k, raw = [], [], 0, header["channels"]
    while raw[k] != 0:
        end = raw.index(b"\0", k)
        kind, steps = struct.unpack("<i", raw[end + 1 : end + 5])[0], struct.unpack("<2i", raw[end + 9 : end + 17])
        logarithmic.append(bool(raw[end + 5]))
        if steps != (1, 1):
            raise ValueError("OpenEXR channels of fewer samples are not supported.")
        channels.append((raw[k:end].decode(), ("<u4", "<f2", "<f4")[kind]))
        k = end + 17
    tile, lines, across, all_blocks = None, BLOCK_LINES[compression], 1, 0
    if struct.unpack("<I", head[4:8])[0] & TILED:
        tw, th, mode = struct.unpack("<2IB", header["tiles"][:9])
        if not tw or not th:
            raise ValueError("OpenEXR tiles have no size.")
        tile, lines, across = (tw, th), th, -(-width // tw)
        all_blocks = _tiles_of_levels(width, height, tw, th, mode)
    n = -(-height // lines) * across
    offsets = struct.unpack_from(f"<{n}Q", head, at)
    return ExrLayout(width, height, y0, compression, tuple(channels), tuple(logarithmic), tile, offsets, at + 8 * max(n, all_blocks))


def _tiles_of_levels(width: int, height: int, tw: int, th: int, mode: int) -> int:
    """Tiles of all sizes that a file holds: one, halved together, or width and height halved apart; by the low bits of mode, rounded as the high ones say."""
    kind, up = mode & 15, mode >> 4

    def halved(n: int, times: int) -> int:
        return max(1, -(-n >> times) if up else n >> times)

    def levels(n: int) -> int:
        return 1 + ((n - 1).bit_length() if up else n.bit_length() - 1)

    count = lambda w, h: -(-w // tw) * -(-h // th)
    if kind == 0:
        return count(width, height)
    if kind == 1:
        return sum(count(halved(width, k), halved(height, k)) for k in range(levels(max(width, height))))
    return sum(count(halved(width, i), halved(height, j)) for i in range(levels(width)) for j in range(levels(height)))


def exr_block(layout: ExrLayout, content: bytes, at: int) -> tuple[int, int, np.ndarray, int]:
    """(first line and first column counted from 0, its pixels (lines, width, 4), bytes read) of the block at a place of content."""
    if layout.tile:
        column, row, level_x, level_y, size = struct.unpack_from("<4iI", content, at)
        x, y = column * layout.tile[0], row * layout.tile[1]
        if level_x or level_y:
            raise ValueError("OpenEXR data is damaged.")
    else:
        y, size = struct.unpack_from("<iI", content, at)
        x, y = 0, y - layout.y0
    start = at + layout.head
    if not (0 <= y < layout.height and 0 <= x < layout.width) or start + size > len(content):
        raise ValueError("OpenEXR data is damaged.")
    lines, width = min(layout.lines, layout.height - y), min(layout.tile[0], layout.width - x) if layout.tile else layout.width
    line_bytes = width * sum(int(kind[-1]) for _, kind in layout.channels)
    block = _block_bytes(layout, content[start : start + size], width, lines, line_bytes * lines)
    if len(block) < line_bytes * lines:
        raise ValueError("OpenEXR block is damaged.")
    rows = np.frombuffer(block, np.uint8, line_bytes * lines).reshape(lines, line_bytes)
    pixels, place = np.zeros((lines, width, 4), np.float32), 0
    pixels[..., 3] = 1
    for name, kind in layout.channels:
        n = width * int(kind[-1])
        values = np.ascontiguousarray(rows[:, place : place + n]).view(kind).astype(np.float32)
        place += n
        if name == "Y":
            pixels[..., :3] = values[..., None]
        elif name in ("R", "G", "B", "A"):
            pixels[..., "RGBA".index(name)] = values
    return y, x, pixels, layout.head + size


def _block_bytes(layout: ExrLayout, data: bytes, width: int, lines: int, size: int) -> bytes:
    if layout.compression <= ZIP:
        return _unpacked(data, layout.compression, size)
    # A block that packing would not make smaller is stored as it is.
    if len(data) >= size:
        return data
    try:
        if layout.compression == PIZ:
            return exr_codecs.unpack_piz(data, layout.channels, width, lines)
        if layout.compression == PXR24:
            return exr_codecs.unpack_pxr24(data, layout.channels, width, lines)
        return exr_codecs.unpack_b44(data, layout.channels, width, lines, layout.logarithmic)
    except (struct.error, IndexError, zlib.error) as e:
        raise ValueError("OpenEXR block is damaged.") from e


def decode_exr(content: bytes) -> np.ndarray:
    """Half, float and uint channels R, G, B, A or Y of a file of scanlines or tiles, at full size; other names are ignored."""
    layout = exr_layout(content, limited=True)
    pixels, at = np.zeros((layout.height, layout.width, 4), np.float32), layout.size
    for k in range(len(layout.offsets)):
        # Blocks of scanlines follow each other, whatever the table says; tiles of other sizes may stand between tiles.
        y, x, part, read = exr_block(layout, content, layout.offsets[k] if layout.tile else at)
        pixels[y : y + part.shape[0], x : x + part.shape[1]] = part
        at += read
    return pixels


def exr_head(width: int, height: int, sizes: Sequence[int], compression: int = NONE, half: bool = False, tile: tuple[int, int] | None = None) -> bytes:
    """What stands before the blocks of a file: the header, and where blocks of these many bytes begin."""
    window = struct.pack("<4i", 0, 0, width - 1, height - 1)
    channels = b"".join(c + b"\0" + struct.pack("<i4B2i", 1 if half else 2, 0, 0, 0, 0, 1, 1) for c in (b"A", b"B", b"G", b"R")) + b"\0"
    # The attributes that the format asks for.
    attributes = [("channels", "chlist", channels), ("compression", "compression", bytes([compression])), ("dataWindow", "box2i", window), ("displayWindow", "box2i", window), ("lineOrder", "lineOrder", b"\0"), ("pixelAspectRatio", "float", struct.pack("<f", 1)), ("screenWindowCenter", "v2f", struct.pack("<2f", 0, 0)), ("screenWindowWidth", "float", struct.pack("<f", 1))]
    if tile:
        attributes.append(("tiles", "tiledesc", struct.pack("<2IB", *tile, 0)))
    head = struct.pack("<II", EXR_MAGIC, 2 | (TILED if tile else 0)) + b"".join(n.encode() + b"\0" + t.encode() + b"\0" + struct.pack("<I", len(v)) + v for n, t, v in attributes) + b"\0"
    ends = np.cumsum(np.asarray(sizes, np.int64))
    return head + (len(head) + 8 * len(ends) + np.concatenate(([0], ends[:-1]))).astype("<u8").tobytes()


def exr_blocks(pixels: np.ndarray, compression: int = NONE, half: bool = False, tile: tuple[int, int] | None = None, top: int = 0) -> list[bytes]:
    """The blocks of lines that follow each other from line `top` on, with which a block begins; values that aren't finite are written as 0."""
    h, w = pixels.shape[:2]
    kind = "<f2" if half else "<f4"
    values = np.where(np.isfinite(pixels), pixels, 0).astype(kind)[..., ::-1]
    lines, across = (tile[1], tile[0]) if tile else (BLOCK_LINES[compression], w)
    names = tuple((c, kind) for c in "ABGR")
    packers = {PIZ: exr_codecs.pack_piz, PXR24: exr_codecs.pack_pxr24, B44: exr_codecs.pack_b44, B44A: lambda *a: exr_codecs.pack_b44(*a, flat=True)}
    blocks = []
    for y in range(0, h, lines):
        for x in range(0, w, across):
            part = values[y : y + lines, x : x + across]
            raw = part.transpose(0, 2, 1).tobytes()
            if compression in packers:
                packed = packers[compression](raw, names, part.shape[1], part.shape[0])
                packed = packed if len(packed) < len(raw) else raw
            else:
                packed = raw if compression == NONE else _packed(raw)
            place = struct.pack("<4i", x // across, (top + y) // lines, 0, 0) if tile else struct.pack("<i", top + y)
            blocks.append(place + struct.pack("<I", len(packed)) + packed)
    return blocks


def encode_exr(pixels: np.ndarray, compression: int = NONE, half: bool = False, tile: tuple[int, int] | None = None) -> bytes:
    """Four float (or half) channels in scanlines or tiles, uncompressed or by ZIPS, ZIP, PIZ, PXR24, B44 or B44A; values that aren't finite are written as 0."""
    blocks = exr_blocks(pixels, compression, half, tile)
    return exr_head(pixels.shape[1], pixels.shape[0], [len(b) for b in blocks], compression, half, tile) + b"".join(blocks)
