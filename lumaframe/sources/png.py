"""PNG samples as float32 arrays, by zlib and numpy; and 8-bit RGBA back."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from lumaframe.schema import check_file_size

MAGIC = b"\x89PNG\r\n\x1a\n"
# Fixed values of the format.
#: Samples a pixel and legal depths of each colour type.
TYPES = {0: (1, (1, 2, 4, 8, 16)), 2: (3, (8, 16)), 3: (1, (1, 2, 4, 8)), 4: (2, (8, 16)), 6: (4, (8, 16))}
NAMES = {0: "gray", 2: "rgb", 3: "palette", 4: "gray-alpha", 6: "rgba"}
#: First column and row, and steps, of the interlaced passes.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def chunks(content: bytes):
    at = len(MAGIC)
    while at + 8 <= len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        if at + 12 + n > len(content):
            raise ValueError("PNG ends within a chunk.")
        yield kind, content[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IEND":
            return


#: Consecutive lines of the two filters that look left and up from which diagonals pay.
DIAGONAL = 16


def _mean_and_paeth(lines: np.ndarray, kinds: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Lines of filters 3 and 4 to bytes, a diagonal of pixels at a time: each needs only the two diagonals before."""
    h, size = lines.shape
    w = -(-size // step)
    data, out = np.zeros((h, w * step), np.int16), np.zeros((h + 1, w + 1, step), np.int16)
    data[:, :size] = lines
    data = data.reshape(h, w, step)
    out[0, 1:].reshape(-1)[:size] = above
    for t in range(h + w - 1):
        y = np.arange(max(0, t - w + 1), min(h, t + 1))
        x = t - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        out[y + 1, x + 1] = (data[y, x] + np.where(kinds[y, None] == 3, a + b >> 1, paeth)) & 255
    return out[1:, 1:].reshape(h, -1)[:, :size].astype(np.uint8)


def _rows(raw: bytes, height: int, size: int, step: int) -> np.ndarray:
    """Filtered lines to bytes; step: bytes of a pixel, one at least."""
    if len(raw) < height * (size + 1):
        raise ValueError("PNG image data is too short.")
    lines = np.frombuffer(raw, np.uint8, height * (size + 1)).reshape(height, size + 1)
    kinds, out, above, y = lines[:, 0], np.zeros((height, size), np.uint8), np.zeros(size, np.uint8), 0
    while y < height:
        kind, line, n = int(kinds[y]), lines[y, 1:].copy(), 1
        if kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            other = np.flatnonzero((kinds[y:] != 3) & (kinds[y:] != 4))
            n = int(other[0]) if len(other) else height - y
            if n >= DIAGONAL:
                out[y : y + n] = _mean_and_paeth(lines[y : y + n, 1:], kinds[y : y + n], above, step)
                above, y = out[y + n - 1], y + n
                continue
            cur, up, n = line.tolist(), above.tolist(), 1
            for k in range(size):
                a, b = (cur[k - step] if k >= step else 0), up[k]
                if kind == 3:
                    cur[k] = (cur[k] + (a + b >> 1)) & 255
                else:
                    c = up[k - step] if k >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    cur[k] = (cur[k] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            line = np.array(cur, np.uint8)
        elif kind:
            raise ValueError(f"Unknown PNG filter: {kind}")
        out[y] = above = line
        y += n
    return out


def _samples(raw: bytes, width: int, height: int, depth: int, per_pixel: int) -> tuple[np.ndarray, int]:
    """(height, width, per_pixel) whole numbers, and the bytes that were used."""
    size = (width * per_pixel * depth + 7) // 8
    rows = _rows(raw, height, size, max(1, per_pixel * depth // 8))
    if depth == 16:
        values = rows.view(">u2")
    elif depth == 8:
        values = rows
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        values = bits @ (1 << np.arange(depth)[::-1])
    return values[:, : width * per_pixel].reshape(height, width, per_pixel).astype(np.int64), height * (size + 1)


def decode(content: bytes) -> dict:
    """width, height, pixels (height, width, 4 in 0..1, not linearised), depth, color_type, interlaced, has_alpha, gamma, has_icc."""
    if content[:8] != MAGIC:
        raise ValueError("Not a PNG file.")
    found: dict[bytes, bytes] = {}
    data = []
    for kind, body in chunks(content):
        if kind == b"IDAT":
            data.append(body)
        else:
            found.setdefault(kind, body)
    if len(found.get(b"IHDR", b"")) != 13 or not data:
        raise ValueError("PNG has no header or no data.")
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", found[b"IHDR"])
    if kind not in TYPES or depth not in TYPES[kind][1] or not width or not height:
        raise ValueError(f"Illegal PNG header: type {kind}, depth {depth}, {width} x {height}.")
    if interlaced > 1:
        raise ValueError(f"Unknown PNG interlace method: {interlaced}")
    check_file_size(width, height)
    try:
        # Two bytes a sample, a filter byte a row of each pass, and no more, whatever the file unpacks to.
        raw = zlib.decompressobj().decompress(b"".join(data), 8 * width * height + 16 * (height + 8))
    except zlib.error as e:
        raise ValueError(f"PNG data is damaged: {e}") from e
    per_pixel = TYPES[kind][0]
    values = np.zeros((height, width, per_pixel), np.int64)
    for x0, y0, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w > 0 and h > 0:
            values[y0::dy, x0::dx], used = _samples(raw, w, h, depth, per_pixel)
            raw = raw[used:]
    top, trns, out = (1 << depth) - 1, found.get(b"tRNS"), np.ones((height, width, 4))
    if kind == 3:
        palette = np.frombuffer(found.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        if values.max() >= len(palette):
            raise ValueError("PNG palette index is out of range.")
        out[..., :3] = palette[values[..., 0]] / 255
        if trns is not None:
            alpha = np.full(max(len(palette), len(trns)), 255)
            alpha[: len(trns)] = np.frombuffer(trns, np.uint8)
            out[..., 3] = alpha[values[..., 0]] / 255
    else:
        colors = 1 if kind in (0, 4) else 3
        out[..., :3] = values[..., :colors] / top
        if kind in (4, 6):
            out[..., 3] = values[..., -1] / top
        elif trns is not None and len(trns) >= 2 * colors:
            out[..., 3] = (values != np.frombuffer(trns, ">u2", colors)).any(-1)
    gamma = struct.unpack(">I", found[b"gAMA"][:4])[0] / 100_000 if b"gAMA" in found else None
    return {"width": width, "height": height, "pixels": out.astype(np.float32), "depth": depth, "color_type": kind, "interlaced": bool(interlaced), "has_alpha": kind in (4, 6) or trns is not None, "gamma": gamma, "has_icc": b"iCCP" in found}


def type_label(decoded: dict) -> str:
    return f"png/{NAMES[decoded['color_type']]}{decoded['depth']}"


def transfer_text(decoded: dict) -> str:
    """What the file says of its transfer and is ignored, as functions.text.transfer_note says it."""
    if decoded["has_icc"]:
        return "(iCCP ignored)"
    gamma = decoded["gamma"]
    return f"(gAMA {gamma:.4f} ignored)" if gamma is not None and abs(gamma - 0.45455) > 0.02 else ""


def linear(pixels: np.ndarray) -> np.ndarray:
    """RGB out of sRGB; alpha stays."""
    v = pixels.astype(np.float64)
    v[..., :3] = np.where(v[..., :3] <= 0.04045, v[..., :3] / 12.92, ((v[..., :3] + 0.055) / 1.055) ** 2.4)
    return v.astype(np.float32)


def encode(rgba: np.ndarray) -> bytes:
    """An 8-bit RGBA file of a uint8 array (height, width, 4)."""
    h, w = rgba.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.zeros((h, 1 + 4 * w), np.uint8)
    raw[:, 1:] = rgba.reshape(h, -1)
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")
