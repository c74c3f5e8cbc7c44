"""Baseline JPEG files of 8-bit RGB images: full-size chroma, Huffman tables made for each file."""

from __future__ import annotations

import struct

import numpy as np

from lumaframe.sources.exr_codecs import _lengths_of

# The format's example tables of quantisation for brightness and colour, line by line.
BRIGHTNESS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
#: Cells of a block along its diagonals, the direction changing from one to the next.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
#: The cosine transform of eight values.
COSINES = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Brightness and two colour differences of RGB.
YCC = np.array([[0.299, 0.587, 0.114], [-0.299 / 1.772, -0.587 / 1.772, 0.886 / 1.772], [0.701 / 1.402, -0.587 / 1.402, -0.114 / 1.402]])


def tables(quality: float) -> tuple[np.ndarray, np.ndarray]:
    """The quantisation of a quality of 0.01 to 1, as commonly scaled."""
    q = min(100, max(1, round(100 * quality)))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return tuple(np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (BRIGHTNESS, COLOUR))


def _blocks(plane: np.ndarray) -> np.ndarray:
    """(blocks, 64) of a plane, its last line and column repeated to whole blocks."""
    p = np.pad(plane, ((0, -plane.shape[0] % 8), (0, -plane.shape[1] % 8)), "edge")
    b = p.reshape(p.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    return (COSINES @ b @ COSINES.T).reshape(-1, 64)


def _sizes(v: np.ndarray) -> np.ndarray:
    """Bits of the absolute values."""
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def _limited(counts: np.ndarray, most: int = 16) -> np.ndarray:
    """Code lengths of at most so many bits, none of them all ones."""
    counts = np.append(counts, 1 if counts.any() else 0)
    while True:
        lengths = _lengths_of(counts)
        if lengths.max(initial=0) <= most:
            # The symbol added last is of the longest codes and takes the one of all ones.
            return lengths[:-1]
        counts = np.where(counts > 0, (counts + 1) // 2, 0)


def _canonical(lengths: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """(code of each symbol, symbols of each length from 1 to 16, symbols in order)."""
    order = sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s))
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for s in order:
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes, [int((lengths == n).sum()) for n in range(1, 17)], order


def _stream(values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(table, symbol, extra bits, their number) of blocks in the order of the file: first the change of the mean, then runs of zeros with values."""
    n, first = len(values), values[:, 0].copy()
    part = np.arange(n) % 3
    for c in range(3):
        first[c::3] = np.diff(first[c::3], prepend=0)
    block, place = np.nonzero(values[:, 1:])
    place += 1
    same = np.concatenate(([False], block[1:] == block[:-1]))
    run = place - np.where(same, np.concatenate(([0], place[:-1])), 0) - 1
    v = values[block, place]
    ends = np.zeros(n, np.int64)
    np.maximum.at(ends, block, place)
    skips = run // 16
    skipped = np.repeat(np.arange(len(block)), skips)
    open_ends = np.flatnonzero(ends < 63)
    rows = [
        (np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), _sizes(first), first),
        (block[skipped], place[skipped], np.zeros(len(skipped), np.int64), np.full(len(skipped), 0xF0), np.zeros(len(skipped), np.int64)),
        (block, place, np.ones(len(block), np.int64), (run % 16) << 4 | _sizes(v), v),
        (open_ends, np.full(len(open_ends), 64), np.zeros(len(open_ends), np.int64), np.zeros(len(open_ends), np.int64), np.zeros(len(open_ends), np.int64)),
    ]
    at, where, late, symbol, value = (np.concatenate(c) for c in zip(*rows, strict=True))
    order = np.lexsort((late, where, at))
    at, where, symbol, value = at[order], where[order], symbol[order], value[order]
    bits = np.where(where == 0, symbol, symbol & 15)
    table = (where > 0) * 2 + (part[at] > 0)
    return table, symbol, np.where(value < 0, value - 1, value) & (1 << bits) - 1, bits


def encode(rgb: np.ndarray, quality: float = 0.95) -> bytes:
    """A file of a uint8 array (height, width, 3)."""
    h, w = rgb.shape[:2]
    if not (0 < h < 1 << 16 and 0 < w < 1 << 16):
        raise ValueError("A JPEG file has 1 to 65535 pixels a side.")
    quant = tables(quality)
    planes = rgb.astype(np.float64) @ YCC.T - (128, 0, 0)
    levels = [np.rint(_blocks(planes[..., c]) / quant[c > 0]).astype(np.int64)[:, ZIGZAG] for c in range(3)]
    table, symbol, extra, bits = _stream(np.stack(levels, axis=1).reshape(-1, 64))
    code, size, heads = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64), []
    for t in range(4):
        own = table == t
        lengths = _limited(np.bincount(symbol[own], minlength=256))
        codes, counts, order = _canonical(lengths)
        code[own], size[own] = codes[symbol[own]], lengths[symbol[own]]
        heads.append(bytes([(t >> 1) << 4 | t & 1, *counts, *order]))
    n = size + bits
    ends = np.cumsum(n)
    value = np.repeat(code << bits | extra, n)
    place = np.repeat(ends, n) - np.arange(int(ends[-1])) - 1
    stream = (value >> place & 1).astype(np.uint8)
    # The last byte is filled with ones; a byte of ones is followed by one of zeros.
    data = np.packbits(np.concatenate((stream, np.ones(-len(stream) % 8, np.uint8)))).tobytes().replace(b"\xff", b"\xff\x00")
    segment = lambda kind, body: struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body
    frame = struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([c + 1, 0x11, int(c > 0)]) for c in range(3))
    return b"".join([
        b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), *(segment(0xDB, bytes([k, *q[ZIGZAG].tolist()])) for k, q in enumerate(quant)), segment(0xC0, frame), *(segment(0xC4, head) for head in heads),
        segment(0xDA, b"\3" + b"".join(bytes([c + 1, 0x11 * int(c > 0)]) for c in range(3)) + b"\0\x3f\0"), data, b"\xff\xd9",
    ])
