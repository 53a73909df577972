"""Pixels of image files as columns: PNG and plain BMP to RGB, in numpy, in batches; and PNG files from pixels.

A PNG is a list of chunks; its rows are deflated bytes, each row predicted from its left, upper
and upper-left neighbours by one of five filters. The filters are undone along diagonals: at
step t row r is at byte group t - r, whose three neighbours are known by then, so one numpy
step serves all rows whatever their filters. Interlaced files are seven such images.

Alpha is dropped and 16-bit samples keep their high byte. A file that is broken, of another
kind, or larger than `most` pixels gives its reason in place of pixels.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PIXELS = "width int, height int, rgb binary, error string"
MOST_PIXELS = 1 << 27
# Fixed values of the format: its first bytes, samples a pixel by colour type, and the passes of interlaced images (first column and row, steps).
_PNG = b"\x89PNG\r\n\x1a\n"
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class Broken(ValueError):
    pass


def _chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], len(_PNG)
    while at < len(data):
        if at + 12 > len(data):
            raise Broken("cut off")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4:
            raise Broken("cut off")
        if zlib.crc32(kind + body) != struct.unpack(">I", check)[0]:
            raise Broken(f"checksum of {kind.decode('latin-1')}")
        out.append((kind, body))
        at += 12 + size
        if kind == b"IEND":
            return out
    raise Broken("no end")


def unfiltered(raw: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Rows of byte groups (height, width, bytes) without their filters."""
    high, wide, _ = raw.shape
    if filters.size and filters.max() > 4:
        raise Broken("unknown filter")
    out = np.zeros((high + 1, wide + 1, raw.shape[2]), np.int16)
    raw = raw.astype(np.int16)
    for t in range(high + wide - 1):
        r = np.arange(max(0, t - wide + 1), min(high, t + 1))
        x = t - r
        left, up, corner = out[r + 1, x], out[r, x + 1], out[r, x]
        a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        f = filters[r][:, None]
        guess = np.choose(f, [np.zeros_like(left), left, up, (left + up) >> 1, nearest])
        out[r + 1, x + 1] = (raw[r, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _samples(data: np.ndarray, at: int, wide: int, high: int, depth: int, samples: int) -> tuple[np.ndarray, int]:
    """(height, width, samples) of one image inside data, 16-bit ones by their high byte, and the place after it."""
    bits = depth * samples
    row, group = (wide * bits + 7) // 8, max(1, bits // 8)
    end = at + high * (row + 1)
    if end > len(data):
        raise Broken("too few rows")
    rows = data[at:end].reshape(high, row + 1)
    plain = unfiltered(rows[:, 1:].reshape(high, row // group, group), rows[:, 0]).reshape(high, row)
    if depth == 16:
        return plain.reshape(high, wide, samples, 2)[..., 0], end
    if depth < 8:
        each = np.unpackbits(plain, axis=1).reshape(high, -1, depth)
        plain = (each * (1 << np.arange(depth)[::-1])).sum(axis=2, dtype=np.uint8)[:, : wide * samples]
    return plain.reshape(high, wide, samples), end


def _png(data: bytes, most: int) -> np.ndarray:
    parts = _chunks(data)
    if not parts or parts[0][0] != b"IHDR" or len(parts[0][1]) != 13:
        raise Broken("no header")
    wide, high, depth, colour, method, filtering, laced = struct.unpack(">IIBBBBB", parts[0][1])
    if not wide or not high or colour not in _SAMPLES or depth not in (1, 2, 4, 8, 16) or (depth < 8 and colour not in (0, 3)) or (depth == 16 and colour == 3) or method or filtering or laced > 1:
        raise Broken("bad header")
    if wide * high > most:
        raise Broken(f"{wide} by {high} pixels, more than {most}")
    samples = _SAMPLES[colour]
    limit = 2 * (wide * samples * depth // 8 + 2) * high + 4096  # interlaced rows have more ends
    inflated = zlib.decompressobj().decompress(b"".join(b for k, b in parts if k == b"IDAT"), limit)
    raw = np.frombuffer(inflated, np.uint8)
    if not laced:
        found, _ = _samples(raw, 0, wide, high, depth, samples)
    else:
        found, at = np.zeros((high, wide, samples), np.uint8), 0
        for x, y, dx, dy in _PASSES:
            w, h = -(-(wide - x) // dx), -(-(high - y) // dy)
            if w > 0 and h > 0:
                found[y::dy, x::dx], at = _samples(raw, at, w, h, depth, samples)
    if colour == 3:
        table = np.frombuffer(next((b for k, b in parts if k == b"PLTE"), b""), np.uint8)
        if len(table) % 3 or int(found.max()) >= len(table) // 3:
            raise Broken("a colour that the palette lacks")
        return table.reshape(-1, 3)[found[..., 0]]
    if depth < 8:
        found = found * np.uint8(255 // ((1 << depth) - 1))
    return np.repeat(found[..., :1], 3, axis=2) if colour in (0, 4) else found[..., :3]


def _bmp(data: bytes, most: int) -> np.ndarray:
    if len(data) < 54:
        raise Broken("cut off")
    at, head, wide, high, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if head < 40 or bits not in (24, 32) or packed not in (0, 3) or wide <= 0 or not high or (packed == 3 and bits != 32):
        raise Broken("a kind of BMP that is not read")
    if wide * abs(high) > most:
        raise Broken(f"{wide} by {abs(high)} pixels, more than {most}")
    row = (wide * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(data[at : at + row * abs(high)], np.uint8)
    if len(raw) < row * abs(high):
        raise Broken("cut off")
    found = raw.reshape(abs(high), row)[:, : wide * bits // 8].reshape(abs(high), wide, -1)[..., 2::-1]
    return found[::-1] if high > 0 else found


def rgb(data: bytes, most: int = MOST_PIXELS) -> np.ndarray:
    """(height, width, 3) bytes; Broken with the reason if the file is not read."""
    if data.startswith(_PNG):
        return _png(data, most)
    if data.startswith(b"BM"):
        return _bmp(data, most)
    known = {b"\xff\xd8\xff": "JPEG", b"RIFF": "WebP", b"GIF8": "GIF"}
    raise Broken(next((f"{name} is not read" for start, name in known.items() if data.startswith(start)), "no image"))


def pixels(content: Column, most: int = MOST_PIXELS) -> Column:
    """A struct (width, height, rgb, error) of image files: rgb has three bytes a pixel, rows from the top; error says why there is none."""

    @F.pandas_udf(PIXELS)
    def found(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            try:
                image = rgb(data or b"", most)
                rows.append((image.shape[1], image.shape[0], image.tobytes(), None))
            except (Broken, zlib.error, struct.error, ValueError) as e:
                rows.append((None, None, None, str(e) or type(e).__name__))
        return pd.DataFrame(rows, columns=["width", "height", "rgb", "error"]).astype({"width": "Int32", "height": "Int32"})

    return found(content)


def png_file(image: np.ndarray, filters: list[int] | None = None) -> bytes:
    """A PNG file of (height, width, samples) bytes, samples 1 to 4; filters name the filter of each row, in turn."""
    high, wide, samples = image.shape
    before = np.zeros((high + 1, wide + 1, samples), np.int16)
    before[1:, 1:] = image
    here, left, up, corner = before[1:, 1:], before[1:, :-1], before[:-1, 1:], before[:-1, :-1]
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    guesses = [0 * here, left, up, (left + up) >> 1, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))]
    rows = []
    for y in range(high):
        f = (filters or [0])[y % len(filters or [0])]
        rows.append(bytes([f]) + ((here[y] - guesses[f][y]) & 255).astype(np.uint8).tobytes())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", wide, high, 8, {1: 0, 2: 4, 3: 2, 4: 6}[samples], 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
