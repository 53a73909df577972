"""Images made here come back equal, whatever their filters, colour types, depths and interlacing; broken ones have a reason."""

import struct
import zlib

import numpy as np
import pytest

from tessera.sources import io, pixels as px


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def packed(samples, depth):
    """Rows of samples (height, n) as bytes of that depth."""
    if depth == 16:
        return samples.astype(">u2").view(np.uint8).reshape(len(samples), -1)
    bits = (samples[..., None] >> np.arange(depth)[::-1]) & 1
    return np.packbits(bits.reshape(len(samples), -1).astype(np.uint8), axis=1)


def filtered(rows, group, first):
    """Rows of bytes with filters 0 to 4 in turn, by the definition, byte by byte."""
    out, before = b"", [0] * rows.shape[1]
    for y, row in enumerate(rows.tolist()):
        f, line = (first + y) % 5, []
        for i, v in enumerate(row):
            a, b, c = (row[i - group] if i >= group else 0), before[i], (before[i - group] if i >= group else 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, nearest)[f]) % 256)
        out, before = out + bytes([f, *line]), row
    return out


def made(samples, colour, depth, laced, extra=()):
    high, wide, n = samples.shape
    group = max(1, n * depth // 8)
    passes = px._PASSES if laced else ((0, 0, 1, 1),)
    data = b"".join(filtered(packed(part.reshape(len(part), -1), depth), group, k) for k, (x, y, dx, dy) in enumerate(passes) if (part := samples[y::dy, x::dx]).size)
    head = struct.pack(">IIBBBBB", wide, high, depth, colour, 0, 0, int(laced))
    middle = zlib.compress(data)
    cut = len(middle) // 2
    return px._PNG + chunk(b"IHDR", head) + b"".join(chunk(k, b) for k, b in extra) + chunk(b"IDAT", middle[:cut]) + chunk(b"IDAT", middle[cut:]) + chunk(b"IEND", b"")


KINDS = [(0, d) for d in (1, 2, 4, 8, 16)] + [(2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)]


@pytest.mark.parametrize("laced", [False, True])
def test_every_colour_type_depth_and_filter(spark, laced):
    rng, rows, want = np.random.default_rng(1), [], {}
    for k, (colour, depth) in enumerate(KINDS):
        for high, wide in ((13, 11), (1, 1), (7, 3)):
            samples = rng.integers(0, 1 << depth, (high, wide, px._SAMPLES[colour]))
            table = rng.integers(0, 256, (1 << min(depth, 8), 3), dtype=np.uint8)
            name = f"{k} {high}"
            rows.append((name, made(samples, colour, depth, laced, [(b"PLTE", table.tobytes())] if colour == 3 else [])))
            eight = samples >> 8 if depth == 16 else samples * (255 // ((1 << depth) - 1))
            want[name] = table[samples[..., 0]] if colour == 3 else np.repeat(eight[..., :1], 3, axis=2) if colour in (0, 4) else eight[..., :3]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    for r in df.select("name", px.pixels(df.content).alias("p")).collect():
        assert r.p.error is None, (r.name, r.p.error)
        assert np.array_equal(np.frombuffer(r.p.rgb, np.uint8).reshape(r.p.height, r.p.width, 3), want[r.name]), r.name


def test_files_written_here_are_read_and_listed(spark, tmp_path):
    rng = np.random.default_rng(2)
    images = {n: rng.integers(0, 256, (9, 6, n), dtype=np.uint8) for n in (1, 2, 3, 4)}
    for n, image in images.items():
        (tmp_path / f"i{n}.png").write_bytes(px.png_file(image, [0, 1, 2, 3, 4]))
    bgr = images[3][::-1, :, ::-1]
    body = b"".join(r.tobytes() + b"\0\0" for r in bgr)
    (tmp_path / "i5.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 6, 9, 1, 24, 0, len(body), 0, 0, 0, 0) + body)
    df = io.images(spark, str(tmp_path))
    got = {r.path[-6:-4]: r.p for r in df.select("path", px.pixels(df.content).alias("p")).collect()}
    for n, image in images.items():
        want = np.repeat(image[..., :1], 3, axis=2) if n < 3 else image[..., :3]
        assert np.array_equal(np.frombuffer(got[f"i{n}"].rgb, np.uint8).reshape(9, 6, 3), want)
    assert got["i5"].rgb == images[3].tobytes()


def test_broken_files_have_a_reason(spark):
    good = px.png_file(np.zeros((4, 4, 3), np.uint8))
    flipped = bytearray(good)
    flipped[45] ^= 1
    bad_filter = px._PNG + good[8:33] + chunk(b"IDAT", zlib.compress(bytes([9] + [0] * 12) * 4)) + chunk(b"IEND", b"")
    short = px._PNG + good[8:33] + chunk(b"IDAT", zlib.compress(b"\0")) + chunk(b"IEND", b"")
    palette = made(np.full((2, 2, 1), 3), 3, 8, False, [(b"PLTE", b"abc")])
    rows = [("good", good), ("cut", good[:-20]), ("flip", bytes(flipped)), ("filter", bad_filter), ("short", short), ("palette", palette), ("jpeg", b"\xff\xd8\xff\xe0"), ("none", b""), ("null", None), ("zlib", px._PNG + good[8:33] + chunk(b"IDAT", b"xx") + chunk(b"IEND", b""))]
    df = spark.createDataFrame(rows, "name string, content binary")
    got = {r.name: r.p.error for r in df.select("name", px.pixels(df.content).alias("p")).collect()}
    assert got.pop("good") is None and all(got.values())
    assert "checksum" in got["flip"] and "JPEG" in got["jpeg"] and "filter" in got["filter"] and "rows" in got["short"] and "palette" in got["palette"]
    assert "more than" in df.where("name = 'good'").select(px.pixels(df.content, 15).alias("p")).first().p.error
