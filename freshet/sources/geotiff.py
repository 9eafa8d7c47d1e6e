"""Single-band GeoTIFF: the part of the format that carries grids (strips or tiles, plain, LZW or deflate, north up)."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Field types (struct code, size), tags and compressions of the format.
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, MATRIX, KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
PLAIN, LZW, DEFLATE = 1, 5, 8
_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


@dataclass
class Grid:
    """Values by row and column, the upper left corner, cell sizes, the projection's number and the missing value."""

    values: np.ndarray
    x0: float
    y0: float
    dx: float
    dy: float
    epsg: int | None = None
    nodata: float | None = None


def lzw_decode(data: bytes) -> bytes:
    """Variable-width codes, most significant bit first; 256 starts anew, 257 ends."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table, width, word = {bytes([k]): k for k in range(256)}, 9, b""
    n = 258
    put(256, 9)
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in table:
            word = more
            continue
        put(table[word], width)
        table[more] = n
        n += 1
        width = max(9, min(12, n.bit_length()))
        if n >= 4094:
            put(256, width)
            table, width, n = {bytes([k]): k for k in range(256)}, 9, 258
        word = data[k : k + 1]
    if word:
        put(table[word], width)
        n += 1
        width = max(9, min(12, n.bit_length()))
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 0xFF)
    return bytes(out)


def _tags(data: bytes) -> tuple[str, dict]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    found = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in _TYPES:
            continue
        code, size = _TYPES[kind]
        place = at + 10 + 12 * k
        if n * size > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
        found[tag] = data[place : place + n] if kind == 2 else struct.unpack_from(f"{order}{n * len(code)}{code[0]}", data, place)
    return order, found


def decode(data: bytes) -> Grid:
    """The grid of a file's bytes. More than one band, rotated grids and unknown compressions are refused."""
    order, tag = _tags(data)
    one = lambda t, other: tag.get(t, (other,))[0]
    if one(SAMPLES, 1) != 1:
        raise ValueError("one band is read")
    wide, high = one(WIDTH, 0), one(HEIGHT, 0)
    kind = _KINDS.get((one(FORMAT, 1), one(BITS, 8)))
    if kind is None:
        raise ValueError("unknown sample format")
    tiled = TILES in tag
    bw, bh = (one(TILE_WIDTH, wide), one(TILE_HEIGHT, high)) if tiled else (wide, min(high, one(ROWS_PER_STRIP, high)))
    places, sizes = (tag[TILES], tag[TILE_BYTES]) if tiled else (tag[STRIPS], tag[STRIP_BYTES])
    values = np.zeros((high, wide), kind)
    for k, (at, size) in enumerate(zip(places, sizes, strict=True)):
        raw = data[at : at + size]
        how = one(COMPRESSION, PLAIN)
        if how == LZW:
            raw = lzw_decode(raw)
        elif how in (DEFLATE, 32946):
            raw = zlib.decompress(raw)
        elif how != PLAIN:
            raise ValueError(f"unknown compression {how}")
        r, c = (k // -(-wide // bw) * bh, k % -(-wide // bw) * bw) if tiled else (k * bh, 0)
        rows = bh if tiled else min(bh, high - r)
        part = np.frombuffer(raw[: rows * bw * np.dtype(kind).itemsize], order + kind).reshape(rows, bw)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=kind)
        elif one(PREDICTOR, 1) != 1:
            raise ValueError("unknown predictor")
        rr, cc = min(rows, high - r), min(bw, wide - c)
        values[r : r + rr, c : c + cc] = part[:rr, :cc]
    if MATRIX in tag:
        m = tag[MATRIX]
        if m[1] or m[4]:
            raise ValueError("the grid is rotated")
        x0, y0, dx, dy = m[3], m[7], m[0], -m[5]
    else:
        (dx, dy, *_), tie = tag.get(SCALE, (1.0, 1.0)), tag.get(TIEPOINT, (0.0,) * 6)
        x0, y0 = tie[3] - tie[0] * dx, tie[4] + tie[1] * dy
    keys = tag.get(KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    text = tag.get(NODATA, b"").split(b"\0")[0].strip()
    return Grid(values, x0, y0, dx, dy, codes.get(3072) or codes.get(2048), float(text) if text else None)


def encode(grid: Grid, compression: int = LZW, strip_rows: int = 64) -> bytes:
    """A little-endian file of 32-bit floats."""
    values = np.ascontiguousarray(grid.values, "<f4")
    strips = [values[r : r + strip_rows].tobytes() for r in range(0, len(values), strip_rows)]
    pack = {PLAIN: lambda x: x, LZW: lzw_encode, DEFLATE: zlib.compress}[compression]
    strips = [pack(x) for x in strips]
    projected = grid.epsg is not None and grid.epsg != 4326
    tags = {
        WIDTH: (4, (values.shape[1],)), HEIGHT: (4, (values.shape[0],)), BITS: (3, (32,)), COMPRESSION: (3, (compression,)), 262: (3, (1,)), STRIPS: (4, (0,) * len(strips)),
        SAMPLES: (3, (1,)), ROWS_PER_STRIP: (4, (strip_rows,)), STRIP_BYTES: (4, tuple(map(len, strips))), FORMAT: (3, (3,)),
        SCALE: (12, (grid.dx, grid.dy, 0.0)), TIEPOINT: (12, (0.0, 0.0, 0.0, grid.x0, grid.y0, 0.0)),
    }
    if grid.epsg is not None:
        tags[KEYS] = (3, (1, 1, 0, 3, 1024, 0, 1, 1 if projected else 2, 1025, 0, 1, 1, 3072 if projected else 2048, 0, 1, grid.epsg))
    if grid.nodata is not None:
        tags[NODATA] = (2, f"{grid.nodata:g}\0".encode())
    end = 8 + 2 + 12 * len(tags) + 4
    extra, entries = bytearray(), []

    def stored(kind: int, v) -> bytes:
        return v if kind == 2 else struct.pack(f"<{len(v)}{_TYPES[kind][0]}", *v)

    size = sum(len(b) + len(b) % 2 for b in (stored(*tags[t]) for t in tags) if len(b) > 4)
    at, places = end + size, []
    for x in strips:
        places.append(at)
        at += len(x)
    tags[STRIPS] = (4, tuple(places))
    for t in sorted(tags):
        kind, v = tags[t]
        b = stored(kind, v)
        if len(b) > 4:
            place = struct.pack("<I", end + len(extra))
            extra += b + b"\0" * (len(b) % 2)
        else:
            place = b.ljust(4, b"\0")
        entries.append(struct.pack("<HHI", t, kind, len(v)) + place)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + b"".join(entries) + b"\0\0\0\0" + bytes(extra) + b"".join(strips)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, r, c, x, y, v) of every cell with a value, in any number of files; a file is a task's work, its rows leave in strips."""

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                g = decode(bytes(content))
                for a in range(0, len(g.values), 256):
                    v = g.values[a : a + 256].astype("float64")
                    ok = np.isfinite(v) if g.nodata is None else np.isfinite(v) & (v != g.nodata)
                    r, c = np.nonzero(ok)
                    yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], "r": (r + a).astype("int32"), "c": c.astype("int32"), "x": g.x0 + (c + 0.5) * g.dx, "y": g.y0 - (r + a + 0.5) * g.dy, "v": v[ok]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, r int, c int, x double, y double, v double")


def tiles(cells: DataFrame, size: int, x0: float, y0: float, dx: float, dy: float, value: str = "v", epsg: int | None = None, nodata: float = -9999.0, compression: int = LZW) -> DataFrame:
    """(tr, tc, content): the cells (r, c, value) as files of size by size cells, one tile a task; missing cells hold nodata."""
    from pyspark.sql import functions as F

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf.tr.iloc[0]), int(pdf.tc.iloc[0])
        v = np.full((size, size), nodata, "f4")
        v[pdf.r - tr * size, pdf.c - tc * size] = pdf.v
        g = Grid(v, x0 + tc * size * dx, y0 - tr * size * dy, dx, dy, epsg, nodata)
        return pd.DataFrame({"tr": [tr], "tc": [tc], "content": [encode(g, compression)]})

    at = cells.select("r", "c", F.coalesce(F.col(value).cast("double"), F.lit(nodata)).alias("v"), F.floor(F.col("r") / size).cast("int").alias("tr"), F.floor(F.col("c") / size).cast("int").alias("tc"))
    return at.groupBy("tr", "tc").applyInPandas(run, "tr int, tc int, content binary")
