"""Shapefiles: points, lines and polygons with a dBase table, written as the three files of the format."""

from __future__ import annotations

import io
import struct
import zipfile

from freshet.sources.sinks import short_names

POINT, LINE, POLYGON = 1, 3, 5


def _record(kind: int, parts: list[list[tuple[float, float]]]) -> bytes:
    if not parts or not parts[0]:
        return struct.pack("<i", 0)
    if kind == POINT:
        return struct.pack("<idd", POINT, *parts[0][0])
    xs, ys = [x for p in parts for x, _ in p], [y for p in parts for _, y in p]
    starts, n = [], 0
    for p in parts:
        starts.append(n)
        n += len(p)
    head = struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(parts), n)
    return head + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<dd", *p) for part in parts for p in part)


def _header(kind: int, words: int, box) -> bytes:
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i", 1000, kind) + struct.pack("<8d", *box, 0.0, 0.0, 0.0, 0.0)


def _table(columns: dict[str, list]) -> bytes:
    """dBase III: truth values as whole numbers, numbers right-aligned, missing values blank."""
    fields, n = [], len(next(iter(columns.values()), []))
    for name, values in columns.items():
        have = [v for v in values if v is not None]
        if have and all(isinstance(v, (bool, int)) for v in have):
            fields.append((name, "N", 18, 0, ["" if v is None else str(int(v)) for v in values]))
        elif have and all(isinstance(v, (bool, int, float)) for v in have):
            fields.append((name, "N", 24, 8, ["" if v is None or v != v else f"{v:.8f}" for v in values]))
        else:
            text = ["" if v is None else str(v).encode()[:254].decode(errors="ignore") for v in values]
            fields.append((name, "C", max([1, *(len(t.encode()) for t in text)]), 0, text))
    size = 1 + sum(f[2] for f in fields)
    out = struct.pack("<4BIHH20x", 3, 124, 1, 1, n, 33 + 32 * len(fields), size)
    for name, kind, width, digits, _ in fields:
        out += struct.pack("<11sc4xBB14x", name.encode()[:10], kind.encode(), width, digits)
    rows = b"".join(b" " + b"".join((t.encode().ljust(w) if k == "C" else t.encode().rjust(w)) for t, k, w in ((f[4][i], f[1], f[2]) for f in fields)) for i in range(n))
    return out + b"\r" + rows + b"\x1a"


def encode(kind: int, shapes: list[list[list[tuple[float, float]]]], columns: dict[str, list]) -> dict[str, bytes]:
    """shp, shx and dbf of shapes (each a list of parts of points) and their columns, which get names of ten characters; fields
    maps those back to the full ones."""
    body, index, at = bytearray(), bytearray(), 50
    for k, parts in enumerate(shapes):
        r = _record(kind, parts)
        body += struct.pack(">2i", k + 1, len(r) // 2) + r
        index += struct.pack(">2i", at, len(r) // 2)
        at += 4 + len(r) // 2
    xs, ys = [x for s in shapes for p in s for x, _ in p] or [0.0], [y for s in shapes for p in s for _, y in p] or [0.0]
    box = (min(xs), min(ys), max(xs), max(ys))
    names = short_names(list(columns))
    return {
        "shp": _header(kind, at, box) + bytes(body),
        "shx": _header(kind, 50 + 4 * len(shapes), box) + bytes(index),
        "dbf": _table({names[c]: v for c, v in columns.items()}),
        "cpg": b"UTF-8",
        "fields": names,
    }


def zipped(name: str, encoded: dict) -> bytes:
    """The files in one archive, with the table of full names beside them."""
    import json

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for ext in ("shp", "shx", "dbf", "cpg"):
            z.writestr(f"{name}.{ext}", encoded[ext])
        z.writestr(f"{name}_fields.json", json.dumps({v: k for k, v in encoded["fields"].items()}, sort_keys=True))
    return out.getvalue()


def decode(shp: bytes, dbf: bytes) -> tuple[list[list[list[tuple[float, float]]]], list[dict[str, str]]]:
    """(shapes, rows) of what encode() writes."""
    shapes, at = [], 100
    while at < len(shp):
        size = struct.unpack_from(">i", shp, at + 4)[0] * 2
        kind = struct.unpack_from("<i", shp, at + 8)[0]
        if kind == 0:
            shapes.append([])
        elif kind == POINT:
            shapes.append([[struct.unpack_from("<dd", shp, at + 12)]])
        else:
            n, m = struct.unpack_from("<2i", shp, at + 44)
            starts = [*struct.unpack_from(f"<{n}i", shp, at + 52), m]
            flat = struct.unpack_from(f"<{2 * m}d", shp, at + 52 + 4 * n)
            shapes.append([[(flat[2 * k], flat[2 * k + 1]) for k in range(a, b)] for a, b in zip(starts[:-1], starts[1:], strict=True)])
        at += 8 + size
    n, head, size = struct.unpack_from("<IHH", dbf, 4)
    fields, place = [], 1
    for k in range((head - 33) // 32):
        name, _, width, _ = struct.unpack_from("<11sc4xBB", dbf, 32 + 32 * k)
        fields.append((name.split(b"\0")[0].decode(), place, width))
        place += width
    return shapes, [{f: dbf[head + size * i + a : head + size * i + a + w].decode().strip() for f, a, w in fields} for i in range(n)]
