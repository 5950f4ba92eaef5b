"""Binary formats over Spark's binaryFile rows: float rasters, shapefiles, archives, and their writers."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: TIFF tag numbers and field types that a float raster needs. Fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_BYTES, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 12: "d"}


def write_geotiff(values: np.ndarray, west: float, north: float, dx: float, dy: float, no_data: float | None = None) -> bytes:
    """A little-endian single-strip float32 raster in degrees; the tie point is the corner of the first pixel."""
    data = np.ascontiguousarray(values, "<f4").tobytes()
    h, w = values.shape
    tags: list[tuple[int, int, list | bytes]] = [
        (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [32]), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [1]), (STRIP_AT, 4, [0]), (SAMPLES, 3, [1]), (ROWS, 4, [h]),
        (STRIP_BYTES, 4, [len(data)]), (SAMPLE_FORMAT, 3, [3]), (PIXEL_SCALE, 12, [dx, dy, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, west, north, 0.0]),
        (GEO_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326]),
    ]
    if no_data is not None:
        tags.append((NO_DATA, 2, f"{no_data:g}\0".encode()))
    extra_at = 8 + 2 + 12 * len(tags) + 4
    packed = [(t, k, len(v), v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{_CODES[k]}", *v)) for t, k, v in tags]
    strip_at = extra_at + sum(len(b) for _, _, _, b in packed if len(b) > 4)
    directory, extra = b"", b""
    for tag, kind, n, body in packed:
        if tag == STRIP_AT:
            body = struct.pack("<I", strip_at)
        if len(body) > 4:
            field, extra = struct.pack("<I", extra_at + len(extra)), extra + body
        else:
            field = body.ljust(4, b"\0")
        directory += struct.pack("<HHI", tag, kind, n) + field
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + directory + struct.pack("<I", 0) + extra + data


def read_tags(fetch: Callable[[int, int], bytes]) -> dict[int, tuple | bytes]:
    """The tags of a little-endian TIFF, by a function of (offset, size)."""
    if fetch(0, 4) != b"II*\0":
        raise ValueError("a little-endian TIFF is needed")
    at = struct.unpack("<I", fetch(4, 4))[0]
    count = struct.unpack("<H", fetch(at, 2))[0]
    entries, out = fetch(at + 2, 12 * count), {}
    for i in range(count):
        tag, kind, n = struct.unpack_from("<HHI", entries, 12 * i)
        size = _SIZES.get(kind, 0) * n
        body = entries[12 * i + 8 : 12 * i + 12] if size <= 4 else fetch(struct.unpack_from("<I", entries, 12 * i + 8)[0], size)
        out[tag] = body[:size] if kind == 2 else struct.unpack_from(f"<{n}{_CODES[kind]}", body) if kind in _CODES else ()
    return out


def raster_shape(t: dict[int, tuple | bytes]) -> tuple[int, int, int, float | None]:
    """(width, height, offset of the values, no-data value) of a single strip of float32."""
    if t[BITS][0] != 32 or t[SAMPLE_FORMAT][0] != 3 or len(t[STRIP_AT]) != 1:
        raise ValueError("a single strip of float32 is needed")
    return t[WIDTH][0], t[HEIGHT][0], t[STRIP_AT][0], float(t[NO_DATA].rstrip(b"\0")) if NO_DATA in t else None


def georeference(t: dict[int, tuple | bytes], w: int, h: int) -> dict[str, float | None]:
    """Bounds and scale; ground size is in metres if the scale is in degrees."""
    dx, dy = t[PIXEL_SCALE][:2]
    west, north = t[TIE_POINT][3:5]
    metres = dx * 111_320 if abs(dx) < 0.1 else dx
    return {"west": west, "north": north, "dx": dx, "dy": dy, "east": west + w * dx, "south": north - h * dy, "gsd_m": metres, "no_data": raster_shape(t)[3]}


def read_geotiff(raw: bytes) -> tuple[np.ndarray, dict[str, float | None]]:
    """Values and georeference."""
    t = read_tags(lambda at, n: raw[at : at + n])
    w, h, at, _ = raster_shape(t)
    return np.frombuffer(raw, "<f4", w * h, at).reshape(h, w), georeference(t, w, h)


def world_file(west: float, north: float, dx: float, dy: float) -> str:
    """Six lines; the position is the centre of the first pixel, unlike the raster's corner."""
    return "".join(f"{v:.12f}\n" for v in (dx, 0.0, 0.0, -dy, west + dx / 2, north - dy / 2))


def write_shapefile(rings: list[np.ndarray], attributes: list[dict[str, str | float]]) -> tuple[bytes, bytes, bytes]:
    """(shp, shx, dbf) of polygons, one part a record, clockwise and closed."""
    bodies = []
    for ring in rings:
        x, y = ring[:, 0], ring[:, 1]
        if np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)) > 0:
            ring = ring[::-1]
        if not np.array_equal(ring[0], ring[-1]):
            ring = np.vstack([ring, ring[:1]])
        box = (*ring.min(axis=0), *ring.max(axis=0))
        bodies.append(struct.pack("<i4dii", 5, *box, 1, len(ring)) + struct.pack("<i", 0) + ring.astype("<f8").tobytes())
    corners = np.vstack(rings) if rings else np.zeros((1, 2))
    box = (*corners.min(axis=0), *corners.max(axis=0))

    def head(size: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i", 1000, 5) + struct.pack("<8d", *box, 0, 0, 0, 0)

    shp, shx, at = b"", b"", 50
    for i, body in enumerate(bodies):
        shp += struct.pack(">2i", i + 1, len(body) // 2) + body
        shx += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    return head(100 + len(shp)) + shp, head(100 + len(shx)) + shx, write_dbf(attributes)


def read_shapefile(raw: bytes) -> list[np.ndarray]:
    """The rings of a polygon file with one part a record."""
    out, at = [], 100
    while at + 8 <= len(raw):
        size = struct.unpack_from(">i", raw, at + 4)[0] * 2
        kind, *_, parts, points = struct.unpack_from("<i4dii", raw, at + 8)
        if kind == 5:
            if parts != 1:
                raise ValueError("one part a record is read")
            out.append(np.frombuffer(raw, "<f8", points * 2, at + 8 + 44 + 4).reshape(-1, 2).copy())
        at += 8 + size
    return out


def write_dbf(rows: list[dict[str, str | float]], width: int = 32) -> bytes:
    """Fixed-width attributes: numbers right-aligned with six decimals, text ASCII."""
    names = list(rows[0]) if rows else []
    number = {n: all(isinstance(r[n], (int, float)) for r in rows) for n in names}
    fields = b"".join(n[:10].encode("ascii", "replace").ljust(11, b"\0") + (b"N" if number[n] else b"C") + bytes(4) + bytes([width, 6 if number[n] else 0]) + bytes(14) for n in names)
    record = 1 + width * len(names)
    head = struct.pack("<4BIHH20x", 3, 126, 1, 1, len(rows), 32 + len(fields) + 1, record)
    cell = lambda r, n: (f"{r[n]:.6f}".rjust(width) if number[n] else str(r[n])[:width].ljust(width)).encode("ascii", "replace")
    return head + fields + b"\r" + b"".join(b" " + b"".join(cell(r, n) for n in names) for r in rows) + b"\x1a"


def table_head(fetch: Callable[[int, int], bytes]) -> tuple[int, int, int, list[tuple[str, str, int]]]:
    """(records, bytes of the head, bytes of a record, [(name, kind, width)])."""
    n, head, record = struct.unpack("<IHH", fetch(4, 8))
    raw, fields = fetch(32, head - 32), []
    for at in range(0, head - 33, 32):
        if raw[at] == 0x0D:
            break
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("ascii"), chr(raw[at + 11]), raw[at + 16]))
    return n, head, record, fields


def read_dbf(raw: bytes) -> list[dict[str, str]]:
    """Rows of trimmed strings."""
    n, head, record, fields = table_head(lambda at, size: raw[at : at + size])
    out = []
    for i in range(n):
        at, row = head + i * record + 1, {}
        for name, _, width in fields:
            row[name] = raw[at : at + width].decode("ascii", "replace").strip()
            at += width
        out.append(row)
    return out


def zip_member(raw: bytes, *patterns: str) -> tuple[str, bytes] | None:
    """The first member that the first matching pattern names; earlier patterns beat later ones."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for pattern in patterns:
            for name in z.namelist():
                if re.search(pattern, name):
                    return name, z.read(name)
    return None


def raster_rows(files: DataFrame) -> DataFrame:
    """(path, x, y, value) of float rasters from binaryFile rows; no-data pixels go."""

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                values, ref = read_geotiff(bytes(content))
                y, x = np.nonzero(np.ones_like(values, bool) if ref["no_data"] is None else values != np.float32(ref["no_data"]))
                yield pd.DataFrame({"path": path, "x": x.astype(np.int32), "y": y.astype(np.int32), "value": values[y, x]})

    return files.select("path", "content").mapInPandas(run, "path string, x int, y int, value float")


def archive_members(files: DataFrame, *patterns: str) -> DataFrame:
    """(path, member, content) of the wanted member of each archive."""

    def run(batches):
        for b in batches:
            rows = [(p, *m) for p, c in zip(b["path"], b["content"], strict=True) if (m := zip_member(bytes(c), *patterns))]
            yield pd.DataFrame(rows, columns=["path", "member", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary")


def has_gps(raw: bytes) -> bool:
    """Whether a JPEG's EXIF block points to a GPS directory; reads the header segments only."""
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] not in (0xD9, 0xDA):
        size = struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + size]
        if raw[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            end = "<" if tiff[:2] == b"II" else ">"
            where = struct.unpack_from(end + "I", tiff, 4)[0]
            n = struct.unpack_from(end + "H", tiff, where)[0]
            return any(struct.unpack_from(end + "H", tiff, where + 2 + 12 * i)[0] == 0x8825 for i in range(n))
        at += 2 + size
    return False


def list_objects(spark, folder: str, name: str) -> DataFrame:
    """(path, length, modificationTime) of the files of that very name."""
    from pyspark.sql import functions as F

    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{name}*").load(folder)
    return found.filter(F.element_at(F.split("path", "/"), -1) == name).select("path", "length", "modificationTime")
