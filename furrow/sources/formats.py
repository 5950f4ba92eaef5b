"""Spark data sources: float rasters, polygon files, attribute tables, tile mosaics, and a store of objects as a sink.

`register` makes them known to a session; then `spark.read.format("float_raster").load(folder)` and the like work. Files are split: a task reads its share of a
file's rows or records by ranges, never the whole file. Rows travel as Arrow batches.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from furrow.sources import binary, files, png

#: Bytes of a file that one task reads, unless the option `splitBytes` says otherwise.
SPLIT_BYTES = 32 << 20
#: Tasks that a reader cuts its files into at most, as long as none gets more than SPLIT_BYTES; and what opening a file counts for. Fixed values.
MAX_SHARES, OPENING_BYTES = 512, 4096
#: Pixels along a tile's side, and tiles that one mosaic may have. Fixed values.
TILE, MAX_TILES = 256, 64
#: Objects that get their names at once. Fixed value.
COMMITS = 16
#: Rows of one Arrow batch.
BATCH = 65_536


class Share(InputPartition):
    """The part `k` of `n` of a file."""

    def __init__(self, path: str, k: int, n: int):
        self.path, self.k, self.n = path, k, n

    def of(self, items: int) -> tuple[int, int]:
        return items * self.k // self.n, items * (self.k + 1) // self.n


class Pack(InputPartition):
    """What one task reads: shares of one or several files."""

    def __init__(self, shares: list[Share]):
        self.shares = shares


def packed(found: list[tuple[str, int]], split: int) -> list[Pack]:
    """Files (path, bytes) in shares of `split` bytes each, or of more where that would make more than MAX_SHARES tasks, so that tasks don't
    grow in number with the files but in bytes, up to SPLIT_BYTES. Small files are read by one task together then."""
    fine = sum(max(1, -(-size // split)) for _, size in found)
    if fine <= MAX_SHARES:
        return [Pack([Share(path, k, n)]) for path, size in found for n in (max(1, -(-size // split)),) for k in range(n)]
    each = max(split, min(SPLIT_BYTES, -(-sum(size + OPENING_BYTES for _, size in found) // MAX_SHARES)))
    out: list[Pack] = []
    load = each
    for path, size in found:
        n = max(1, -(-size // each))
        for k in range(n):
            weight = size // n + OPENING_BYTES
            if load + weight > each:
                out.append(Pack([]))
                load = 0
            out[-1].shares.append(Share(path, k, n))
            load += weight
    return out


class _Files(DataSourceReader):
    """A reader of files that are split by size."""

    endings: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        return packed(files.listed(self.path, *self.endings), self.split) or [Pack([])]

    def read(self, partition: Pack) -> Iterator:
        for share in partition.shares:
            yield from self.rows(share)

    def rows(self, share: Share) -> Iterator:
        """The rows of a part of a file."""
        raise NotImplementedError


class FloatRasterReader(_Files):
    endings = (".tif", ".tiff")

    def rows(self, share: Share) -> Iterator[pa.RecordBatch]:
        fetch = files.ranges(share.path)
        tags = binary.read_tags(fetch)
        w, h, at, no_data = binary.raster_shape(tags)
        first, last = share.of(h)
        step = max(1, BATCH // max(1, w))
        for y0 in range(first, last, step):
            rows = min(step, last - y0)
            values = np.frombuffer(fetch(at + y0 * w * 4, rows * w * 4), "<f4")
            y, x = np.divmod(np.arange(len(values)), w)
            keep = np.ones(len(values), bool) if no_data is None else values != np.float32(no_data)
            columns = [pa.array([share.path] * int(keep.sum())), pa.array(x[keep].astype(np.int32)), pa.array((y[keep] + y0).astype(np.int32)), pa.array(values[keep].astype(np.float32))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "x", "y", "value"])


class FloatRaster(DataSource):
    """(path, x, y, value) of single-strip 32-bit rasters; no-data pixels go."""

    @classmethod
    def name(cls) -> str:
        return "float_raster"

    def schema(self) -> str:
        return "path string, x int, y int, value float"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FloatRasterReader(self.options)


class RasterHeadReader(_Files):
    endings = (".tif", ".tiff")

    def partitions(self) -> list[InputPartition]:
        return packed([(path, 0) for path, _ in files.listed(self.path, *self.endings)], self.split) or [Pack([])]

    def rows(self, share: Share) -> Iterator[pa.RecordBatch]:
        tags = binary.read_tags(files.ranges(share.path))
        w, h, _, _ = binary.raster_shape(tags)
        ref = binary.georeference(tags, w, h)
        row = {"path": share.path, "width": w, "height": h, **{k: ref[k] for k in ("west", "north", "east", "south", "gsd_m", "no_data")}}
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


class RasterHeads(DataSource):
    """Bounds and ground size of rasters, from their headers alone."""

    @classmethod
    def name(cls) -> str:
        return "raster_heads"

    def schema(self) -> str:
        return "path string, width int, height int, west double, north double, east double, south double, gsd_m double, no_data double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RasterHeadReader(self.options)


class PolygonReader(_Files):
    endings = (".shp",)

    def rows(self, share: Share) -> Iterator[tuple]:
        fetch = files.ranges(share.path)
        index = files.ranges(share.path[:-1] + "x")
        size = struct.unpack(">i", index(24, 4))[0] * 2
        first, last = share.of((size - 100) // 8)
        for k in range(first, last):
            at, length = (v * 2 for v in struct.unpack(">2i", index(100 + 8 * k, 8)))
            body = fetch(at + 8, length)
            if len(body) < 44 or struct.unpack_from("<i", body)[0] != 5:
                continue
            parts, points = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
            xy = np.frombuffer(body, "<f8", points * 2, 44 + 4 * parts).reshape(-1, 2).tolist()
            for p in range(parts):
                yield share.path, k, p, [(lat, lng) for lng, lat in xy[starts[p] : starts[p + 1]]]


class Polygons(DataSource):
    """(path, record, part, ring) of polygon files, split by their index; records of other kinds go."""

    @classmethod
    def name(cls) -> str:
        return "polygon_file"

    def schema(self) -> str:
        return "path string, record int, part int, ring array<struct<lat:double,lng:double>>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PolygonReader(self.options)


class AttributeReader(_Files):
    endings = (".dbf",)

    def rows(self, share: Share) -> Iterator[tuple]:
        fetch = files.ranges(share.path)
        n, head, record, fields = binary.table_head(fetch)
        first, last = share.of(n)
        step = max(1, (1 << 20) // record)
        for at in range(first, last, step):
            rows = min(step, last - at)
            raw = fetch(head + at * record, rows * record)
            for i in range(rows):
                place, row = i * record, []
                if raw[place : place + 1] == b"*":  # deleted
                    continue
                place += 1
                for _, kind, width in fields:
                    text = raw[place : place + width].decode("ascii", "replace").strip()
                    row.append((float(text) if text else None) if kind == "N" else text)
                    place += width
                yield share.path, at + i, *row


class Attributes(DataSource):
    """(path, record, the file's fields) of attribute tables; numbers are doubles. The fields are those of the first file."""

    @classmethod
    def name(cls) -> str:
        return "attribute_table"

    def schema(self) -> str:
        found = files.listed(self.options["path"], ".dbf")
        fields = binary.table_head(files.ranges(found[0][0]))[3] if found else []
        return ", ".join(["path string", "record int", *(f"`{name}` {'double' if kind == 'N' else 'string'}" for name, kind, _ in fields)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return AttributeReader(self.options)


class Tile(InputPartition):
    def __init__(self, x: int, y: int):
        self.x, self.y = x, y


def tile_range(north: float, south: float, east: float, west: float, zoom: int) -> tuple[int, int, int, int]:
    """(first x, last x, first y, last y) of the tiles over a box."""
    x = lambda lng: math.floor((lng + 180) / 360 * 2**zoom)
    y = lambda lat: math.floor((1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2 * 2**zoom)
    return x(west), x(east), y(north), y(south)


class MosaicReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.zoom = options["path"].rstrip("/"), int(options["zoom"])
        self.range = tile_range(*(float(options[k]) for k in ("north", "south", "east", "west")), self.zoom)
        x0, x1, y0, y1 = self.range
        if (x1 - x0 + 1) * (y1 - y0 + 1) > int(options.get("maxTiles", MAX_TILES)):
            raise ValueError(f"more than {options.get('maxTiles', MAX_TILES)} tiles; take a lower zoom")

    def partitions(self) -> list[InputPartition]:
        x0, x1, y0, y1 = self.range
        return [Tile(x, y) for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)]

    def read(self, partition: Tile) -> Iterator[pa.RecordBatch]:
        path = f"{self.path}/{self.zoom}/{partition.x}/{partition.y}.png"
        names = ["tile_x", "tile_y", "x", "y", "r", "g", "b", "a"]
        try:
            pixels = png.decode(files.ranges(path)(0, 64 << 20))
            if pixels.shape[:2] != (TILE, TILE):
                raise ValueError("a tile of another size")
        except (OSError, ValueError):
            row = [partition.x, partition.y, *[None] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in row], names=names)
            return
        y, x = np.divmod(np.arange(TILE * TILE, dtype=np.int32), TILE)
        own = [np.full(len(x), partition.x, np.int32), np.full(len(x), partition.y, np.int32)]
        place = [x + (partition.x - self.range[0]) * TILE, y + (partition.y - self.range[2]) * TILE]
        colours = [pixels[..., c].ravel().astype(np.int32) for c in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (*own, *place, *colours)], names=names)


class TileMosaic(DataSource):
    """(tile_x, tile_y, x, y, r, g, b, a): the tiles {zoom}/{x}/{y}.png over a box (options north, south, east, west, zoom) as one raster.

    A tile that can't be read is a hole: one row with its place and nothing else. The raster begins at the first tile's corner.
    """

    @classmethod
    def name(cls) -> str:
        return "tile_mosaic"

    def schema(self) -> str:
        return "tile_x int, tile_y int, x int, y int, r int, g int, b int, a int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MosaicReader(self.options)


def mosaic_summary(mosaic: DataFrame) -> DataFrame:
    """One row: tiles, those that are holes, and pixels with imagery (alpha above 0)."""
    tile = F.struct("tile_x", "tile_y")
    return mosaic.agg(F.count_distinct(tile).alias("tiles"), F.count_if(F.col("x").isNull()).alias("missing_tiles"), F.count_if(F.col("a") > 0).alias("imagery"))


@dataclass
class Staged(WriterCommitMessage):
    """What a task has put aside: staging name and key of each object."""

    objects: list[tuple[str, str]] = field(default_factory=list)


class ObjectWriter(DataSourceWriter):
    """Objects are put aside under new names and get theirs when all tasks have succeeded, so a task that fails or runs twice leaves nothing."""

    def __init__(self, options: dict):
        self.path, self.upsert = options["path"].rstrip("/"), str(options.get("upsert", "false")).lower() == "true"
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, top = files.opened(self.staging)
        system.create_dir(top, recursive=True)
        out = Staged()
        for row in rows:
            key = row["key"]
            if key is None or key.startswith("/") or ".." in key.split("/"):
                raise ValueError(f"no key of an object: {key}")
            if not self.upsert and files.exists(f"{self.path}/{key}"):
                raise ValueError(f"an object of this key exists: {key}")
            name = uuid.uuid4().hex
            with system.open_output_stream(f"{top}/{name}") as f:
                f.write(bytes(row["content"] or b""))
            out.objects.append((name, key))
        return out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        staged = [o for m in messages if m is not None for o in m.objects]
        try:
            keys = [key for _, key in staged]
            if len(set(keys)) < len(keys):
                raise ValueError("two objects of one key in one write")
            system, top = files.opened(self.path)
            aside = files.opened(self.staging)[1]
            with ThreadPoolExecutor(COMMITS) as pool:
                there = pool.map(lambda k: files.exists(f"{self.path}/{k}"), () if self.upsert else keys)
                if old := next((k for k, found in zip(keys, there) if found), None):  # noqa: B905
                    raise ValueError(f"an object of this key exists: {old}")
                for folder in sorted({f"{top}/{key}".rsplit("/", 1)[0] for key in keys}):
                    system.create_dir(folder, recursive=True)
                list(pool.map(lambda o: system.move(f"{aside}/{o[0]}", f"{top}/{o[1]}"), staged))
        finally:
            self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, top = files.opened(self.staging)
        if system.get_file_info(top).type.name != "NotFound":
            system.delete_dir(top)


class ObjectStore(DataSource):
    """A sink of (key string, content binary): one object a row under the path. Option `upsert` replaces objects; without it a key that exists, or a key
    that comes twice, fails the whole write. The driver gets one message a task, with the keys."""

    @classmethod
    def name(cls) -> str:
        return "object_store"

    def schema(self) -> str:
        return "key string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ObjectWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the sources and the sink known to a session."""
    for source in (FloatRaster, RasterHeads, Polygons, Attributes, TileMosaic, ObjectStore):
        spark.dataSource.register(source)


def put_objects(objects: DataFrame, folder: str, upsert: bool = False) -> None:
    """Store (key, content) rows as objects."""
    register(objects.sparkSession)
    objects.select("key", "content").write.format("object_store").option("upsert", str(upsert).lower()).mode("append").save(folder)


def bake_tiles(pixels: DataFrame, *owner: str) -> DataFrame:
    """(key, content): image tiles of pixels (owner, z, tile_x, tile_y, x, y, r, g, b, a), x and y counted in the tile; missing pixels are clear.

    The key is owner/z/x/y.png. A tile has 65,536 pixels at most, and so has a group; where two rows give one pixel, that with the largest values counts.
    """

    def render(key: tuple, table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in ("x", "y", "r", "g", "b", "a")]
        order = np.lexsort(columns[::-1])
        x, y, *colours = (c[order].astype(np.int64) for c in columns)
        image = np.zeros((TILE, TILE, 4), np.uint8)
        image[y, x] = np.stack(colours, axis=1)
        z, tx, ty = (k.as_py() for k in key[-3:])
        name = "/".join([*(str(k.as_py()) for k in key[:-3]), str(z), str(tx), f"{ty}.png"])
        return pa.table({"key": [name], "content": pa.array([png.encode(image)], pa.binary())})

    by = [*owner, "z", "tile_x", "tile_y"]
    distinct = pixels.select(*by, "x", "y", "r", "g", "b", "a").distinct()
    return distinct.groupBy(*by).applyInArrow(render, "key string, content binary")


def archive_reports(reports: DataFrame, folder: str, archive: str) -> DataFrame:
    """Store reports (user_id, field_id, scan_id, made_at timestamp, summary struct, content binary) and append their rows to the archive; the new rows.

    An object's key is user/field/scan/milliseconds.pdf and never replaces another. Rows are appended after the objects, so a row always has its object.
    """
    key = F.concat_ws("/", "user_id", "field_id", "scan_id", F.concat(F.unix_millis("made_at").cast("string"), F.lit(".pdf")))
    rows = reports.withColumn("storage_path", key)
    put_objects(rows.select(F.col("storage_path").alias("key"), "content"), folder)
    new = rows.select("user_id", "field_id", "scan_id", "made_at", "storage_path", F.to_json("summary").alias("summary"))
    new.write.mode("append").parquet(archive)
    return new


def store_forecasts(forecasts: DataFrame, folder: str) -> None:
    """Write forecasts (lat, lng, saved_at timestamp, data struct) to their cache objects, one a rounded place; a later one replaces the earlier.

    Within one write the latest of a place counts. `cached_forecasts` reads them.
    """
    number = lambda c: F.format_string("%.3f", F.col(c).cast("double"))
    body = F.to_json(F.struct(F.unix_millis("saved_at").alias("savedAt"), "data"))
    rows = forecasts.select(F.concat(F.lit("forecast/"), number("lat"), F.lit(","), number("lng"), F.lit(".json")).alias("key"), F.struct("saved_at", body.alias("body")).alias("v"))
    put_objects(rows.groupBy("key").agg(F.max("v.saved_at").alias("t"), F.max_by("v.body", "v.saved_at").alias("body")).select("key", F.col("body").cast("binary").alias("content")), folder, upsert=True)


def cached_forecasts(spark: SparkSession, folder: str, data_schema: str, now: object, ttl_minutes: int = 20) -> DataFrame:
    """(key, saved_at, data) of the cache's forecasts that are still fresh; what can't be read is left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(f"{folder}/forecast")
    parsed = raw.select(F.element_at(F.split("path", "/"), -1).alias("key"), F.from_json(F.decode("content", "utf-8"), f"savedAt long, data {data_schema}").alias("j"))
    saved = F.timestamp_millis("j.savedAt")
    fresh = parsed.select("key", saved.alias("saved_at"), "j.data").filter(F.col("data").isNotNull() & (F.lit(now) - F.col("saved_at") <= F.make_dt_interval(mins=F.lit(ttl_minutes))))
    return fresh
