"""Packages of tables: rasters, polygon files, prescriptions and routes as rows of (key, content), and their read-back.

One row is one field's or mission's package, which its format bounds in size; packages are built where their rows lie and stored by the object store. What
is wrong with one is told in its row and stops none of the others.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import geo
from furrow.operators import rasters
from furrow.session import ensure_checkpoint_dir
from furrow.sources import binary
from furrow.sources.sinks import waypoint_text

#: Points that a route may have, and the share by which a boundary's area may drift. Fixed values.
MAX_WAYPOINTS, AREA_DRIFT = 200, 0.005
#: Members of a prescription. Fixed values of the controller's format.
BOUNDARY, RX = "DJI/Shapefile/boundary", "DJI/Rx/rx"
#: Namespaces and members of a route, and the most speed in m/s that it holds. Fixed values of the format.
KML, WPML = "http://www.opengis.net/kml/2.2", "http://www.dji.com/wpmz/1.0.2"
TEMPLATE, WAYLINES = "wpmz/template.kml", "wpmz/waylines.wpml"
MAX_SPEED, MIN_CLIMB, MAX_CLIMB = 15.0, 1.2, 1500.0
#: The geographic reference of boundaries. Fixed value.
PRJ = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'


def zipped(members: dict[str, bytes]) -> bytes:
    """An archive whose bytes depend on its members only."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def raster_files(pixels: DataFrame, grids: DataFrame, field: str, no_data: float | None = None) -> DataFrame:
    """(field, content): each field's pixels (field, y, x, rate) as a float raster; pixels that it lacks are no data, or 0 if there is no such value.

    `grids` holds (field, origin_lat, origin_lng, pixel_lat, pixel_lng, width, height).
    """
    kind = grids.schema[field].dataType.simpleString()
    size = F.col("width").cast("long") * F.col("height")
    g = grids.withColumn("height", F.when(size <= rasters.MAX_PIXELS, F.col("height")).otherwise(F.raise_error(F.lit("a raster has too many pixels")).cast("int")))
    row = F.array_sort(F.collect_list(F.struct("x", "rate")))
    lines = pixels.groupBy(field, "y").agg(row.alias("row")).join(g, field)

    def write(key: tuple, table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        values = np.full((first["height"], first["width"]), 0.0 if no_data is None else no_data, np.float32)
        for y, row in zip(table.column("y").to_pylist(), table.column("row").to_pylist(), strict=True):
            values[y, [p["x"] for p in row]] = [p["rate"] for p in row]
        raw = binary.write_geotiff(values, first["origin_lng"], first["origin_lat"], first["pixel_lng"], first["pixel_lat"], no_data)
        return pa.table({field: pa.array([key[0].as_py()], table.schema.field(field).type), "content": pa.array([raw], pa.binary())})

    return lines.groupBy(field).applyInArrow(write, f"{field} {kind}, content binary")


def polygon_files(zones: DataFrame, field: str, record: str, *attributes: str) -> DataFrame:
    """(field, shp, shx, dbf): each field's rings (field, record, ring, attributes) as a polygon file in the order of `record`.

    `record` is a number, a text or a struct of such. Rings of fewer than three points go.
    """
    kind = zones.schema[field].dataType.simpleString()

    def write(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: tuple(r[record].values()) if isinstance(r[record], dict) else r[record])
        rings = [np.array([(p["lng"], p["lat"]) for p in r["ring"]], float) for r in rows]
        shp, shx, dbf = binary.write_shapefile(rings, [{a: r[a] for a in attributes} for r in rows])
        return pa.table({field: pa.array([key[0].as_py()], table.schema.field(field).type), **{n: pa.array([v], pa.binary()) for n, v in (("shp", shp), ("shx", shx), ("dbf", dbf))}})

    whole = zones.filter(F.size("ring") >= 3).select(field, *dict.fromkeys([record, "ring", *attributes]))
    return whole.groupBy(field).applyInArrow(write, f"{field} {kind}, shp binary, shx binary, dbf binary")


def prescription_packages(grids: DataFrame, zones: DataFrame, boundaries: DataFrame, field: str, nodata_outside: bool = False) -> DataFrame:
    """(field, content, treated, untreated, no_data, problems): a prescription a field, its raster, world file and boundary in one archive.

    A field without a treated pixel has no content and says so. `verify_prescriptions` reads the archives back.
    """
    ensure_checkpoint_dir(grids.sparkSession)
    pixels = rasters.burn_zones(grids, zones, boundaries, field, nodata_outside).checkpoint()
    counts = rasters.raster_summary(pixels, field)
    files = raster_files(pixels, grids, field, rasters.NODATA if nodata_outside else None)
    nth = F.row_number().over(Window.partitionBy(field).orderBy("ring")) - 1
    numbered = boundaries.select(field, "ring", nth.alias("ID"), F.lit("boundary").alias("TYPE"), (geo.ring_area(F.col("ring")) / 10_000).alias("AREA_HA"))
    shapes = polygon_files(numbered, field, "ID", "ID", "TYPE", "AREA_HA")
    joined = files.join(counts, field).join(shapes, field, "left").join(grids.select(field, "origin_lat", "origin_lng", "pixel_lat", "pixel_lng"), field)
    kind = grids.schema[field].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                problems = ["no pixel is treated"] if not r["treated"] else ["the field has no boundary"] if r["shp"] is None else []
                members = {f"{BOUNDARY}.{e}": r[e] for e in ("shp", "shx", "dbf")} | {f"{BOUNDARY}.prj": PRJ.encode(), f"{RX}.tif": r["content"]}
                members[f"{RX}.tfw"] = binary.world_file(r["origin_lng"], r["origin_lat"], r["pixel_lng"], r["pixel_lat"]).encode()
                out.append({field: r[field], "content": None if problems else zipped(members), "treated": r["treated"], "untreated": r["untreated"], "no_data": r["no_data"], "problems": problems})
            schema = pa.schema([batch.schema.field(field), ("content", pa.binary()), *((n, pa.int64()) for n in ("treated", "untreated", "no_data")), ("problems", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(out, schema)

    return joined.mapInArrow(pack, f"{field} {kind}, content binary, treated long, untreated long, no_data long, problems array<string>")


def verify_prescriptions(packages: DataFrame, boundaries: DataFrame, field: str) -> DataFrame:
    """(field, problems): what reading each package (field, content) back finds wrong.

    A member that is missing, another number of boundary parts or attribute rows, an area that drifted by more than half a hundredth, an open ring, a raster that
    lies beside the boundary, or one without a treated pixel.
    """
    kind = packages.schema[field].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                row = {field: r[field], "missing": [], "rings": [], "rows": 0, "box": None, "treated": 0}
                try:
                    with zipfile.ZipFile(io.BytesIO(r["content"] or b"")) as z:
                        held = {n: z.read(n) for n in z.namelist()}
                except zipfile.BadZipFile:
                    held = {}
                row["missing"] = [n for n in (f"{BOUNDARY}.shp", f"{BOUNDARY}.shx", f"{BOUNDARY}.dbf", f"{RX}.tif", f"{RX}.tfw") if n not in held]
                if not row["missing"]:
                    values, ref = binary.read_geotiff(held[f"{RX}.tif"])
                    row["rings"] = [[{"lat": y, "lng": x} for x, y in ring.tolist()] for ring in binary.read_shapefile(held[f"{BOUNDARY}.shp"])]
                    row["rows"] = len(binary.read_dbf(held[f"{BOUNDARY}.dbf"]))
                    row["box"] = {k: ref[k] for k in ("south", "west", "north", "east")}
                    row["treated"] = int((values > 0).sum())
                out.append(row)
            point = pa.struct([("lat", pa.float64()), ("lng", pa.float64())])
            box = pa.struct([(k, pa.float64()) for k in ("south", "west", "north", "east")])
            schema = pa.schema([batch.schema.field(field), ("missing", pa.list_(pa.string())), ("rings", pa.list_(pa.list_(point))), ("rows", pa.int32()), ("box", box), ("treated", pa.int64())])
            yield pa.RecordBatch.from_pylist(out, schema)

    point = "array<array<struct<lat:double,lng:double>>>"
    back = packages.select(field, "content").mapInArrow(read, f"{field} {kind}, missing array<string>, rings {point}, rows int, box struct<south:double,west:double,north:double,east:double>, treated long")
    f = geo.footprint(F.col("ring"))
    whole = boundaries.filter(F.size("ring") >= 3).groupBy(field).agg(
        F.count("*").alias("parts"), F.sum(geo.ring_area(F.col("ring"))).alias("area"), F.min(f["south"]).alias("s"), F.min(f["west"]).alias("w"), F.max(f["north"]).alias("n"), F.max(f["east"]).alias("e")
    )
    j = back.join(whole, field, "left")
    area = geo.rings_area(F.col("rings"))
    ends = F.exists("rings", lambda r: F.element_at(r, 1) != F.element_at(r, -1))
    apart = ~geo.bounds_overlap(F.col("n"), F.col("s"), F.col("e"), F.col("w"), F.col("box.north"), F.col("box.south"), F.col("box.east"), F.col("box.west"))
    found = [
        F.when(F.size("missing") > 0, F.concat(F.lit("missing: "), F.array_join("missing", ", "))),
        F.when((F.size("missing") == 0) & (F.size("rings") != F.coalesce("parts", F.lit(0))), F.lit("another number of boundary parts")),
        F.when((F.size("missing") == 0) & (F.col("rows") != F.size("rings")), F.lit("another number of attribute rows")),
        F.when((F.size("missing") == 0) & (F.abs(area - F.col("area")) > AREA_DRIFT * F.col("area")), F.lit("the boundary's area drifted")),
        F.when(ends, F.lit("the boundary is open")),
        F.when(apart, F.lit("the raster lies beside the boundary")),
        F.when((F.size("missing") == 0) & (F.col("treated") == 0), F.lit("no pixel is treated")),
    ]
    return j.select(field, F.filter(F.array(*found), lambda p: p.isNotNull()).alias("problems"))


@dataclass(frozen=True)
class RouteSettings:
    """What a route says besides its points."""

    author: str = "furrow"
    created_ms: int = 0
    transit_speed: float = 10.0
    flight_speed: float = 5.0
    climb_m: float = 20.0
    finish: str = "goHome"
    on_signal_lost: str = "executeLostAction"
    lost_action: str = "goBack"
    drone: tuple[int, int] | None = None
    payload: tuple[int, int] | None = None


def _xml(items: list, depth: int = 0) -> str:
    """Nested (tag, value) pairs as indented elements; a value is text or again a list."""
    out = []
    for tag, value in items:
        pad = "  " * depth
        if isinstance(value, list):
            out.append(f"{pad}<{tag}>\n{_xml(value, depth + 1)}\n{pad}</{tag.split(' ')[0]}>")
        else:
            out.append(f"{pad}<{tag}>{value}</{tag}>")
    return "\n".join(out)


def _frame(s: RouteSettings, waylines: bool) -> tuple[str, str]:
    """What stands before and behind the placemarks of a member."""
    number = lambda v, low, high: f"{min(high, max(low, v)):.1f}"
    config = [("wpml:flyToWaylineMode", "safely"), ("wpml:finishAction", s.finish), ("wpml:exitOnRCLost", s.on_signal_lost)]
    if s.on_signal_lost == "executeLostAction":  # beside going on there is no such action
        config.append(("wpml:executeRCLostAction", s.lost_action))
    config += [("wpml:takeOffSecurityHeight", number(s.climb_m, MIN_CLIMB, MAX_CLIMB)), ("wpml:globalTransitionalSpeed", number(s.transit_speed, 0, MAX_SPEED))]
    if s.drone:
        config.append(("wpml:droneInfo", [("wpml:droneEnumValue", s.drone[0]), ("wpml:droneSubEnumValue", s.drone[1])]))
    if s.payload:
        config.append(("wpml:payloadInfo", [("wpml:payloadEnumValue", s.payload[0]), ("wpml:payloadPositionIndex", s.payload[1])]))
    speed = ("wpml:autoFlightSpeed", number(s.flight_speed, 0, MAX_SPEED))
    if waylines:
        head, folder = [], [("wpml:templateId", 0), ("wpml:executeHeightMode", "relativeToStartPoint"), ("wpml:waylineId", 0), speed]
    else:
        head = [("wpml:author", escape(s.author)), ("wpml:createTime", s.created_ms), ("wpml:updateTime", s.created_ms)]
        reference = [("wpml:coordinateMode", "WGS84"), ("wpml:heightMode", "relativeToStartPoint"), ("wpml:positioningType", "GPS")]
        stop = ("wpml:globalWaypointTurnMode", "toPointAndStopWithDiscontinuityCurvature")
        folder = [("wpml:templateType", "waypoint"), ("wpml:templateId", 0), ("wpml:waylineCoordinateSysParam", reference), speed, stop, ("wpml:globalUseStraightLine", 1)]
    mark = "@"
    whole = _xml([(f'kml xmlns="{KML}" xmlns:wpml="{WPML}"', [("Document", [*head, ("wpml:missionConfig", config), ("Folder", [*folder, ("placemarks", mark)])])])])
    before, after = whole.split(f"      <placemarks>{mark}</placemarks>\n")
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + before, after + "\n"


def _placemark(waylines: bool) -> Column:
    """One point as an element, from lat, lng, alt, speed and seq."""
    fixed = lambda c, digits: F.format_string(f"%.{digits}f", c.cast("double"))
    point = F.concat(F.lit("<Point><coordinates>"), fixed(F.col("lng"), 8), F.lit(","), fixed(F.col("lat"), 8), F.lit("</coordinates></Point>"))
    tag = lambda name, value: F.concat(F.lit(f"<wpml:{name}>"), value, F.lit(f"</wpml:{name}>"))
    inner = [point, tag("index", F.col("seq").cast("string"))]
    if waylines:
        speed = F.greatest(F.lit(0.0), F.least(F.lit(MAX_SPEED), F.col("speed").cast("double")))
        heading, turn = tag("waypointHeadingMode", F.lit("followWayline")), tag("waypointTurnMode", F.lit("toPointAndStopWithDiscontinuityCurvature"))
        inner += [tag("executeHeight", fixed(F.col("alt"), 2)), tag("waypointSpeed", fixed(speed, 1)), tag("waypointHeadingParam", heading), tag("waypointTurnParam", F.concat(turn, tag("waypointTurnDampingDist", F.lit("0"))))]
    else:
        flags = [tag(n, F.lit(v)) for n, v in (("useGlobalHeight", "0"), ("useGlobalSpeed", "1"), ("useGlobalHeadingParam", "1"), ("useGlobalTurnParam", "1"), ("gimbalPitchAngle", "0"))]
        inner += [tag("height", fixed(F.col("alt"), 2)), *flags]
    return F.concat(F.lit("      <Placemark>"), *inner, F.lit("</Placemark>\n"))


def route_documents(points: DataFrame, mission: str, settings: RouteSettings = RouteSettings()) -> DataFrame:
    """(mission, waypoints, template, waylines): the two members of each mission's route, from points (mission, seq from 0, lat, lng, alt, speed).

    A mission of more points than the format holds has no texts.
    """
    marks = points.select(mission, "seq", _placemark(False).alias("t"), _placemark(True).alias("w"))
    rows = F.array_sort(F.collect_list(F.struct("seq", "t", "w")))
    g = marks.groupBy(mission).agg(F.count("*").alias("waypoints"), F.when(F.count("*") <= MAX_WAYPOINTS, rows).alias("rows"))
    text = lambda k, frame: F.when(F.col("rows").isNotNull(), F.concat(F.lit(frame[0]), F.array_join(F.transform("rows", lambda r: r[k]), ""), F.lit(frame[1])))
    return g.select(mission, "waypoints", text("t", _frame(settings, False)).alias("template"), text("w", _frame(settings, True)).alias("waylines"))


def route_packages(points: DataFrame, mission: str, settings: RouteSettings = RouteSettings(), resources: dict[str, bytes] | None = None) -> DataFrame:
    """(mission, waypoints, content, problem): each mission's route as an archive of both members (and `resources`), without other entries."""
    extra = {f"wpmz/res/{n.lstrip('/')}": b for n, b in (resources or {}).items()}
    docs = route_documents(points, mission, settings)
    kind = points.schema[mission].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if t is None else zipped({TEMPLATE: t.encode(), WAYLINES: w.encode(), **extra}) for t, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            told = [f"{n} waypoints; the format holds {MAX_WAYPOINTS}" if m is None else None for m, n in zip(made, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary()), pa.array(told, pa.string())], names=[mission, "waypoints", "content", "problem"])

    return docs.mapInArrow(pack, f"{mission} {kind}, waypoints long, content binary, problem string")


def read_routes(packages: DataFrame, mission: str) -> DataFrame:
    """(mission, member, place, index, lng, lat, height, speed): the placemarks of the members of route archives (mission, content), in order."""
    kind = packages.schema[mission].dataType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if raw is not None:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        out += [{mission: own, "member": n, "text": z.read(n).decode()} for n in z.namelist() if n in (TEMPLATE, WAYLINES)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([batch.schema.field(0), ("member", pa.string()), ("text", pa.string())]))

    texts = packages.select(mission, "content").mapInArrow(unpack, f"{mission} {kind}, member string, text string")
    marks = texts.select(mission, "member", F.posexplode(F.regexp_extract_all("text", F.lit("<Placemark>([\\s\\S]*?)</Placemark>"), 1)).alias("place", "m"))
    part = lambda pattern, k=1: F.regexp_extract("m", pattern, k).try_cast("double")
    pair = r"<coordinates>([^,<]*),([^<]*)</coordinates>"
    return marks.select(
        mission, "member", "place", part("<wpml:index>([^<]*)<").cast("int").alias("index"), part(pair).alias("lng"), part(pair, 2).alias("lat"),
        part("<wpml:(?:executeH|h)eight>([^<]*)<").alias("height"), part("<wpml:waypointSpeed>([^<]*)<").alias("speed"),
    )


def verify_routes(packages: DataFrame, points: DataFrame, mission: str) -> DataFrame:
    """(mission, problems): what reading the archives back finds wrong against the points: placemarks too few or out of order, or places or heights that moved."""
    want = points.select(mission, F.col("seq").alias("place"), F.col("lat").alias("w_lat"), F.col("lng").alias("w_lng"), F.col("alt").alias("w_alt"), F.explode(F.array(F.lit(TEMPLATE), F.lit(WAYLINES))).alias("member"))
    j = want.join(read_routes(packages, mission), [mission, "member", "place"], "full")
    moved = (F.abs(F.col("lat") - F.col("w_lat")) > 1e-7) | (F.abs(F.col("lng") - F.col("w_lng")) > 1e-7) | (F.abs(F.col("height") - F.col("w_alt")) > 0.006)
    told = {"missing": F.col("lat").isNull(), "too many": F.col("w_lat").isNull(), "out of order": F.col("index") != F.col("place"), "moved": moved}
    counts = j.groupBy(mission).agg(*[F.count_if(c).alias(n) for n, c in told.items()])
    found = [F.when(F.col(f"`{n}`") > 0, F.concat(F.col(f"`{n}`").cast("string"), F.lit(f" {n}"))) for n in told]
    return counts.select(mission, F.filter(F.array(*found), lambda p: p.isNotNull()).alias("problems"))


#: Formats by name: whether they are offered, and what makes them.
FORMATS: dict[str, tuple[bool, Callable]] = {
    "waypoints": (True, waypoint_text),
    "route": (True, route_packages),
    "prescription": (True, prescription_packages),
    "geotiff": (False, raster_files),
}


def shipping_formats() -> list[str]:
    """Only these are offered."""
    return [name for name, (ready, _) in FORMATS.items() if ready]
