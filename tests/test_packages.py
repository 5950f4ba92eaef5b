"""Packages: routes and prescriptions from tables, and what their read-back tells."""

import io
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from furrow.sources import binary, packages


@pytest.fixture(scope="module")
def points(spark):
    rows = [(m, i, 41 + i / 1000, -93 - i / 900, 3.5 + i, float(i)) for m, n in (("a", 3), ("b", 201), ("c", 200)) for i in range(n)]
    return spark.createDataFrame(rows, "mission string, seq int, lat double, lng double, alt double, speed double").repartition(3)


def members(raw):
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return {n: z.read(n) for n in z.namelist()}


def test_routes(points):
    settings = packages.RouteSettings(author="a <b>", created_ms=5, transit_speed=99, climb_m=0.5, drone=(1, 2), payload=(3, 4))
    got = {r.mission: r for r in packages.route_packages(points, "mission", settings, {"/photo.txt": b"p"}).collect()}
    assert got["b"].content is None and "201 waypoints" in got["b"].problem and got["c"].waypoints == 200
    held = members(got["a"].content)
    assert list(held) == [packages.TEMPLATE, packages.WAYLINES, "wpmz/res/photo.txt"] and held[packages.TEMPLATE] != held[packages.WAYLINES]
    k, w = f"{{{packages.KML}}}", f"{{{packages.WPML}}}"
    for name in (packages.TEMPLATE, packages.WAYLINES):
        root = ET.fromstring(held[name])
        assert root.tag == f"{k}kml"
        (config,) = root.iter(f"{w}missionConfig")
        read = {e.tag.removeprefix(w): e.text for e in config}
        assert read["takeOffSecurityHeight"] == "1.2" and read["globalTransitionalSpeed"] == "15.0" and read["executeRCLostAction"] == "goBack"
        marks = list(root.iter(f"{k}Placemark"))
        assert [m.find(f"{w}index").text for m in marks] == ["0", "1", "2"]
        assert marks[1].find(f"{k}Point/{k}coordinates").text == "-93.00111111,41.00100000"
        assert marks[1].find(f"{w}{'executeHeight' if name == packages.WAYLINES else 'height'}").text == "4.50"
    template, waylines = ET.fromstring(held[packages.TEMPLATE]), ET.fromstring(held[packages.WAYLINES])
    assert next(template.iter(f"{w}author")).text == "a <b>" and not list(waylines.iter(f"{w}author"))
    assert [e.text for e in waylines.iter(f"{w}waypointSpeed")] == ["0.0", "1.0", "2.0"]
    calm = packages.route_documents(points, "mission", packages.RouteSettings(on_signal_lost="goContinue")).filter("mission = 'a'").first()
    assert "executeRCLostAction" not in calm.template + calm.waylines and "droneInfo" not in calm.template


def test_routes_are_read_back(spark, points):
    made = packages.route_packages(points, "mission").filter("content IS NOT NULL").select("mission", "content")
    fine = {r.mission: r.problems for r in packages.verify_routes(made, points.filter("mission <> 'b'"), "mission").collect()}
    assert fine == {"a": [], "c": []}
    other = points.filter("mission = 'a'").withColumn("lat", F.when(F.col("seq") == 1, F.col("lat") + 1e-4).otherwise(F.col("lat")))
    more = other.unionByName(other.filter("seq = 2").withColumn("seq", F.lit(3)))
    told = packages.verify_routes(made.filter("mission = 'a'"), more, "mission").first().problems
    assert told == ["2 missing", "2 moved"]


GRID = [(1, 41.0, -93.0, 0.0001, 0.0001, 20, 10), (2, 41.0, -93.0, 0.0001, 0.0001, 20, 10)]


@pytest.fixture(scope="module")
def field(spark):
    box = lambda s, w, n, e: [(s, w), (s, e), (n, e), (n, w)]
    ring = "array<struct<lat:double,lng:double>>"
    grids = spark.createDataFrame(GRID, "f int, origin_lat double, origin_lng double, pixel_lat double, pixel_lng double, width int, height int")
    fences = spark.createDataFrame([(1, box(40.9992, -92.9998, 40.9998, -92.9982)), (2, box(40.9992, -92.9998, 40.9998, -92.9982))], f"f int, ring {ring}")
    zones = spark.createDataFrame([(1, 20.0, box(40.9990, -92.9996, 40.9995, -92.9990)), (1, 30.0, box(40.9993, -92.9994, 40.9996, -92.9985)), (1, 0.0, box(40.9992, -92.9998, 40.9998, -92.9982)), (2, 0.0, box(40.9992, -92.9998, 40.9998, -92.9982))], f"f int, rate_lha double, ring {ring}")
    return grids, zones, fences


@pytest.mark.parametrize("nodata", [False, True])
def test_prescriptions(spark, field, nodata):
    grids, zones, fences = field
    made = {r.f: r for r in packages.prescription_packages(grids, zones, fences, "f", nodata).collect()}
    assert made[2].content is None and made[2].problems == ["no pixel is treated"]
    held = members(made[1].content)
    assert set(held) == {f"{packages.BOUNDARY}.{e}" for e in ("shp", "shx", "dbf", "prj")} | {f"{packages.RX}.tif", f"{packages.RX}.tfw"}
    values, ref = binary.read_geotiff(held[f"{packages.RX}.tif"])
    # the fence is 6 x 16 pixels; zones take their part of it, the higher rate where they meet
    want = {(y, x): 20.0 for y in range(5, 8) for x in range(4, 10)} | {(y, x): 30.0 for y in range(4, 7) for x in range(6, 15)}
    assert {(int(y), int(x)): float(values[y, x]) for y, x in zip(*(values > 0).nonzero(), strict=True)} == want
    assert made[1].treated == len(want) and made[1].no_data == (200 - 96 if nodata else 0) and ref["no_data"] == (-9999.0 if nodata else None)
    assert binary.read_dbf(held[f"{packages.BOUNDARY}.dbf"])[0]["TYPE"] == "boundary"


def test_prescriptions_are_read_back(spark, field):
    grids, zones, fences = field
    good = packages.prescription_packages(grids, zones, fences, "f").filter("f = 1").select("f", "content").first().content
    held = members(good)
    shifted = binary.write_geotiff(binary.read_geotiff(held[f"{packages.RX}.tif"])[0], -80.0, 30.0, 0.0001, 0.0001)
    shp, shx, dbf = binary.write_shapefile([(ring[:-1] - ring[0]) * [1, 1.05] + ring[0] for ring in binary.read_shapefile(held[f"{packages.BOUNDARY}.shp"])], [{"ID": 1.0}, {"ID": 2.0}])
    cases = {
        "good": good, "none": None, "broken": b"no archive", "beside": packages.zipped(held | {f"{packages.RX}.tif": shifted}),
        "drifted": packages.zipped(held | {f"{packages.BOUNDARY}.shp": shp, f"{packages.BOUNDARY}.dbf": dbf}), "lacking": packages.zipped({k: v for k, v in held.items() if not k.endswith("tfw")}),
    }
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in cases.items()], "f string, content binary")
    own = fences.filter("f = 1").select("ring").crossJoin(df.select("f"))
    got = {r.f: r.problems for r in packages.verify_prescriptions(df, own, "f").collect()}
    every = ", ".join(f"{packages.BOUNDARY}.{e}" for e in ("shp", "shx", "dbf")) + f", {packages.RX}.tif, {packages.RX}.tfw"
    assert got == {
        "good": [], "none": [f"missing: {every}"], "broken": [f"missing: {every}"], "beside": ["the raster lies beside the boundary"],
        "drifted": ["another number of attribute rows", "the boundary's area drifted"], "lacking": [f"missing: {packages.RX}.tfw"],
    }


def test_formats_on_offer():
    assert packages.shipping_formats() == ["waypoints", "route", "prescription"]
