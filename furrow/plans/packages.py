"""Catalogue: files written from the tables, stored as objects, read back by the data sources, and compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators import paths
from furrow.plans.fields import _BURNT, _prescription
from furrow.sources import files, formats, packages
from furrow.session import ensure_checkpoint_dir, shuffle_width, table


def _through(spark, objects, read) -> DataFrame:
    """Rows that `read` makes of the stored objects (key, content); the objects go when the rows are checkpointed."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/objects-{uuid.uuid4().hex}"
    formats.put_objects(objects, folder)
    out = read(folder).checkpoint()
    system, top = files.opened(folder)
    system.delete_dir(top)
    return out


def _named(path: str, part: int = -1):
    return F.element_at(F.split(path, "/"), part)


def raster_round_trip(spark, sf_dir):
    """Every forty vectors as a raster, read back by rows of pixels."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 40).alias("block"), (F.col("vec_id") % 40).cast("int").alias("y"), F.posexplode("embedding").alias("x", "rate"))
    number = lambda v, k="double": F.lit(v).cast(k)
    grids = e.select("block").distinct().select("block", number(41.0).alias("origin_lat"), number(-93.0).alias("origin_lng"), number(1e-5).alias("pixel_lat"), number(1e-5).alias("pixel_lng"), number(64, "int").alias("width"), number(40, "int").alias("height"))
    made = packages.raster_files(e, grids, "block", -9999.0)
    objects = made.select(F.concat(F.col("block").cast("string"), F.lit(".tif")).alias("key"), "content")

    def read(folder):
        rows = spark.read.format("float_raster").option("splitBytes", 4096).load(folder)
        return rows.select(F.split(_named("path"), r"\.")[0].cast("long").alias("block"), "x", "y", "value")

    return _through(spark, objects, read)


def polygon_round_trip(spark, sf_dir):
    """Each nation's zones as a polygon file with attributes, read back by record."""
    _, zones, _ = _prescription(spark, sf_dir)
    numbered = zones.withColumn("lat", F.col("ring")[0]["lat"]).withColumn("at", F.struct("lat", "rate_lha"))
    made = packages.polygon_files(numbered, "n_nationkey", "at", "rate_lha", "lat")
    objects = made.select("n_nationkey", F.explode(F.create_map(F.lit("shp"), "shp", F.lit("shx"), "shx", F.lit("dbf"), "dbf")).alias("end", "content"))
    objects = objects.select(F.concat(F.col("n_nationkey").cast("string"), F.lit("."), F.col("end")).alias("key"), "content")
    nation = F.split(_named("path"), r"\.")[0].cast("int").alias("n_nationkey")

    def read(folder):
        rings = spark.read.format("polygon_file").option("splitBytes", 300).load(folder).select(nation, "record", F.size("ring").alias("points"), F.array_min("ring.lng").alias("west"))
        rows = spark.read.format("attribute_table").option("splitBytes", 200).load(folder).select(nation, "record", "rate_lha", "lat")
        return rings.join(rows, ["n_nationkey", "record"])

    return _through(spark, objects, read)


def prescription_packages(spark, sf_dir):
    """Each nation's prescription as an archive, read back and verified."""
    grids, zones, fences = _prescription(spark, sf_dir)
    made = packages.prescription_packages(grids, zones, fences, "n_nationkey").checkpoint()
    checked = packages.verify_prescriptions(made.filter("content IS NOT NULL"), fences, "n_nationkey")
    told = made.select("n_nationkey", "treated", "untreated", "no_data", F.array_join("problems", "; ").alias("problems"))
    return told.join(checked.select("n_nationkey", F.array_join("problems", "; ").alias("found")), "n_nationkey", "left")


def _route_points(spark, sf_dir):
    """Each user's events as flown points, 190 a mission, well apart."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    nth = F.row_number().over(paths.ordered("user_id", "event_id")) - 1
    e = e.withColumn("n", nth).withColumn("mission", F.concat_ws("-", "user_id", F.floor(F.col("n") / 190).cast("string")))
    return e.select("mission", (F.col("n") % 190).alias("seq"), (41 + F.col("n") / 1000 + F.col("event_id") % 7 / 1e6).alias("lat"), (-93 - F.floor("value") / 1e4).alias("lng"), (F.floor("value") % 50 + 3).cast("double").alias("alt"), (F.floor("value") % 20).cast("double").alias("speed"))


def route_round_trip(spark, sf_dir):
    """Routes as archives of two members, stored, and read back placemark by placemark."""
    made = packages.route_packages(_route_points(spark, sf_dir), "mission").filter("content IS NOT NULL")
    objects = made.select(F.concat("mission", F.lit(".kmz")).alias("key"), "content")

    def read(folder):
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.kmz").load(folder)
        raw = raw.coalesce(shuffle_width(spark, raw))  # a small file counts as 4 MB where files are dealt out, which makes very many tasks
        return packages.read_routes(raw.select(F.split(_named("path"), r"\.")[0].alias("mission"), "content"), "mission").drop("index")

    return _through(spark, objects, read)


BOX = {"north": 41.0005, "south": 40.9975, "west": -93.0025, "east": -92.9985, "zoom": 18}
X0, X1, Y0, Y1 = formats.tile_range(BOX["north"], BOX["south"], BOX["east"], BOX["west"], BOX["zoom"])
WIDE = X1 - X0 + 1
TILES = WIDE * (Y1 - Y0 + 1)


def mosaic_pixels(spark, sf_dir):
    """Events as pixels of image tiles, baked and stored, and read as one mosaic: pixels with imagery, and a row for each hole."""
    v, k = F.floor("value").cast("int"), F.col("user_id") % TILES
    e = table(spark, sf_dir, "events").filter(k % 3 != 1).select(
        F.lit(1).alias("owner"), F.lit(18).alias("z"), (X0 + k % WIDE).cast("int").alias("tile_x"), (Y0 + F.floor(k / WIDE)).cast("int").alias("tile_y"),
        (F.col("event_id") % 256).cast("int").alias("x"), (F.floor(F.col("event_id") / 256) % 256).cast("int").alias("y"), (v % 256).alias("r"), (v * 3 % 256).alias("g"), (v * 7 % 256).alias("b"), F.lit(255).alias("a"),
    )

    def read(folder):
        m = spark.read.format("tile_mosaic").options(**BOX).load(f"{folder}/1")
        return m.filter("a > 0 OR x IS NULL")

    return _through(spark, formats.bake_tiles(e, "owner"), read)


QUERIES = {f.__name__: f for f in (raster_round_trip, polygon_round_trip, prescription_packages, route_round_trip, mosaic_pixels)}
ORACLES = {
    "raster_round_trip": "SELECT CAST(floor(vec_id / 40) AS BIGINT) AS block, CAST(i - 1 AS INTEGER) AS x, CAST(vec_id % 40 AS INTEGER) AS y, embedding[i] AS value FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)",
    "polygon_round_trip": """WITH z AS (SELECT s_nationkey AS n_nationkey, 40.9987::DOUBLE - s_suppkey % 17 * 0.00013::DOUBLE AS lat, -92.9989::DOUBLE + s_suppkey % 23 * 0.00021::DOUBLE AS lng, CAST(s_suppkey % 6 * 5 AS DOUBLE) AS rate_lha FROM supplier)
        SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY lat, rate_lha) - 1 AS INTEGER) AS record, 4 AS points, lng AS west, rate_lha, round(lat, 6) AS lat FROM z""",
    "prescription_packages": f"""WITH {_BURNT}, s AS (SELECT n_nationkey, count(*) FILTER (rate > 0) AS treated, count(*) FILTER (rate <= 0) AS untreated FROM burnt GROUP BY 1)
        SELECT n_nationkey, treated, untreated, CAST(0 AS BIGINT) AS no_data, CASE WHEN treated = 0 THEN 'no pixel is treated' ELSE '' END AS problems, CASE WHEN treated > 0 THEN '' END AS found FROM s""",
    "route_round_trip": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
        p AS (SELECT user_id || '-' || CAST(floor(n / 190) AS BIGINT) AS mission, CAST(n % 190 AS INTEGER) AS place, 41 + n / 1000 + event_id % 7 / 1e6::DOUBLE AS lat, -93 - floor(value) / 1e4::DOUBLE AS lng, CAST(floor(value) % 50 + 3 AS DOUBLE) AS height, CAST(floor(value) % 20 AS DOUBLE) AS speed FROM n)
        SELECT mission, m AS member, place, CAST(printf('%.8f', lng) AS DOUBLE) AS lng, CAST(printf('%.8f', lat) AS DOUBLE) AS lat, height, CASE WHEN m = 'wpmz/waylines.wpml' THEN least(15.0::DOUBLE, speed) END AS speed FROM p, (VALUES ('wpmz/template.kml'), ('wpmz/waylines.wpml')) AS t(m)""",
    "mosaic_pixels": f"""WITH k AS (SELECT *, user_id % {TILES} AS k, CAST(floor(value) AS INTEGER) AS v FROM events WHERE user_id % {TILES} % 3 <> 1),
        p AS (SELECT {X0} + k % {WIDE} AS tile_x, {Y0} + k // {WIDE} AS tile_y, event_id % 256 AS x, event_id // 256 % 256 AS y, v % 256 AS r, v * 3 % 256 AS g, v * 7 % 256 AS b FROM k), m AS (SELECT tile_x, tile_y, x, y, max({{'r': r, 'g': g, 'b': b}}) AS c FROM p GROUP BY 1, 2, 3, 4)
        SELECT CAST(tile_x AS INTEGER) AS tile_x, CAST(tile_y AS INTEGER) AS tile_y, CAST((tile_x - {X0}) * 256 + x AS INTEGER) AS x, CAST((tile_y - {Y0}) * 256 + y AS INTEGER) AS y, c.r AS r, c.g AS g, c.b AS b, 255 AS a FROM m
        UNION ALL SELECT CAST({X0} + k % {WIDE} AS INTEGER), CAST({Y0} + k // {WIDE} AS INTEGER), NULL, NULL, NULL, NULL, NULL, NULL FROM range({TILES}) AS t(k) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tile_x = {X0} + k % {WIDE} AND m.tile_y = {Y0} + k // {WIDE})""",
}
