"""Catalogue: spatial joins, lattices and zones over embeddings as points of a plane."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from furrow.functions import geo
from furrow.operators import spatial as sp
from furrow.session import table

COS, SIN = math.cos(0.3), math.sin(0.3)
RINGS = [
    (1, [(-40.0, -60.0), (-40.0, 10.0), (30.0, 20.0), (35.0, -55.0)]),
    (2, [(0.0, 0.0), (5.0, 30.0), (45.0, 15.0), (20.0, 12.0), (40.0, -5.0)]),
    (3, [(-80.0, -10.0), (-20.0, 60.0), (-10.0, -10.0)]),
]


def _points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    c = lambda i: F.element_at("embedding", i).cast("double")
    return e.select(F.col("vec_id").alias("id"), (c(1) * 200).alias("lat"), (c(2) * 300).alias("lng"), "label")


def _cells(spark, sf_dir):
    """Points binned to a lattice; the most frequent label of a cell, by its parity, is its rate."""
    p = _points(spark, sf_dir).select(F.floor(F.col("lat") / 6).alias("col"), F.floor(F.col("lng") / 9).alias("row"), "label")
    return p.groupBy("col", "row").agg((F.max("label") % 2).alias("rate"))


def _rings(spark):
    rows = [(i, [{"lat": a, "lng": b} for a, b in ring]) for i, ring in RINGS]
    return spark.createDataFrame(rows, "ring_id int, ring array<struct<lat double, lng double>>")


def point_in_ring(spark, sf_dir):
    return sp.points_in_rings(_points(spark, sf_dir), _rings(spark)).select("id", "ring_id")


def ring_area(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") * 2.0 - 20).alias("a"), (F.col("s_suppkey") % 90).cast("double").alias("b"))
    p = lambda dy, dx: F.struct((F.col("a") + dy).alias("lat"), (F.col("b") + dx).alias("lng"))
    ring = F.array(p(0.0, 0.0), p(0.0, 0.5), p(0.25, 0.75), p(0.5, 0.0))
    return s.select("s_suppkey", F.round(geo.ring_area(ring) / geo.M2_PER_ACRE, 3).alias("acres"))


def tile_index(spark, sf_dir):
    p = _points(spark, sf_dir).filter("abs(lat) < 85")
    return p.select("id", geo.tile_x(F.col("lng"), 8).alias("x"), geo.tile_y(F.col("lat"), 8).alias("y"))


def nearest_site(spark, sf_dir):
    p = _points(spark, sf_dir).select("id", "label", (40 + F.col("lat") / 4000).alias("lat"), (-95 + F.col("lng") / 4000).alias("lng"))
    sites = p.filter("label = 0").select(F.col("id").alias("site_id"), "lat", "lng")
    missions = p.select(F.col("id").alias("mission_id"), F.when(F.col("label") < 2, F.col("id")).alias("field_id"), "lat", "lng")
    return sp.match_site(missions, sites, 1000.0)


def lattice_cells(spark, sf_dir):
    return _cells(spark, sf_dir).select("col", "row", "rate", F.concat_ws(":", F.lit("g"), "col", "row").alias("cell_id"))


def components(spark, sf_dir):
    return sp.cell_components(_cells(spark, sf_dir), "rate")


def zone_summary(spark, sf_dir):
    """Cells, box and outline length of each connected zone."""
    z = components(spark, sf_dir)
    edges = sp.outline_edges(z, "component").groupBy("component").agg(F.count("*").alias("outline"))
    s = z.groupBy("component", "rate").agg(F.count("*").alias("cells"), F.min("col").alias("min_col"), F.max("col").alias("max_col"))
    return s.join(edges, "component")


def row_strips(spark, sf_dir):
    return sp.row_strips(_cells(spark, sf_dir), "rate")


def proximity_groups(spark, sf_dir):
    p = _points(spark, sf_dir).select("id", F.col("lat").alias("x"), F.col("lng").alias("y"), F.when(F.col("label") > 1, F.col("label")).alias("rate"))
    return sp.proximity_groups(p, 6.0)


def _claims(spark, sf_dir):
    old = _cells(spark, sf_dir).withColumn("rank", F.col("rate")).withColumn("ordinal", F.col("col") * 1000 + F.col("row"))
    new = _cells(spark, sf_dir).filter("col > -6")
    return sp.migrate_cells(old, 1.0, 1.25, COS, SIN, new)


def migrate_plan(spark, sf_dir):
    return sp.resolve_claims(_claims(spark, sf_dir)).select("new_col", "new_row", "col", "row", "rate")


def migration_counts(spark, sf_dir):
    return sp.migration_counts(_claims(spark, sf_dir))


def principal_axis(spark, sf_dir):
    p = _points(spark, sf_dir).select("label", F.floor("lat").alias("x"), F.floor("lng").alias("y"))
    c = sp.covariance(p, "label")
    return c.select("label", "n", "cx", "cy", "min_x", "max_x", "min_y", "max_y", F.round("axis", 9).alias("axis"), F.round("anisotropy", 9).alias("anisotropy"))


def coverage_class(spark, sf_dir):
    """How a fixed view covers the box of each label's points."""
    p = _points(spark, sf_dir).groupBy("label").agg(F.max("lat").alias("n"), F.min("lat").alias("s"), F.max("lng").alias("e"), F.min("lng").alias("w"))
    v = [F.lit(x) for x in (60.0, -60.0, 110.0, -110.0)]
    return p.select("label", geo.coverage(*[F.col(c) for c in "nsew"], *v).alias("coverage"))


_P = "pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 200 AS lat, CAST(embedding[2] AS DOUBLE) * 300 AS lng, label FROM embeddings)"
_C = _P + ', cells AS (SELECT CAST(floor(lat / 6) AS BIGINT) AS col, CAST(floor(lng / 9) AS BIGINT) AS "row", CAST(max(label) % 2 AS INTEGER) AS rate FROM pts GROUP BY 1, 2)'
_KEY = '((col + 1073741824) * 2147483648 + ("row" + 1073741824))'
_COMP = (
    "WITH RECURSIVE " + _C + f""", k AS (SELECT *, {_KEY} AS key FROM cells), reach(key, seed) AS (SELECT key, key FROM k UNION SELECT b.key, r.seed FROM reach r JOIN k a ON a.key = r.key
    JOIN k b ON a.rate = b.rate AND abs(a.col - b.col) + abs(a."row" - b."row") = 1), comp AS (SELECT k.col, k."row", k.rate, m.component FROM k JOIN (SELECT key, min(seed) AS component FROM reach GROUP BY key) m USING (key))"""
)
_EDGES = "SELECT ring_id, a[1] AS pa, a[2] AS pn, b[1] AS qa, b[2] AS qn FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS ring_id, [CAST({r[k][0]} AS DOUBLE), CAST({r[k][1]} AS DOUBLE)] AS a, [CAST({r[(k + 1) % len(r)][0]} AS DOUBLE), CAST({r[(k + 1) % len(r)][1]} AS DOUBLE)] AS b" for i, r in RINGS for k in range(len(r))
) + ")"
_CLAIMS = (
    _C + f""", o AS (SELECT *, rate AS rank, col * 1000 + "row" AS ordinal, (col + 0.5::DOUBLE) AS cx, ("row" + 0.5::DOUBLE) AS cy FROM cells),
    t AS (SELECT *, cx * {COS!r}::DOUBLE + cy * {SIN!r}::DOUBLE AS rx, cy * {COS!r}::DOUBLE - cx * {SIN!r}::DOUBLE AS ry FROM o),
    m AS (SELECT *, CAST(floor(rx / 1.25::DOUBLE) AS BIGINT) AS new_col, CAST(floor(ry / 1.25::DOUBLE) AS BIGINT) AS new_row FROM t),
    claims AS (SELECT m.*, (rx - (new_col + 0.5::DOUBLE) * 1.25::DOUBLE) ^ 2 + (ry - (new_row + 0.5::DOUBLE) * 1.25::DOUBLE) ^ 2 AS dist2, EXISTS (SELECT 1 FROM cells c WHERE c.col > -6 AND c.col = new_col AND c."row" = new_row) AS landed FROM m)"""
)
_DIST = "(sqrt(radians(b.lat - a.lat) ^ 2 + (radians(b.lng - a.lng) * cos(radians((a.lat + b.lat) / 2))) ^ 2) * 6371000)"

QUERIES = {
    f.__name__: f
    for f in (point_in_ring, ring_area, tile_index, nearest_site, lattice_cells, components, zone_summary, row_strips, proximity_groups, migrate_plan, migration_counts, principal_axis, coverage_class)
}
ORACLES = {
    "point_in_ring": f"WITH {_P}, e AS ({_EDGES}) SELECT id, CAST(ring_id AS INTEGER) AS ring_id FROM pts, e GROUP BY id, ring_id HAVING sum(CASE WHEN ((pa > lat) <> (qa > lat)) AND lng < (qn - pn) * (lat - pa) / (qa - pa + 1e-12::DOUBLE) + pn THEN 1 ELSE 0 END) % 2 = 1",
    "ring_area": """WITH s AS (SELECT s_suppkey, s_nationkey * 2.0::DOUBLE - 20 AS a, CAST(s_suppkey % 90 AS DOUBLE) AS b FROM supplier), e AS (SELECT s_suppkey, unnest([{'p': a, 'q': a, 'd': 0.5}, {'p': a, 'q': a + 0.25, 'd': 0.25}, {'p': a + 0.25, 'q': a + 0.5, 'd': -0.75}, {'p': a + 0.5, 'q': a, 'd': 0.0}]) AS e FROM s)
        SELECT s_suppkey, round(abs(sum(radians(e.d::DOUBLE) * (2 + sin(radians(e.p)) + sin(radians(e.q)))) * 6378137.0::DOUBLE * 6378137.0::DOUBLE / 2) / 4046.8564224::DOUBLE, 3) AS acres FROM e GROUP BY 1""",
    "tile_index": f"WITH {_P} SELECT id, CAST(floor((lng + 180) / 360 * 256) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256) AS BIGINT) AS y FROM pts WHERE abs(lat) < 85",
    "nearest_site": f"""WITH {_P}, q AS (SELECT id, label, 40 + lat / 4000 AS lat, -95 + lng / 4000 AS lng FROM pts), d AS (SELECT a.id AS mission_id, b.id AS site_id, a.label < 2 AND a.id = b.id AS own, {_DIST} AS d FROM q a JOIN q b ON b.label = 0)
        SELECT q.id AS mission_id, w.site_id FROM q LEFT JOIN (SELECT * FROM d WHERE own OR d <= 1000 QUALIFY row_number() OVER (PARTITION BY mission_id ORDER BY own DESC, d, site_id) = 1) w ON w.mission_id = q.id""",
    "lattice_cells": f"""WITH {_C} SELECT col, "row", rate, 'g:' || col || ':' || "row" AS cell_id FROM cells""",
    "components": _COMP + ' SELECT col, "row", rate, component FROM comp',
    "zone_summary": _COMP + """, adj AS (SELECT a.component, count(*) AS shared FROM comp a JOIN comp b ON a.component = b.component AND abs(a.col - b.col) + abs(a."row" - b."row") = 1 GROUP BY 1)
        SELECT component, rate, count(*) AS cells, min(col) AS min_col, max(col) AS max_col, CAST(count(*) * 4 - coalesce(any_value(shared), 0) AS BIGINT) AS outline FROM comp LEFT JOIN adj USING (component) GROUP BY component, rate""",
    "row_strips": f"""WITH {_C} SELECT rate, "row", min(col) AS first_col, max(col) AS last_col FROM (SELECT *, col - row_number() OVER (PARTITION BY rate, "row" ORDER BY col) AS i FROM cells) GROUP BY rate, "row", i""",
    "proximity_groups": f"""WITH RECURSIVE {_P}, q AS (SELECT *, CASE WHEN label > 1 THEN label END AS rate FROM pts), e AS (SELECT a.id AS a, b.id AS b FROM q a JOIN q b ON a.rate IS NOT DISTINCT FROM b.rate AND (a.lat - b.lat) * (a.lat - b.lat) + (a.lng - b.lng) * (a.lng - b.lng) <= 36),
        reach(id, seed) AS (SELECT id, id FROM q UNION SELECT e.b, r.seed FROM reach r JOIN e ON e.a = r.id) SELECT id, min(seed) AS "group" FROM reach GROUP BY id""",
    "migrate_plan": f'WITH {_CLAIMS} SELECT new_col, new_row, col, "row", rate FROM claims WHERE landed QUALIFY row_number() OVER (PARTITION BY new_col, new_row ORDER BY rank DESC, dist2, ordinal) = 1',
    "migration_counts": f"WITH {_CLAIMS} SELECT count(*) AS decided, count(*) FILTER (landed) AS moved, count(*) FILTER (NOT landed) AS lost, CAST(count(*) FILTER (NOT landed) AS DOUBLE) / count(*) AS loss, CAST(count(*) FILTER (NOT landed) AS DOUBLE) / count(*) > 0.3 AS confirm FROM claims",
    "principal_axis": f"""WITH {_P}, s AS (SELECT label, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(x * x) AS BIGINT) AS sxx, CAST(sum(y * y) AS BIGINT) AS syy, CAST(sum(x * y) AS BIGINT) AS sxy, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y
        FROM (SELECT label, CAST(floor(lat) AS BIGINT) AS x, CAST(floor(lng) AS BIGINT) AS y FROM pts) GROUP BY label), v AS (SELECT *, (n * sxx - sx * sx)::DOUBLE / (n * n) AS vx, (n * syy - sy * sy)::DOUBLE / (n * n) AS vy, (n * sxy - sx * sy)::DOUBLE / (n * n) AS c FROM s)
        SELECT label, n, sx / n AS cx, sy / n AS cy, min_x, max_x, min_y, max_y, round(0.5 * atan2(2 * c, vx - vy), 9) AS axis,
        round(((vx + vy) / 2 + sqrt((vx - vy) ^ 2 / 4 + c * c)) / ((vx + vy) / 2 - sqrt((vx - vy) ^ 2 / 4 + c * c)), 9) AS anisotropy FROM v""",
    "coverage_class": f"WITH {_P} SELECT label, CASE WHEN max(lat) <= 60 AND min(lat) >= -60 AND max(lng) <= 110 AND min(lng) >= -110 THEN 'full' WHEN min(lat) <= 60 AND max(lat) >= -60 AND min(lng) <= 110 AND max(lng) >= -110 THEN 'partial' ELSE 'none' END AS coverage FROM pts GROUP BY label",
}
