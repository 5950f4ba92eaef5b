"""Catalogue: ways and places in fields, headlands by edge, uploads that go on."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import rings
from furrow.operators import lattices, routing
from furrow.operators import zones as zn
from furrow.plans import fields as fp
from furrow.plans.zones import _HEAD, _zones
from furrow.session import dealt, table
from furrow.streaming import leases


def _horseshoes(spark, sf_dir):
    """A field about a notch a supplier, and a leg between its arms."""
    k = F.col("s_suppkey").cast("double")
    at = lambda n, e: F.struct((41 + n / 111320.0).alias("lat"), (-93 + e / 84000.0).alias("lng"))
    depth = 20.3 + k % 50
    ring = F.array(at(k * 0, k * 0), at(k * 0, k * 0 + 100.7), at(80.3 + k % 9, k * 0 + 101.1), at(79.9 + k * 0, 70.2 - k % 5), at(depth, 68.3 - k % 5), at(depth + 0.7, 33.1 + k % 4), at(81.7 + k * 0, 30.9 + k % 4), at(80.9 + k % 7, k * 0 + 0.3))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array(ring).alias("rings"), at(60.3 + k % 7, 10.9 + k % 3).alias("a"), at(58.7 - k % 11, 88.3 - k % 6).alias("b"))


def inside_routes(spark, sf_dir):
    """How long ways between the arms are on a lattice of 16 x 16, and whether there is one."""
    r = routing.routes_inside(_horseshoes(spark, sf_dir), "s_suppkey", 16)
    return r.select("s_suppkey", "steps", (F.col("inside") | (F.col("steps") > 0)).alias("reached"))


def interior_points(spark, sf_dir):
    """A place inside each horseshoe, whose mean may lie in the notch."""
    p = rings.interior_point(F.col("rings")[0])
    return dealt(_horseshoes(spark, sf_dir), "s_suppkey").select("s_suppkey", p.alias("p")).select("s_suppkey", F.round("p.lat", 9).alias("lat"), F.round("p.lng", 9).alias("lng"))


def hit_cells(spark, sf_dir):
    """The cells under a spread of places about each slanted field."""
    f = fp._fields(spark, sf_dir)
    n = F.sequence(F.lit(0), F.lit(149))
    p = f.select("s_suppkey", F.explode(n).alias("n")).select("s_suppkey", "n", (40.9999 + F.col("n") % 12 * 0.000087).alias("lat"), (-93.0001 + F.floor(F.col("n") / 12) * 0.00011).alias("lng"))
    return routing.hit_cells(p, f, lattices.treatment_lattice(f, "s_suppkey"), "s_suppkey").select("s_suppkey", "n", "col", "row")


def zones_in_field(spark, sf_dir):
    """Prescribed zones whose middle lies in their nation's fence."""
    _, zones, fences = fp._prescription(spark, sf_dir)
    kept = routing.zones_in_field(zones, fences, "n_nationkey")
    return kept.groupBy("n_nationkey").agg(F.count("*").alias("zones"), F.sum("rate_lha").alias("rates"))


def edge_headlands(spark, sf_dir):
    """What is left of each zone if its four edges have headlands of their own."""
    z = zn.with_width(_zones(spark, sf_dir), out="w")
    by = F.array(F.lit(1.5), F.col("zone_id") % 3, F.lit(0.5), F.lit(2.0))
    h = z.select("zone_id", rings.headland_by_edge(F.col("ring"), F.col("w"), by.cast("array<double>")).alias("h"))
    return h.select("zone_id", F.col("h.kind").alias("kind"), F.round("h.scale", 5).alias("scale"))


def resumed_uploads(spark, sf_dir):
    """Orders as files of a customer's batch: what is left of it by a checkpoint that is a day old at most."""
    o = table(spark, sf_dir, "orders")
    files = o.select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").cast("string").alias("key"))
    saved = o.filter("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("batch")).agg(F.max("o_orderdate").alias("saved_at"), F.collect_set(F.col("o_orderkey").cast("string")).alias("done"))
    now = F.to_timestamp(F.lit("1997-01-01"))
    recent = saved.withColumn("saved_at", F.when(F.col("batch") % 2 == 0, now - F.expr("INTERVAL 23 HOURS")).otherwise(F.least("saved_at", now - F.expr("INTERVAL 25 HOURS"))))
    return leases.resume_uploads(files, recent, now).groupBy("batch").agg(F.count("*").alias("left"), F.min("key").alias("first"))


_SHOE = """s AS (SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) AS k, 20.3::DOUBLE + s_suppkey % 50 AS depth FROM supplier),
    ring AS MATERIALIZED (SELECT s_suppkey, i, 41 + n / 111320.0::DOUBLE AS lat, -93 + e / 84000.0::DOUBLE AS lng FROM s, LATERAL (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.0, 100.7), (2, 80.3 + k % 9, 101.1), (3, 79.9, 70.2 - k % 5), (4, depth, 68.3 - k % 5), (5, depth + 0.7, 33.1 + k % 4), (6, 81.7, 30.9 + k % 4), (7, 80.9 + k % 7, 0.3)) AS r(i, n, e)),
    e AS MATERIALIZED (SELECT a.s_suppkey, a.lat AS pa, a.lng AS pn, b.lat AS qa, b.lng AS qn FROM ring a JOIN ring b ON a.s_suppkey = b.s_suppkey AND b.i = (a.i + 1) % 8)"""
_IN = "(e.pa > {lat}) <> (e.qa > {lat}) AND {lng} < (e.qn - e.pn) * ({lat} - e.pa) / (e.qa - e.pa + 1e-12::DOUBLE) + e.pn"
_FAR = "sqrt(((p.lat - {a}.lat) * 111320) ^ 2 + ((p.lng - {a}.lng) * cos(radians((p.lat + {a}.lat) / 2)) * 111320) ^ 2)"

_BY = "[1.5::DOUBLE, CAST(p.zone_id % 3 AS DOUBLE), 0.5::DOUBLE, 2.0::DOUBLE][p.i]"
_EDGES = _HEAD.replace("dy * 5 AS", f"dy * {_BY} AS").replace("dx * 5 AS", f"dx * {_BY} AS").replace("w <= 10 + 1e-6", "w <= 4 + 1e-6")

QUERIES = {f.__name__: f for f in (inside_routes, interior_points, hit_cells, zones_in_field, edge_headlands, resumed_uploads)}
ORACLES = {
    "inside_routes": f"""WITH RECURSIVE {_SHOE}, ends AS (SELECT s_suppkey, 0 AS w, 41 + (60.3::DOUBLE + k % 7) / 111320.0::DOUBLE AS lat, -93 + (10.9::DOUBLE + k % 3) / 84000.0::DOUBLE AS lng FROM s UNION ALL SELECT s_suppkey, 1, 41 + (58.7::DOUBLE - k % 11) / 111320.0::DOUBLE, -93 + (88.3::DOUBLE - k % 6) / 84000.0::DOUBLE FROM s),
        line AS (SELECT a.s_suppkey, t, a.lat + (b.lat - a.lat) * t / 12 AS lat, a.lng + (b.lng - a.lng) * t / 12 AS lng FROM ends a JOIN ends b ON a.s_suppkey = b.s_suppkey AND a.w = 0 AND b.w = 1, range(1, 12) AS x(t)),
        straight AS (SELECT s_suppkey, count(*) = 11 AS ok FROM (SELECT l.s_suppkey, t FROM line l JOIN e ON e.s_suppkey = l.s_suppkey AND {_IN.format(lat="l.lat", lng="l.lng")} GROUP BY 1, 2 HAVING count(*) % 2 = 1) GROUP BY 1),
        box AS (SELECT s_suppkey, min(lat) AS s, max(lat) AS n, min(lng) AS w, max(lng) AS e FROM (SELECT s_suppkey, lat, lng FROM ring UNION ALL SELECT s_suppkey, lat, lng FROM ends) GROUP BY 1),
        c AS (SELECT s_suppkey, i, j, s + (i + 0.5::DOUBLE) * (n - s) / 16 AS lat, w + (j + 0.5::DOUBLE) * (e - w) / 16 AS lng FROM box, range(16) AS x(i), range(16) AS y(j)),
        free AS MATERIALIZED (SELECT p.s_suppkey, i, j, any_value(p.lat) AS lat, any_value(p.lng) AS lng FROM c p JOIN e ON e.s_suppkey = p.s_suppkey AND {_IN.format(lat="p.lat", lng="p.lng")} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
        snap AS MATERIALIZED (SELECT a.s_suppkey, a.w, min({{'d': {_FAR.format(a="a")}, 'i': i, 'j': j}}) AS m FROM ends a JOIN free p USING (s_suppkey) GROUP BY 1, 2),
        walk AS (SELECT s_suppkey, m.i AS i, m.j AS j, 1 AS n FROM snap WHERE w = 0 UNION SELECT f.s_suppkey, f.i, f.j, walk.n + 1 FROM walk JOIN free f ON f.s_suppkey = walk.s_suppkey AND abs(f.i - walk.i) + abs(f.j - walk.j) = 1 WHERE walk.n < 60),
        found AS (SELECT g.s_suppkey, min(n) AS n FROM snap g JOIN walk ON walk.s_suppkey = g.s_suppkey AND walk.i = g.m.i AND walk.j = g.m.j WHERE g.w = 1 GROUP BY 1)
        SELECT s_suppkey, CAST(CASE WHEN coalesce(straight.ok, false) THEN 0 ELSE coalesce(found.n, 0) END AS INTEGER) AS steps, coalesce(straight.ok, false) OR found.n IS NOT NULL AS reached FROM s LEFT JOIN straight USING (s_suppkey) LEFT JOIN found USING (s_suppkey)""",
    "interior_points": f"""WITH {_SHOE}, m AS (SELECT s_suppkey, avg(lat) AS lat, avg(lng) AS lng, min(lat) AS s, max(lat) AS n, min(lng) AS w, max(lng) AS e FROM ring GROUP BY 1),
        own AS (SELECT p.s_suppkey FROM m p JOIN e ON e.s_suppkey = p.s_suppkey AND {_IN.format(lat="p.lat", lng="p.lng")} GROUP BY 1 HAVING count(*) % 2 = 1),
        g AS (SELECT s_suppkey, i, j, s + (n - s) * i / 24 AS lat, w + (e - w) * j / 24 AS lng FROM m, range(1, 24) AS x(i), range(1, 24) AS y(j)),
        q AS (SELECT p.s_suppkey, i, j, any_value(p.lat) AS lat, any_value(p.lng) AS lng FROM g p JOIN e ON e.s_suppkey = p.s_suppkey AND {_IN.format(lat="p.lat", lng="p.lng")} GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
        b AS (SELECT p.s_suppkey, min({{'d': {_FAR.format(a="m")}, 'i': i, 'j': j, 'lat': p.lat, 'lng': p.lng}}) AS b FROM q p JOIN m USING (s_suppkey) GROUP BY 1)
        SELECT m.s_suppkey, round(CASE WHEN own.s_suppkey IS NULL THEN b.lat ELSE m.lat END, 9) AS lat, round(CASE WHEN own.s_suppkey IS NULL THEN b.lng ELSE m.lng END, 9) AS lng FROM m LEFT JOIN own USING (s_suppkey) LEFT JOIN b USING (s_suppkey)""",
    "hit_cells": f"""WITH cell AS ({fp.ORACLES["heading_lattice"]}), s AS (SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) AS k, s_nationkey * 0.1::DOUBLE + 0.05::DOUBLE AS h, 6.0::DOUBLE * (s_suppkey % 3 + 1) AS size, cos(radians(41.00031::DOUBLE)) * 111320.0::DOUBLE AS wide FROM supplier),
        p AS (SELECT s.*, n, 40.9999::DOUBLE + n % 12 * 0.000087::DOUBLE AS lat, -93.0001::DOUBLE + n // 12 * 0.00011::DOUBLE AS lng FROM s, range(150) AS t(n)),
        ring AS (SELECT s_suppkey, i, 41 + n / 111320.0::DOUBLE AS lat, -93 + e / 84000.0::DOUBLE AS lng FROM s, LATERAL ({fp._RING}) AS r(i, n, e)),
        e AS (SELECT a.s_suppkey, a.lat AS pa, a.lng AS pn, b.lat AS qa, b.lng AS qn FROM ring a JOIN ring b ON a.s_suppkey = b.s_suppkey AND b.i = (a.i + 1) % 5),
        held AS (SELECT p.s_suppkey, p.n FROM p JOIN e ON e.s_suppkey = p.s_suppkey AND {_IN.format(lat="p.lat", lng="p.lng")} GROUP BY 1, 2 HAVING count(*) % 2 = 1),
        xy AS (SELECT *, (lng + 92.99953::DOUBLE) * wide AS x, (lat - 41.00031::DOUBLE) * 111320 AS y FROM p),
        place AS (SELECT s_suppkey, n, CAST(floor((x * cos(h) + y * sin(h)) / size) AS INTEGER) AS col, CAST(floor((y * cos(h) - x * sin(h)) / size) AS INTEGER) AS "row" FROM xy)
        SELECT s_suppkey, CAST(n AS INTEGER) AS n, col, "row" FROM place JOIN cell USING (s_suppkey, col, "row") LEFT JOIN held USING (s_suppkey, n) WHERE NOT cell.clipped OR held.n IS NOT NULL""",
    "zones_in_field": """WITH z AS (SELECT s_nationkey AS n, s_suppkey % 6 * 5 AS rate, 40.9987::DOUBLE - s_suppkey % 17 * 0.00013::DOUBLE + (0.00031::DOUBLE - 0.00119::DOUBLE) / 3 AS lat, -92.9989::DOUBLE + s_suppkey % 23 * 0.00021::DOUBLE + (0.00177::DOUBLE + 0.00093::DOUBLE) / 3 AS lng FROM supplier),
        f AS (SELECT n_nationkey AS n, [{'y': 40.9991::DOUBLE - n_nationkey * 1e-5::DOUBLE, 'x': -92.9993::DOUBLE}, {'y': 40.99871::DOUBLE, 'x': -92.99417::DOUBLE + n_nationkey * 1e-5::DOUBLE}, {'y': 40.99613::DOUBLE, 'x': -92.99501::DOUBLE}, {'y': 40.99629::DOUBLE + n_nationkey * 1e-5::DOUBLE, 'x': -92.99877::DOUBLE}] AS r FROM nation),
        e AS (SELECT n, r[i] AS p, r[i % 4 + 1] AS q FROM f, range(1, 5) AS t(i))
        SELECT n AS n_nationkey, count(*) AS zones, CAST(sum(rate) AS DOUBLE) AS rates FROM z WHERE (SELECT count(*) FROM e WHERE e.n = z.n AND (e.p.y > z.lat) <> (e.q.y > z.lat) AND z.lng < (e.q.x - e.p.x) * (z.lat - e.p.y) / (e.q.y - e.p.y + 1e-12::DOUBLE) + e.p.x) % 2 = 1 GROUP BY 1""",
    "edge_headlands": f"WITH {_EDGES} SELECT zone_id, CASE WHEN reason IS NULL THEN 'applied' ELSE 'waived' END AS kind, round(scale, 5) AS scale FROM hl",
    "resumed_uploads": """WITH f AS (SELECT o_custkey AS batch, o_orderkey % 3 = 0 AND o_custkey % 2 = 0 AS done, CAST(o_orderkey AS VARCHAR) AS key FROM orders) SELECT batch, count(*) AS "left", min(key) AS first FROM f WHERE NOT done GROUP BY 1""",
}
