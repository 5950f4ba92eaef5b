"""Catalogue: simulations, sweeps, rasters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from furrow.operators import outlines
from furrow.operators import simulation as sim
from furrow.operators import zones as zn
from furrow.plans.spatial import _C, _COMP, _cells, _points, components
from furrow.plans.zones import _fence, _trios
from furrow.session import table


def tank_scan(spark, sf_dir):
    """A tank profile for each mission: events of a user as legs of a few seconds, at most 64 a mission."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor("value").alias("v"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    m = e.withColumn("mission", F.concat_ws(":", "user_id", F.floor((nth - 1) / 64).cast("string")))
    w = Window.partitionBy("mission").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    legs = m.withColumn("dur", (F.col("v") % 5 + 1).cast("double")).withColumn("t_end", F.sum("dur").over(w))
    legs = legs.select("mission", (F.col("t_end") - F.col("dur")).alias("t_start"), "t_end", (F.col("v") % 7).cast("double").alias("speed"), (F.col("event_type") == "click").alias("spray"))
    return sim.tank_profiles(legs, "mission", 24.0)


def tour_order(spark, sf_dir):
    """Tours of missions of at most forty stops."""
    p = _points(spark, sf_dir).select(F.floor(F.col("id") / 40).alias("mission"), F.col("id").alias("stop"), F.col("lat").alias("x"), F.col("lng").alias("y"))
    return sim.tours(p, "mission", "stop")


def fragment_order(spark, sf_dir):
    """The order and the ways round of each nation's sweep fragments, with a load that runs dry half way."""
    segments = zn.split_on_hops(zn.sweep_along(_trios(spark, sf_dir), _fence(), 6.0, F.lit(0.3), "group"), 25.0, "group")
    named = segments.withColumns({"mission": F.floor(F.col("group") / 5), "part": F.concat_ws(":", F.lpad(F.col("group").cast("string"), 12, "0"), F.lpad(F.col("fragment").cast("string"), 6, "0"))})
    ends = sim.fragment_ends(named, "mission", "part")
    return sim.fragment_tours(ends, "mission", "part", (41.0, -93.0), ((41.002, -92.998),), (0.5,)).withColumn("cost_m", F.round("cost_m", 6))


def outline(spark, sf_dir):
    """The area within each zone's loops, holes taken away."""
    z = components(spark, sf_dir)
    loops = outlines.outlines(z, "component")
    return loops.groupBy("component").agg(F.sum("area").alias("area"))


def sweep_lines(spark, sf_dir):
    """Level passes through a kite for each supplier."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 2).cast("double").alias("h"))
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(p(F.lit(0.0), -F.col("h")), p(F.lit(8.0), F.lit(0.0)), p(F.lit(0.0), F.col("h")), p(F.lit(-4.0), F.lit(0.0)))
    return sim.sweep_lines(s.withColumn("ring", ring), "s_suppkey", 1.5).select("s_suppkey", "pass", F.round("x1", 9).alias("x1"), F.round("x2", 9).alias("x2"))


def lattice_area(spark, sf_dir):
    """Cells of a slanted field a supplier, and their area."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 5).cast("double").alias("h"))
    ring = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.col("h"), F.lit(2.5)), F.array(F.col("h") + 2.0, F.lit(9.0)), F.array(F.lit(1.0), F.lit(7.0)))
    cells = sim.lattice(s.select("s_suppkey", ring.alias("ring")), "s_suppkey", 1.0)
    return cells.groupBy("s_suppkey").agg(F.count("*").alias("cells"), F.round(F.sum("area"), 6).alias("area"), F.count_if("clipped").alias("clipped"))


def lattice_cells_of_boxes(spark, sf_dir):
    """Cells of level fields, whose areas are the overlaps of their sides."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 2.3).alias("w"), (F.col("s_suppkey") % 7 + 1.6).alias("h"))
    at = lambda x, y: F.array(x, y)
    ring = F.array(at(F.lit(0.25), F.lit(0.5)), at(F.col("w"), F.lit(0.5)), at(F.col("w"), F.col("h")), at(F.lit(0.25), F.col("h")))
    cells = sim.lattice(s.select("s_suppkey", ring.alias("ring")), "s_suppkey", 1.0)
    return cells.select("s_suppkey", "col", "row", F.round("area", 9).alias("area"), "clipped")


def regularised(spark, sf_dir):
    c = _cells(spark, sf_dir).select(F.lit(1).alias("field"), "col", "row", "rate", (F.col("col") % 5 == 0).alias("skip"))
    return sim.regularise(c, "field", 1, 10.0)  # clamped to a quarter


def best_heading(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    costs = li.groupBy("l_suppkey", "l_linenumber").agg(F.sum("q").alias("cost")).withColumn("current", F.col("l_linenumber") == 1)
    return sim.best_heading(costs, "l_suppkey", "l_linenumber", "cost", "current", 0.0)


def _pixels(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = F.floor(F.col("value")).cast("int")
    return e.select((F.col("event_id") % 100).alias("x"), F.floor(F.col("event_id") / 100).alias("y"), (v % 256).alias("r"), (v * 3 % 256).alias("g"), (v * 7 % 256).alias("b"), F.when(v % 11 == 0, 0).otherwise(255).alias("a"), (v % 9).alias("rate"), "event_type")


def histogram(spark, sf_dir):
    return sim.histogram(_pixels(spark, sf_dir), "r")


def zonal_pixels(spark, sf_dir):
    return sim.zonal_pixels(_pixels(spark, sf_dir), F.floor(F.col("x") / 10) * 1000 + F.floor(F.col("y") / 10), F.lit(2))


def raster_burn(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    zones = p.filter("event_type = 'click'").select("x", "y", "rate").unionByName(p.filter("event_type = 'view'").select("x", "y", (F.col("rate") + 1).alias("rate")))
    return sim.burn(p, zones).groupBy("rate").agg(F.count("*").alias("pixels"))


_V = "px AS (SELECT event_id % 100 AS x, CAST(floor(event_id / 100) AS BIGINT) AS y, v % 256 AS r, v * 3 % 256 AS g, v * 7 % 256 AS b, CASE WHEN v % 11 = 0 THEN 0 ELSE 255 END AS a, v % 9 AS rate, event_type FROM (SELECT *, CAST(floor(value) AS INTEGER) AS v FROM events))"

QUERIES = {f.__name__: f for f in (tank_scan, tour_order, fragment_order, outline, sweep_lines, lattice_area, lattice_cells_of_boxes, regularised, best_heading, histogram, zonal_pixels, raster_burn)}
ORACLES = {
    "outline": _COMP + " SELECT component, CAST(count(*) AS DOUBLE) AS area FROM comp GROUP BY 1",
    "sweep_lines": """WITH s AS (SELECT s_suppkey, CAST(s_nationkey + 2 AS DOUBLE) AS h FROM supplier), p AS (SELECT *, unnest(range(0, greatest(1, CAST(floor(2 * h / 1.5) AS BIGINT)))) AS pass, greatest(1, CAST(floor(2 * h / 1.5) AS BIGINT)) AS n FROM s),
        y AS (SELECT *, (-h + h) / 2 - (n - 1) * 1.5::DOUBLE / 2 + pass * 1.5::DOUBLE AS y FROM p), e AS (SELECT *, unnest([{'a': 0.0::DOUBLE, 'b': -h, 'c': 8.0::DOUBLE, 'd': 0.0::DOUBLE}, {'a': 8.0, 'b': 0.0, 'c': 0.0, 'd': h}, {'a': 0.0, 'b': h, 'c': -4.0, 'd': 0.0}, {'a': -4.0, 'b': 0.0, 'c': 0.0, 'd': -h}]) AS e FROM y),
        x AS (SELECT s_suppkey, pass, e.a + (e.c - e.a) * (y - e.b) / (e.d - e.b) AS x FROM e WHERE (e.b > y) <> (e.d > y)), r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey, pass ORDER BY x) AS k FROM x)
        SELECT a.s_suppkey, CAST(a.pass AS INTEGER) AS pass, round(a.x, 9) AS x1, round(b.x, 9) AS x2 FROM r a JOIN r b ON a.s_suppkey = b.s_suppkey AND a.pass = b.pass AND a.k % 2 = 1 AND b.k = a.k + 1""",
    "lattice_cells_of_boxes": """WITH s AS (SELECT s_suppkey, s_nationkey + 2.3::DOUBLE AS w, s_suppkey % 7 + 1.6::DOUBLE AS h FROM supplier), c AS (SELECT *, unnest(range(0, CAST(floor(w) AS BIGINT) + 1)) AS col FROM s), r AS (SELECT *, unnest(range(0, CAST(floor(h) AS BIGINT) + 1)) AS "row" FROM c),
        a AS (SELECT s_suppkey, CAST(col AS INTEGER) AS col, CAST("row" AS INTEGER) AS "row", (least(col + 1, w) - greatest(col, 0.25)) * (least("row" + 1, h) - greatest("row", 0.5)) AS area FROM r) SELECT s_suppkey, col, "row", round(area, 9) AS area, area < 1 - 1e-9 AS clipped FROM a WHERE area >= 0.01""",
    "lattice_area": """WITH s AS (SELECT s_suppkey, CAST(s_nationkey + 5 AS DOUBLE) AS h FROM supplier), uv AS MATERIALIZED (SELECT s_suppkey, i, u, v FROM s, LATERAL (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, h, 2.5), (2, h + 2, 9.0), (3, 1.0, 7.0)) AS r(i, u, v)),
        e AS MATERIALIZED (SELECT a.s_suppkey, a.u AS ua, a.v AS va, b.u AS ub, b.v AS vb FROM uv a JOIN uv b ON a.s_suppkey = b.s_suppkey AND b.i = (a.i + 1) % 4),
        c AS MATERIALIZED (SELECT s_suppkey, col, "row" FROM s, LATERAL (SELECT unnest(range(0, CAST(floor(h + 2) AS BIGINT) + 1)) AS col), range(10) AS t("row")),
        w AS (SELECT c.*, sign(ub - ua) AS way, greatest(least(ua, ub), col) AS lo, least(greatest(ua, ub), col + 1) AS hi, va + (greatest(least(ua, ub), col) - ua) * (vb - va) / (ub - ua) AS v1, va + (least(greatest(ua, ub), col + 1) - ua) * (vb - va) / (ub - ua) AS v2 FROM c JOIN e USING (s_suppkey)),
        k AS (SELECT *, CASE WHEN v1 < "row" THEN "row" * v1 WHEN v1 <= "row" + 1 THEN "row" * "row" + (v1 * v1 - "row" * "row") / 2 ELSE "row" * "row" + (2 * "row" + 1) / 2.0::DOUBLE + ("row" + 1) * (v1 - "row" - 1) END AS g1,
            CASE WHEN v2 < "row" THEN "row" * v2 WHEN v2 <= "row" + 1 THEN "row" * "row" + (v2 * v2 - "row" * "row") / 2 ELSE "row" * "row" + (2 * "row" + 1) / 2.0::DOUBLE + ("row" + 1) * (v2 - "row" - 1) END AS g2 FROM w WHERE hi > lo),
        a AS (SELECT s_suppkey, col, "row", abs(sum(way * (hi - lo) * (g2 - g1) / (v2 - v1))) AS area FROM k GROUP BY 1, 2, 3)
        SELECT s_suppkey, count(*) AS cells, round(sum(area), 6) AS area, count(*) FILTER (area < 1 - 1e-9) AS clipped FROM a WHERE area >= 0.01 GROUP BY 1""",
    "regularised": f"""WITH {_C}, m AS (SELECT * FROM cells WHERE col % 5 <> 0), g AS (SELECT DISTINCT rate, col + dc AS col, "row" + dr AS "row" FROM m, range(-1, 2) a(dc), range(-1, 2) b(dr)),
        k AS (SELECT rate, col + dc AS col, "row" + dr AS "row" FROM g, range(-1, 2) a(dc), range(-1, 2) b(dr) GROUP BY ALL HAVING count(*) = 9), f AS (SELECT col, "row", min(rate) AS rate FROM k WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.col = k.col AND c."row" = k."row") GROUP BY 1, 2 HAVING count(*) = 1)
        SELECT 1 AS field, rate, col, "row", false AS added FROM m UNION ALL SELECT 1, rate, col, "row", true FROM f WHERE (SELECT count(*) FROM f) <= 0.25 * (SELECT count(*) FROM m)""",
    "best_heading": """WITH c AS (SELECT l_suppkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cost FROM lineitem GROUP BY 1, 2), n AS (SELECT l_suppkey, cost AS now FROM c WHERE l_linenumber = 1)
        SELECT c.l_suppkey, CASE WHEN now IS NULL OR cost < now THEN l_linenumber ELSE 1 END AS l_linenumber, CASE WHEN now IS NULL OR cost < now THEN cost ELSE now END AS cost FROM c LEFT JOIN n USING (l_suppkey) QUALIFY row_number() OVER (PARTITION BY c.l_suppkey ORDER BY cost, l_linenumber) = 1""",
    "histogram": f"WITH {_V} SELECT r, count(*) AS n FROM px GROUP BY r",
    "zonal_pixels": f"WITH {_V} SELECT CAST(floor(x / 10) * 1000 + floor(y / 10) AS BIGINT) AS cell, count(*) AS n, CAST(sum(r + g + b) AS BIGINT) AS s1, CAST(sum((r + g + b) * (r + g + b)) AS BIGINT) AS s2 FROM px WHERE a > 0 AND r + g + b > 0 AND x % 2 = 0 AND y % 2 = 0 GROUP BY 1",
    "raster_burn": f"WITH {_V}, z AS (SELECT x, y, max(rate) AS rate FROM (SELECT x, y, rate FROM px WHERE event_type = 'click' UNION ALL SELECT x, y, rate + 1 FROM px WHERE event_type = 'view') GROUP BY ALL) SELECT CAST(coalesce(z.rate, 0) AS FLOAT) AS rate, count(*) AS pixels FROM px LEFT JOIN z USING (x, y) GROUP BY 1",
}
