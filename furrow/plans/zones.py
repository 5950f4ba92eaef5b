"""Catalogue: zones as rings, grouped by gaps, swept along headings, inset by headlands; suppliers give one zone each."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import geo, rings
from furrow.operators import zones as zn
from furrow.session import table

HEADINGS = (0.0, 0.3, 1.2)
FENCE = [(40.995, -93.005), (40.995, -92.993), (41.004, -92.992), (41.003, -93.005)]


def _zones(spark, sf_dir):
    """A slanted quadrangle a supplier, twenty in a row of ground, some of them over their neighbour."""
    k = F.col("s_suppkey").cast("double")
    x, y = (k % 20) * 50, F.floor(k / 20) * 40.0
    w, h, t = 30 + (k % 7) * 5, 12 + (k % 5) * 4, k % 3
    p = lambda a, b: F.struct((41 + b / 111320.0).alias("lat"), (-93 + a / 84000.0).alias("lng"))
    ring = F.array(p(x, y), p(x + w, y + t), p(x + w - k % 4, y + h), p(x, y + h - t * 2))
    rate = F.when(k % 7 > 0, (k % 3) * 10)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("zone_id"), ring.alias("ring"), rate.alias("rate_lha"), (w * h).alias("area_m2"))


def ring_axis(spark, sf_dir):
    a = rings.axis(F.array("ring"))
    return _zones(spark, sf_dir).select("zone_id", a.alias("a")).select("zone_id", F.round("a.theta", 6).alias("theta"), F.round("a.anisotropy", 4).alias("anisotropy"))


def sweep_heading(spark, sf_dir):
    """Headings of single zones in a field whose axis lies at 0.2 rad."""
    return _zones(spark, sf_dir).select("zone_id", F.round(rings.sweep_heading(F.array("ring"), F.lit(0.2)), 6).alias("heading"))


def zone_groups(spark, sf_dir):
    return zn.zone_groups(_zones(spark, sf_dir), 9.5).select("zone_id", "group")


def group_members(spark, sf_dir):
    """Groups in the order of their ids, with members in theirs."""
    return zn.group_rows(zn.zone_groups(_zones(spark, sf_dir), 9.5)).select("group", F.concat_ws(",", F.col("members").cast("array<string>")).alias("members"))


def headland_totals(spark, sf_dir):
    t = zn.headland_totals(_zones(spark, sf_dir), F.lit(5.0))
    return t.select(F.round("sprayed_ha", 6).alias("sprayed_ha"), F.round("volume_l", 4).alias("volume_l"), "waived")


def headlands(spark, sf_dir):
    z = zn.with_width(_zones(spark, sf_dir), out="w")
    h = z.select("zone_id", "w", rings.headland(F.col("ring"), F.col("w"), F.lit(5.0)).alias("h"))
    return h.select("zone_id", F.round("w", 6).alias("width_m"), F.col("h.kind").alias("kind"), F.round("h.scale", 6).alias("scale"), F.col("h.reason").alias("reason"))


def _trios(spark, sf_dir):
    """Three neighbours a group, whatever their rates."""
    z = _zones(spark, sf_dir).withColumn("group", F.floor(F.col("zone_id") / 3))
    return zn.group_rows(z)


def _fence():
    return F.array(F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in FENCE]))


def sweep_segments(spark, sf_dir):
    s = zn.sweep_along(_trios(spark, sf_dir), _fence(), 6.0, F.lit(0.3), "group")
    return s.select("group", "lane", "nth", "zone_id", *[F.round(f"{e}.{c}", 7).alias(f"{e}_{c}") for e in "ab" for c in ("lat", "lng")])


def sweep_costs(spark, sf_dir):
    tried = _trios(spark, sf_dir).withColumn("heading", F.explode(F.array(*[F.lit(h) for h in HEADINGS])))
    costs = zn.sweep_costs(zn.sweep_along(tried, _fence(), 6.0, F.col("heading"), "group", "heading"), 6.0, "group", "heading")
    return costs.select("group", "heading", F.round("cost_m", 3).alias("cost_m"))


def swept_heading(spark, sf_dir):
    """The cheapest of the candidate headings of each group of zones, and its segments."""
    s = zn.field_sweep(zn.group_rows(zn.zone_groups(_zones(spark, sf_dir), 9.5)), _fence(), F.lit(0.2), 6.0)
    return s.groupBy("group").agg(F.round(F.first("heading"), 6).alias("heading"), F.count("*").alias("segments"), F.countDistinct("lane").alias("lanes"))


def sweep_fragments(spark, sf_dir):
    """How many pieces a sweep falls into where hops of over 25 m are flown as transits."""
    s = zn.split_on_hops(zn.sweep_along(_trios(spark, sf_dir), _fence(), 6.0, F.lit(0.3), "group"), 25.0, "group")
    return s.groupBy("group", "fragment").agg(F.count("*").alias("segments"))


def brushed_cells(spark, sf_dir):
    """Zones whose vertex mean a brush of 60 m catches, a stroke every tenth supplier."""
    z = _zones(spark, sf_dir).select("zone_id", geo.vertex_mean(F.col("ring")).alias("c")).select(F.col("zone_id").alias("cell_id"), "c.lat", "c.lng")
    strokes = z.filter("cell_id % 10 = 0").withColumnRenamed("cell_id", "point_id")
    return zn.cells_near(z, strokes, 60.0)


def bake_tiles(spark, sf_dir):
    """Tiles over each zone's box at three zooms, in the order of a bake."""
    f = _zones(spark, sf_dir).select("zone_id", geo.footprint(F.col("ring")).alias("f")).select("zone_id", "f.west", "f.south", "f.east", "f.north")
    return zn.tile_list(f, 15, 17).orderBy("zone_id", "z", "x", "y")


def bounds_union(spark, sf_dir):
    """The box of each pair of neighbours; a zone without one keeps its own."""
    f = _zones(spark, sf_dir).select("zone_id", geo.footprint(F.col("ring")).alias("f"))
    a, b = f.filter("zone_id % 2 = 0").alias("a"), f.withColumn("zone_id", F.col("zone_id") - 1).alias("b")
    both = a.join(b, F.col("a.zone_id") == F.col("b.zone_id"), "left")
    u = geo.bounds_union(F.col("a.f"), F.col("b.f"))
    return both.select(F.col("a.zone_id").alias("zone_id"), u.alias("u")).select("zone_id", *[F.round(f"u.{c}", 9).alias(c) for c in ("south", "west", "north", "east")])


def lattice_world(spark, sf_dir):
    """Where lattice corners lie on the ground."""
    k = F.col("s_suppkey")
    lat, lng = geo.lattice_world(k % 31, k % 17, F.lit(6.0), F.lit(41.0), F.lit(-93.0), 0.3)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(lat, 9).alias("lat"), F.round(lng, 9).alias("lng"))


def overlapping_boxes(spark, sf_dir):
    """Zones whose box, padded, meets a view."""
    f = _zones(spark, sf_dir).select("zone_id", geo.footprint(F.col("ring")).alias("f"))
    hit = geo.bounds_overlap(F.col("f.north"), F.col("f.south"), F.col("f.east"), F.col("f.west"), F.lit(41.0004), F.lit(41.0001), F.lit(-92.9953), F.lit(-92.998))
    return f.filter(hit).select("zone_id")


def ring_measures(spark, sf_dir):
    """Vertex mean, area of the ring and of a ring set, box."""
    z = _zones(spark, sf_dir)
    m = geo.vertex_mean(F.col("ring"))
    half = F.transform("ring", lambda p: F.struct(((p["lat"] + F.col("ring")[0]["lat"]) / 2).alias("lat"), ((p["lng"] + F.col("ring")[0]["lng"]) / 2).alias("lng")))
    return z.select("zone_id", F.round(m["lat"], 9).alias("lat"), F.round(m["lng"], 9).alias("lng"), F.round(geo.ring_area(F.col("ring")), 3).alias("m2"), F.round(geo.rings_area(F.array("ring", half)), 3).alias("set_m2"))


_Z = """z0 AS (SELECT s_suppkey AS zone_id, s_suppkey::DOUBLE AS k FROM supplier), z1 AS (SELECT *, (k % 20) * 50 AS x, floor(k / 20) * 40 AS y, 30 + (k % 7) * 5 AS w, 12 + (k % 5) * 4 AS h, k % 3 AS t FROM z0),
 z AS (SELECT zone_id, CASE WHEN k % 7 > 0 THEN (k % 3) * 10 END AS rate_lha, w * h AS area_m2, [[x, y], [x + w, y + t], [x + w - k % 4, y + h], [x, y + h - t * 2]] AS pts FROM z1),
 v AS (SELECT zone_id, i, 41 + pts[i][2] / 111320.0::DOUBLE AS lat, -93 + pts[i][1] / 84000.0::DOUBLE AS lng, 41 + pts[i % 4 + 1][2] / 111320.0::DOUBLE AS lat2, -93 + pts[i % 4 + 1][1] / 84000.0::DOUBLE AS lng2
 FROM z, (SELECT unnest([1, 2, 3, 4]) AS i)), c AS (SELECT zone_id, sum(lat) / 4 AS clat, sum(lng) / 4 AS clng, min(lat) AS south, max(lat) AS north, min(lng) AS west, max(lng) AS east FROM v GROUP BY 1)"""
_AX = _Z + """, xy AS (SELECT zone_id, i, (lng - clng) * cos(radians(clat)) * 111320.0::DOUBLE AS x, (lat - clat) * 111320.0::DOUBLE AS y FROM v JOIN c USING (zone_id)),
 m AS (SELECT zone_id, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy FROM xy GROUP BY 1),
 ax AS (SELECT zone_id, 0.5 * atan2(2 * xy, xx - yy) AS theta, ((xx + yy) / 2 + sqrt(((xx - yy) / 2) ^ 2 + xy * xy)) / ((xx + yy) / 2 - sqrt(((xx - yy) / 2) ^ 2 + xy * xy)) AS anisotropy FROM m)"""
_GROUPS = (
    "WITH RECURSIVE " + _Z + """, pr AS (SELECT a.zone_id AS a, b.zone_id AS b, o.lat AS olat, o.lng AS olng FROM z a JOIN z b ON a.zone_id < b.zone_id AND a.rate_lha IS NOT DISTINCT FROM b.rate_lha
  JOIN v o ON o.zone_id = a.zone_id AND o.i = 1 JOIN c ca ON ca.zone_id = a.zone_id JOIN c cb ON cb.zone_id = b.zone_id WHERE abs(ca.clat - cb.clat) < 0.002 AND abs(ca.clng - cb.clng) < 0.003),
 inn AS (SELECT DISTINCT a, b FROM (SELECT pr.a, pr.b, p.zone_id, p.i FROM pr JOIN v p ON p.zone_id IN (pr.a, pr.b) JOIN v r ON r.zone_id IN (pr.a, pr.b) AND r.zone_id <> p.zone_id GROUP BY 1, 2, 3, 4
  HAVING sum(CASE WHEN (r.lat > p.lat) <> (r.lat2 > p.lat) AND p.lng < (r.lng2 - r.lng) * (p.lat - r.lat) / (r.lat2 - r.lat + 1e-12::DOUBLE) + r.lng THEN 1 ELSE 0 END) % 2 = 1)),
 q AS (SELECT a, b, cos(radians(olat)) * 111320.0::DOUBLE AS f, 111320.0::DOUBLE AS g, p.lng * f AS ax, p.lat * g AS ay, (p.lng2 - p.lng) * f AS ux, (p.lat2 - p.lat) * g AS uy, (r.lng2 - r.lng) * f AS vx, (r.lat2 - r.lat) * g AS vy,
  (p.lng - r.lng) * f AS wx, (p.lat - r.lat) * g AS wy FROM pr JOIN v p ON p.zone_id = a JOIN v r ON r.zone_id = b),
 q2 AS (SELECT *, ux * ux + uy * uy AS uu, ux * vx + uy * vy AS uv, vx * vx + vy * vy AS vv, ux * wx + uy * wy AS uw, vx * wx + vy * wy AS vw, uu * vv - uv * uv AS den FROM q),
 q3 AS (SELECT *, greatest(0, least(1, CASE WHEN den < 1e-12 THEN 0 ELSE (uv * vw - vv * uw) / den END)) AS s, greatest(0, least(1, CASE WHEN den < 1e-12 THEN CASE WHEN vv > 0 THEN vw / vv ELSE 0 END ELSE (uu * vw - uv * uw) / den END)) AS t FROM q2),
 gap AS (SELECT a, b, min(sqrt((wx + ux * s - vx * t) ^ 2 + (wy + uy * s - vy * t) ^ 2)) AS d FROM q3 GROUP BY 1, 2),
 links AS (SELECT a, b FROM gap WHERE d <= 9.5 UNION SELECT a, b FROM inn), two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach(zone_id, seed) AS (SELECT zone_id, zone_id FROM z UNION SELECT two.b, r.seed FROM reach r JOIN two ON two.a = r.zone_id), grouped AS (SELECT zone_id, min(seed) AS "group" FROM reach GROUP BY 1)"""
)
_HEAD = _Z + """, xy AS (SELECT zone_id, i, (lng - clng) * cos(radians(clat)) * 111320.0::DOUBLE AS x, (lat - clat) * 111320.0::DOUBLE AS y FROM v JOIN c USING (zone_id)),
 dirs AS (SELECT p.zone_id, p.i AS pi, q.i AS qi, -(q.y - p.y) / sqrt((q.x - p.x) ^ 2 + (q.y - p.y) ^ 2) AS nx, (q.x - p.x) / sqrt((q.x - p.x) ^ 2 + (q.y - p.y) ^ 2) AS ny FROM xy p JOIN xy q ON p.zone_id = q.zone_id AND p.i < q.i),
 wid AS (SELECT zone_id, min(reach) AS w FROM (SELECT d.zone_id, pi, qi, max(x * nx + y * ny) - min(x * nx + y * ny) AS reach FROM dirs d JOIN xy USING (zone_id) GROUP BY 1, 2, 3) GROUP BY 1),
 ed AS (SELECT p.zone_id, p.i, (q.x - p.x) / sqrt((q.x - p.x) ^ 2 + (q.y - p.y) ^ 2) AS dx, (q.y - p.y) / sqrt((q.x - p.x) ^ 2 + (q.y - p.y) ^ 2) AS dy, p.x - dy * 5 AS px, p.y + dx * 5 AS py FROM xy p JOIN xy q ON p.zone_id = q.zone_id AND q.i = p.i % 4 + 1),
 nv AS (SELECT b.zone_id, b.i, ((b.px - a.px) * b.dy - (b.py - a.py) * b.dx) / (a.dx * b.dy - a.dy * b.dx) AS t, clat + (a.py + a.dy * t) / 111320.0::DOUBLE AS lat, clng + (a.px + a.dx * t) / (cos(radians(clat)) * 111320.0::DOUBLE) AS lng
  FROM ed a JOIN ed b ON a.zone_id = b.zone_id AND b.i = a.i % 4 + 1 JOIN c ON c.zone_id = a.zone_id),
 ar AS (SELECT zone_id, abs(sum(radians(lng2 - lng) * (2 + sin(radians(lat)) + sin(radians(lat2)))) * 6378137.0::DOUBLE * 6378137.0::DOUBLE / 2) AS before FROM v GROUP BY 1),
 br AS (SELECT p.zone_id, abs(sum(radians(q.lng - p.lng) * (2 + sin(radians(p.lat)) + sin(radians(q.lat)))) * 6378137.0::DOUBLE * 6378137.0::DOUBLE / 2) AS after FROM nv p JOIN nv q ON p.zone_id = q.zone_id AND q.i = p.i % 4 + 1 GROUP BY 1),
 hl AS (SELECT zone_id, w, CASE WHEN w <= 10 + 1e-6 THEN 'narrow' WHEN after <= 0 OR after >= before OR after < before * 0.01 THEN 'collapsed' END AS reason, CASE WHEN reason IS NULL THEN after / before ELSE 1 END AS scale FROM wid JOIN ar USING (zone_id) JOIN br USING (zone_id))"""
_SWEEP = _Z + """, g AS (SELECT *, zone_id // 3 AS "group" FROM v), gc AS (SELECT "group", sum(lat) / count(*) AS glat, sum(lng) / count(*) AS glng FROM g GROUP BY 1), hs AS (SELECT unnest([{headings}]) AS heading),
 f AS (SELECT "group", heading, cos(radians(glat)) * 111320.0::DOUBLE AS mx, cos(heading) AS co, sin(heading) AS si, glat, glng FROM gc, hs),
 rv AS (SELECT f."group", heading, zone_id, (lng - glng) * mx AS x, (lat - glat) * 111320.0::DOUBLE AS y, (lng2 - glng) * mx AS x2, (lat2 - glat) * 111320.0::DOUBLE AS y2, x * co + y * si AS u, y * co - x * si AS w, x2 * co + y2 * si AS u2, y2 * co - x2 * si AS w2 FROM g JOIN f ON f."group" = g."group"),
 fe0 AS (SELECT unnest([{fence}]) AS p), fe AS (SELECT p[1] AS lat, p[2] AS lng, p[3] AS lat2, p[4] AS lng2 FROM fe0),
 fr AS (SELECT "group", heading, (lng - glng) * mx AS x, (lat - glat) * 111320.0::DOUBLE AS y, (lng2 - glng) * mx AS x2, (lat2 - glat) * 111320.0::DOUBLE AS y2, x * co + y * si AS u, y * co - x * si AS w, x2 * co + y2 * si AS u2, y2 * co - x2 * si AS w2 FROM fe, f),
 ex AS (SELECT "group", heading, min(w) AS low, max(w) - min(w) AS tall, greatest(1, CAST(ceil((max(w) - min(w)) / 6) AS INTEGER)) AS n FROM rv GROUP BY 1, 2),
 ln0 AS (SELECT *, unnest(generate_series(0, n - 1)) AS lane FROM ex WHERE tall >= 0.5), ln AS (SELECT "group", heading, CAST(lane AS INTEGER) AS lane, low + (tall - (n - 1) * 6.0::DOUBLE) / 2 + lane * 6.0::DOUBLE AS yy FROM ln0),
 cr AS (SELECT ln."group", ln.heading, lane, yy, zone_id, u + (u2 - u) * (yy - w) / (w2 - w) AS xx FROM ln JOIN rv ON rv."group" = ln."group" AND rv.heading = ln.heading WHERE (w > yy) <> (w2 > yy)),
 iv0 AS (SELECT *, lead(xx) OVER (PARTITION BY "group", heading, lane, zone_id ORDER BY xx) AS xe, row_number() OVER (PARTITION BY "group", heading, lane, zone_id ORDER BY xx) AS nth FROM cr),
 iv1 AS (SELECT *, (xx + xe) / 2 AS mid FROM iv0 WHERE nth % 2 = 1 AND xe - xx >= 1e-6),
 iv AS (SELECT iv1.* FROM iv1 WHERE (SELECT count(*) FROM fr WHERE fr."group" = iv1."group" AND fr.heading = iv1.heading AND (fr.w > yy) <> (fr.w2 > yy) AND mid < fr.u + (fr.u2 - fr.u) * (yy - fr.w) / (fr.w2 - fr.w)) % 2 = 1),
 mg0 AS (SELECT *, max(xe) OVER (PARTITION BY "group", heading, lane ORDER BY xx, xe, zone_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM iv),
 mg1 AS (SELECT *, sum(CASE WHEN far IS NULL OR xx > far + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY "group", heading, lane ORDER BY xx, xe, zone_id) AS isl FROM mg0),
 mg AS (SELECT "group", heading, lane, isl, any_value(yy) AS yy, min(xx) AS x1, max(xe) AS x2, arg_min(zone_id, [xx, xe, zone_id]) AS zone_id FROM mg1 GROUP BY 1, 2, 3, 4),
 fl AS (SELECT *, dense_rank() OVER (PARTITION BY "group", heading ORDER BY lane) % 2 = 0 AS back FROM mg),
 sg0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY "group", heading ORDER BY lane, CASE WHEN back THEN -x1 ELSE x1 END) AS INTEGER) AS nth, CASE WHEN back THEN x2 ELSE x1 END AS xa, CASE WHEN back THEN x1 ELSE x2 END AS xb FROM fl),
 sg AS (SELECT s.*, glat + (xa * si + yy * co) / 111320.0::DOUBLE AS a_lat, glng + (xa * co - yy * si) / mx AS a_lng, glat + (xb * si + yy * co) / 111320.0::DOUBLE AS b_lat, glng + (xb * co - yy * si) / mx AS b_lng FROM sg0 s JOIN f ON f."group" = s."group" AND f.heading = s.heading),
 hp AS (SELECT *, lag(b_lat) OVER w AS p_lat, lag(b_lng) OVER w AS p_lng FROM sg WINDOW w AS (PARTITION BY "group", heading ORDER BY nth)),
 hd AS (SELECT *, sqrt(((b_lat - a_lat) * 111320.0::DOUBLE) ^ 2 + ((b_lng - a_lng) * cos(radians((a_lat + b_lat) / 2)) * 111320.0::DOUBLE) ^ 2) AS own, sqrt(((a_lat - p_lat) * 111320.0::DOUBLE) ^ 2 + ((a_lng - p_lng) * cos(radians((a_lat + p_lat) / 2)) * 111320.0::DOUBLE) ^ 2) AS hop FROM hp)"""
_FENCE = ", ".join(f"[{a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE]" for (a, b), (c, d) in zip(FENCE, [*FENCE[1:], FENCE[0]], strict=True))
_ONE, _ALL = _SWEEP.format(headings="0.3::DOUBLE", fence=_FENCE), _SWEEP.format(headings=", ".join(f"{h}::DOUBLE" for h in HEADINGS), fence=_FENCE)
_AREA = "abs(sum(radians(lng2 - lng) * (2 + sin(radians(lat)) + sin(radians(lat2)))) * 6378137.0::DOUBLE * 6378137.0::DOUBLE / 2)"
_TX, _TY = "CAST(floor(({} + 180) / 360 * 2.0::DOUBLE ^ z) AS BIGINT)", "CAST(floor((1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2 * 2.0::DOUBLE ^ z) AS BIGINT)"

QUERIES = {
    f.__name__: f
    for f in (ring_axis, sweep_heading, zone_groups, group_members, headlands, headland_totals, sweep_segments, sweep_costs, swept_heading, sweep_fragments, brushed_cells, bake_tiles, bounds_union, lattice_world, overlapping_boxes, ring_measures)
}
ORACLES = {
    "ring_axis": f"WITH {_AX} SELECT zone_id, round(theta, 6) AS theta, round(anisotropy, 4) AS anisotropy FROM ax",
    "sweep_heading": f"""WITH {_AX}, r AS (SELECT zone_id, max(x * cos(theta) + y * sin(theta)) - min(x * cos(theta) + y * sin(theta)) AS al, max(y * cos(theta) - x * sin(theta)) - min(y * cos(theta) - x * sin(theta)) AS acr, any_value(theta) AS theta, any_value(anisotropy) AS anisotropy FROM xy JOIN ax USING (zone_id) GROUP BY 1),
        d AS (SELECT *, abs(asin(sin(theta - 0.2))) AS d1, abs(asin(sin(theta - 0.2 - pi() / 2))) AS d2 FROM r)
        SELECT zone_id, round(CASE WHEN greatest(al, acr) / least(al, acr) < 1.15 AND anisotropy < 1.5 THEN 0.2 WHEN least(d1, d2) <= radians(15) THEN CASE WHEN d2 < d1 THEN 0.2 + pi() / 2 ELSE 0.2 END ELSE theta END, 6) AS heading FROM d""",
    "zone_groups": _GROUPS + ' SELECT zone_id, "group" FROM grouped',
    "group_members": _GROUPS + """ SELECT "group", string_agg(zone_id::VARCHAR, ',' ORDER BY zone_id) AS members FROM grouped GROUP BY 1""",
    "headlands": f"WITH {_HEAD} SELECT zone_id, round(w, 6) AS width_m, CASE WHEN reason IS NULL THEN 'applied' ELSE 'waived' END AS kind, round(scale, 6) AS scale, reason FROM hl",
    "headland_totals": f"WITH {_HEAD} SELECT round(sum(area_m2 * scale) / 10000, 6) AS sprayed_ha, round(sum(area_m2 * scale / 10000 * rate_lha), 4) AS volume_l, count(*) FILTER (reason IS NOT NULL) AS waived FROM hl JOIN z USING (zone_id)",
    "sweep_segments": f'WITH {_ONE} SELECT "group", lane, nth, zone_id, round(a_lat, 7) AS a_lat, round(a_lng, 7) AS a_lng, round(b_lat, 7) AS b_lat, round(b_lng, 7) AS b_lng FROM sg',
    "sweep_costs": f'WITH {_ALL} SELECT "group", heading, round(sum(own + CASE WHEN hop IS NULL THEN 0 ELSE hop + 12 END), 3) AS cost_m FROM hd GROUP BY 1, 2',
    "sweep_fragments": f'WITH {_ONE}, k AS (SELECT "group", sum(CASE WHEN hop > 25 THEN 1 ELSE 0 END) OVER (PARTITION BY "group" ORDER BY nth) AS fragment FROM hd) SELECT "group", CAST(fragment AS BIGINT) AS fragment, count(*) AS segments FROM k GROUP BY 1, 2',
    "brushed_cells": f"WITH {_Z} SELECT p.zone_id AS point_id, q.zone_id AS cell_id FROM c p JOIN c q ON p.zone_id % 10 = 0 AND ((q.clat - p.clat) * 111320.0::DOUBLE) ^ 2 + ((q.clng - p.clng) * cos(radians(p.clat)) * 111320.0::DOUBLE) ^ 2 <= 3600",
    "bake_tiles": f"""WITH {_Z}, t AS (SELECT *, unnest([15, 16, 17]) AS z FROM c), u AS (SELECT zone_id, z, {_TX.format('west')} AS x0, {_TX.format('east')} AS x1, {_TY.format('north')} AS y0, {_TY.format('south')} AS y1 FROM t),
        w AS (SELECT *, unnest(generate_series(x0, x1)) AS x FROM u) SELECT zone_id, z, x, unnest(generate_series(y0, y1)) AS y FROM w""",
    "bounds_union": f"WITH {_Z} SELECT a.zone_id, round(least(a.south, b.south), 9) AS south, round(least(a.west, b.west), 9) AS west, round(greatest(a.north, b.north), 9) AS north, round(greatest(a.east, b.east), 9) AS east FROM c a LEFT JOIN c b ON b.zone_id = a.zone_id + 1 WHERE a.zone_id % 2 = 0",
    "lattice_world": """WITH p AS (SELECT s_suppkey, (s_suppkey % 31) * 6.0::DOUBLE AS x, (s_suppkey % 17) * 6.0::DOUBLE AS y FROM supplier)
        SELECT s_suppkey, round(41 + (x * sin(0.3::DOUBLE) + y * cos(0.3::DOUBLE)) / 111320.0::DOUBLE, 9) AS lat, round(-93 + (x * cos(0.3::DOUBLE) - y * sin(0.3::DOUBLE)) / (111320.0::DOUBLE * cos(radians(41))), 9) AS lng FROM p""",
    "overlapping_boxes": f"WITH {_Z} SELECT zone_id FROM c WHERE north >= 41.0001 AND south <= 41.0004 AND east >= -92.998 AND west <= -92.9953",
    "ring_measures": f"""WITH {_Z}, o AS (SELECT zone_id, lat AS olat, lng AS olng FROM v WHERE i = 1), hv AS (SELECT zone_id, (lat + olat) / 2 AS lat, (lng + olng) / 2 AS lng, (lat2 + olat) / 2 AS lat2, (lng2 + olng) / 2 AS lng2 FROM v JOIN o USING (zone_id)),
        a AS (SELECT zone_id, {_AREA} AS m2 FROM v GROUP BY 1), b AS (SELECT zone_id, {_AREA} AS m2 FROM hv GROUP BY 1) SELECT zone_id, round(clat, 9) AS lat, round(clng, 9) AS lng, round(a.m2, 3) AS m2, round(a.m2 + b.m2, 3) AS set_m2 FROM c JOIN a USING (zone_id) JOIN b USING (zone_id)""",
}
