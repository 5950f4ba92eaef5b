"""Geometry as Column expressions. Each radius belongs to its own operator; they are never shared."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Area radius, planar metres a degree, radius of site matching, square metres an acre.
AREA_RADIUS_M = 6378137.0
M_PER_DEG = 111320.0
SITE_RADIUS_M = 6371000.0
M2_PER_ACRE = 4046.8564224


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def m_per_deg_lng(lat: Column) -> Column:
    return F.cos(F.radians(lat)) * M_PER_DEG


def planar_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on a plane at the middle latitude."""
    dy = (lat2 - lat1) * M_PER_DEG
    dx = (lng2 - lng1) * m_per_deg_lng((lat1 + lat2) / 2)
    return F.sqrt(dx * dx + dy * dy)


def site_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Equirectangular metres, as sites are matched."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    x = dlng * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dlat * dlat + x * x) * SITE_RADIUS_M


def rotate(lat: Column, lng: Column, lat0: Column, lng0: Column, cos: float, sin: float) -> tuple[Column, Column]:
    """A point turned about a centre in planar metres at the centre's latitude: (lat, lng)."""
    scale = m_per_deg_lng(lat0) / M_PER_DEG
    y, x = lat - lat0, (lng - lng0) * scale
    return lat0 + x * sin + y * cos, lng0 + (x * cos - y * sin) / scale


def next_vertices(ring: Column) -> Column:
    """The ring turned by one vertex."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def ring_area(ring: Column) -> Column:
    """Square metres of array<struct<lat,lng>>; 0 below three points."""
    part = F.zip_with(ring, next_vertices(ring), lambda p, q: F.radians(q["lng"] - p["lng"]) * (2 + F.sin(F.radians(p["lat"])) + F.sin(F.radians(q["lat"]))))
    total = F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(ring) >= 3, F.abs(total * AREA_RADIUS_M * AREA_RADIUS_M / 2)).otherwise(F.lit(0.0))


def rings_area(rings: Column) -> Column:
    return F.aggregate(F.transform(rings, ring_area), F.lit(0.0), lambda s, x: s + x)


def point_in_ring(lat: Column, lng: Column, ring: Column) -> Column:
    """Parity of edge crossings; no UDF, so the test stays in the join's generated code."""

    def crosses(p: Column, q: Column) -> Column:
        at = (q["lng"] - p["lng"]) * (lat - p["lat"]) / (q["lat"] - p["lat"] + 1e-12) + p["lng"]
        return F.when(((p["lat"] > lat) != (q["lat"] > lat)) & (lng < at), 1).otherwise(0)

    hits = F.zip_with(ring, next_vertices(ring), crosses)
    return F.aggregate(hits, F.lit(0), lambda s, x: s + x) % 2 == 1


def vertex_mean(ring: Column) -> Column:
    """Mean of the vertices, not the area's centroid."""
    n = F.size(ring)
    mean = lambda name: F.aggregate(F.transform(ring, lambda p: p[name]), F.lit(0.0), lambda s, x: s + x) / n
    return F.struct(mean("lat").alias("lat"), mean("lng").alias("lng"))


def tile_x(lng: Column, zoom: int) -> Column:
    return F.floor((lng + 180) / 360 * 2**zoom)


def tile_y(lat: Column, zoom: int) -> Column:
    rad = F.radians(lat)
    return F.floor((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * 2**zoom)


def tile_corner(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """North-west corner: (lat, lng)."""
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / 2**zoom)))), x / 2**zoom * 360 - 180


def segment_crossing(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Parameter along ab where it crosses cd, null if they are parallel or miss; points are (x, y) Columns."""
    rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    den = rx * sy - ry * sx
    t = ((c[0] - a[0]) * sy - (c[1] - a[1]) * sx) / den
    u = ((c[0] - a[0]) * ry - (c[1] - a[1]) * rx) / den
    return F.when((F.abs(den) >= 1e-14) & t.between(0, 1) & u.between(0, 1), t)


def bounds_overlap(n1, s1, e1, w1, n2, s2, e2, w2) -> Column:
    """Touching counts."""
    return (s1 <= n2) & (n1 >= s2) & (w1 <= e2) & (e1 >= w2)


def coverage(n1, s1, e1, w1, n2, s2, e2, w2) -> Column:
    """How the second box covers the first: full, partial, none; unknown where an edge is missing."""
    unknown = n1.isNull() | s1.isNull() | e1.isNull() | w1.isNull() | n2.isNull() | s2.isNull() | e2.isNull() | w2.isNull()
    full = (n2 >= n1) & (s2 <= s1) & (e2 >= e1) & (w2 <= w1)
    return F.when(unknown, "unknown").when(full, "full").when(bounds_overlap(n1, s1, e1, w1, n2, s2, e2, w2), "partial").otherwise("none")


def ring_wkt(ring: Column, srid: int | None = None) -> Column:
    """POLYGON text in the order lng lat, closed; null below three points."""
    points = F.transform(ring, lambda p: F.concat_ws(" ", p["lng"].cast("string"), p["lat"].cast("string")))
    closed = F.when(F.element_at(points, 1) == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
    prefix = f"SRID={srid};POLYGON((" if srid else "POLYGON(("
    return F.when(F.size(ring) >= 3, F.concat(F.lit(prefix), F.array_join(closed, ", "), F.lit("))")))


def metres_per_pixel(lat: Column, zoom: int) -> Column:
    return F.cos(F.radians(lat)) * (2 * math.pi * AREA_RADIUS_M / 256 / 2**zoom)


def footprint(ring: Column) -> Column:
    """The ring's box as south, west, north, east."""
    lat, lng = ring.getField("lat"), ring.getField("lng")
    return F.struct(F.array_min(lat).alias("south"), F.array_min(lng).alias("west"), F.array_max(lat).alias("north"), F.array_max(lng).alias("east"))


def geojson(ring: Column) -> Column:
    """A Polygon as GeoJSON text, closed, in the order lng lat."""
    points = F.transform(ring, lambda p: F.array(p["lng"], p["lat"]))
    closed = F.when(F.element_at(points, 1) == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")))


def bounds_union(a: Column, b: Column) -> Column:
    """The box of two boxes (south, west, north, east); a missing one counts for nothing, and two missing ones give none."""
    low = lambda c: F.least(a[c], b[c]).alias(c)
    high = lambda c: F.greatest(a[c], b[c]).alias(c)
    return F.when(a.isNotNull() | b.isNotNull(), F.struct(low("south"), low("west"), high("north"), high("east")))


def lattice_world(col: Column, row: Column, size_m: Column, lat0: Column, lng0: Column, heading: float) -> tuple[Column, Column]:
    """Where a corner of a lattice lies that is turned by `heading` about its origin: (lat, lng)."""
    lat, lng = lat0 + row * (size_m / M_PER_DEG), lng0 + col * (size_m / m_per_deg_lng(lat0))
    return rotate(lat, lng, lat0, lng0, math.cos(heading), math.sin(heading))
