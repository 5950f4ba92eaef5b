"""Rings of array<struct<lat,lng>> as Column expressions: axes, sweep headings, gaps, insets and widths in planar metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions import geo

#: How near the field's axis a group's axis snaps to it, the box ratio and the eigenvalue ratio from which a
#: shape has a long axis, how unlike two candidate headings are, and how many of them are tried.
SNAP_RAD = math.radians(15)
MIN_ELONGATION = 1.15
MIN_ANISOTROPY = 1.5
SAME_HEADING_RAD = 0.01
MAX_HEADINGS = 6
#: An inset of less of the ring's area than this share is no field; widths are compared with this slack. Fixed values.
COLLAPSE_SHARE = 0.01
WIDTH_SLACK_M = 1e-6

RING = "array<struct<lat:double,lng:double>>"


def _plus(s: Column, x: Column) -> Column:
    return s + x


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once: as the element of an array of one it has a name."""
    return F.transform(F.array(value), use)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), _plus)


def planar(ring: Column, origin: Column) -> Column:
    """The ring's vertices as structs x, y in metres east and north of the origin."""
    wide = geo.m_per_deg_lng(origin["lat"])
    return F.transform(ring, lambda p: F.struct(((p["lng"] - origin["lng"]) * wide).alias("x"), ((p["lat"] - origin["lat"]) * geo.M_PER_DEG).alias("y")))


def turned(points: Column, by: int = 1) -> Column:
    """The array with its first `by` elements (or its last, if negative) moved to the other end."""
    n = F.size(points)
    if by < 0:
        return F.concat(F.slice(points, n, F.lit(1)), F.slice(points, F.lit(1), n - 1))
    return F.concat(F.slice(points, F.lit(2), n - 1), F.slice(points, F.lit(1), F.lit(1)))


def axis(rings: Column) -> Column:
    """(theta, anisotropy, centre) of all vertices of an array of rings: the direction of their largest spread, and how
    many times the variance along it is that across it (infinite for points of one line)."""
    points = F.flatten(rings)
    centre = geo.vertex_mean(points)

    def moments(c: Column) -> Column:
        xy = planar(points, c)
        pick = lambda f: _sum(F.transform(xy, f))
        sxx, syy, sxy = pick(lambda p: p["x"] * p["x"]), pick(lambda p: p["y"] * p["y"]), pick(lambda p: p["x"] * p["y"])
        return F.struct(sxx.alias("xx"), syy.alias("yy"), sxy.alias("xy"), c.alias("centre"))

    def ratio(m: Column) -> Column:
        half, root = (m["xx"] + m["yy"]) / 2, F.sqrt(F.pow((m["xx"] - m["yy"]) / 2, 2) + m["xy"] * m["xy"])
        return F.struct(
            (0.5 * F.atan2(2 * m["xy"], m["xx"] - m["yy"])).alias("theta"),
            F.when(half - root > 1e-9, (half + root) / (half - root)).otherwise(F.lit(float("inf"))).alias("anisotropy"),
            m["centre"].alias("centre"),
        )

    return let(let(centre, moments), ratio)


def axis_delta(a: Column, b: Column) -> Column:
    """The turn between two axes, in size at most a right angle."""
    d = F.pmod(a - b, F.lit(math.pi))
    return F.when(d > math.pi / 2, d - math.pi).otherwise(d)


def spans(rings: Column, centre: Column, theta: Column) -> Column:
    """(along, across): metres that the rings reach along the axis and square to it."""
    xy = planar(F.flatten(rings), centre)
    u = F.transform(xy, lambda p: p["x"] * F.cos(theta) + p["y"] * F.sin(theta))
    v = F.transform(xy, lambda p: p["y"] * F.cos(theta) - p["x"] * F.sin(theta))
    return F.struct((F.array_max(u) - F.array_min(u)).alias("along"), (F.array_max(v) - F.array_min(v)).alias("across"))


def sweep_heading(rings: Column, field_theta: Column) -> Column:
    """The heading of a group of rings: its long axis, snapped to the field's axis or square to it where it is near; a group
    that is neither long nor strung out takes the field's."""

    def choose(a: Column) -> Column:
        reach = spans(rings, a["centre"], a["theta"])
        short, long_ = F.least(reach["along"], reach["across"]), F.greatest(reach["along"], reach["across"])
        square = (short <= 0) | (long_ / short < MIN_ELONGATION)
        first, second = F.abs(axis_delta(a["theta"], field_theta)), F.abs(axis_delta(a["theta"], field_theta + math.pi / 2))
        near = F.when(second < first, field_theta + math.pi / 2).otherwise(field_theta)
        snapped = F.when(F.least(first, second) <= SNAP_RAD, near).otherwise(a["theta"])
        return F.when(square & (a["anisotropy"] < MIN_ANISOTROPY), field_theta).otherwise(snapped)

    return let(axis(rings), choose)


def heading_candidates(rings: Column, field_theta: Column) -> Column:
    """Headings worth trying for a group, without near repeats and at most MAX_HEADINGS: each member's, the group's, the field's and
    square to that. A lone ring has its own only, as it is."""
    own = F.transform(rings, lambda r: sweep_heading(F.array(r), field_theta))
    raw = F.concat(own, F.array(sweep_heading(rings, field_theta), field_theta, field_theta + math.pi / 2))

    def add(kept: Column, theta: Column) -> Column:
        norm = F.pmod(theta, F.lit(math.pi))
        like = F.exists(kept, lambda o: F.abs(axis_delta(o, norm)) < SAME_HEADING_RAD)
        return F.when(like | (F.size(kept) >= MAX_HEADINGS), kept).otherwise(F.array_append(kept, norm))

    several = F.aggregate(raw, F.array().cast("array<double>"), add)
    return F.when(F.size(rings) == 1, F.slice(own, 1, 1)).otherwise(several)


def segment_distance(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Metres between the segments ab and cd (structs x, y); each parameter is clamped on its own."""
    ux, uy, vx, vy, wx, wy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"], a["x"] - c["x"], a["y"] - c["y"]
    uu, uv, vv, uw, vw = ux * ux + uy * uy, ux * vx + uy * vy, vx * vx + vy * vy, ux * wx + uy * wy, vx * wx + vy * wy
    den = uu * vv - uv * uv
    level = den < 1e-12
    s = F.when(level, 0.0).otherwise((uv * vw - vv * uw) / den)
    t = F.when(level, F.when(vv > 0, vw / vv).otherwise(0.0)).otherwise((uu * vw - uv * uw) / den)
    s, t = geo.clamp(s, 0.0, 1.0), geo.clamp(t, 0.0, 1.0)
    return F.hypot(a["x"] + ux * s - c["x"] - vx * t, a["y"] + uy * s - c["y"] - vy * t)


def ring_gap(a: Column, b: Column) -> Column:
    """Metres between two rings, edge to edge; 0 if one has a vertex in the other, infinite below three points."""
    one, two = planar(a, a[0]), planar(b, a[0])
    edges = lambda r: F.arrays_zip(r.alias("p"), turned(r).alias("q"))
    gaps = F.transform(edges(one), lambda e: F.array_min(F.transform(edges(two), lambda f: segment_distance(e["p"], e["q"], f["p"], f["q"]))))
    within = lambda r, s: F.exists(r, lambda p: geo.point_in_ring(p["lat"], p["lng"], s))
    return F.when((F.size(a) < 3) | (F.size(b) < 3), F.lit(float("inf"))).when(within(a, b) | within(b, a), F.lit(0.0)).otherwise(F.array_min(gaps))


def inset(ring: Column, by: Column) -> Column:
    """The ring with each edge moved inward by its own metres (`by`: an array, an element an edge); null below three distinct vertices.

    A new vertex is where consecutive moved edges meet; between edges of one line it lies on the second.
    """

    def moved(e: Column, left: Column) -> Column:
        dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        n, d = F.hypot(dx, dy), F.greatest(F.lit(0.0), e["d"])
        return F.struct((e["p"]["x"] - left * dy / n * d).alias("x"), (e["p"]["y"] + left * dx / n * d).alias("y"), (dx / n).alias("dx"), (dy / n).alias("dy"))

    def meet(l1: Column, l2: Column, origin: Column) -> Column:
        den = l1["dx"] * l2["dy"] - l1["dy"] * l2["dx"]
        t = ((l2["x"] - l1["x"]) * l2["dy"] - (l2["y"] - l1["y"]) * l2["dx"]) / den
        straight = F.abs(den) < 1e-9
        x, y = F.when(straight, l2["x"]).otherwise(l1["x"] + l1["dx"] * t), F.when(straight, l2["y"]).otherwise(l1["y"] + l1["dy"] * t)
        return F.struct((origin["lat"] + y / geo.M_PER_DEG).alias("lat"), (origin["lng"] + x / geo.m_per_deg_lng(origin["lat"])).alias("lng"))

    def from_edges(edges: Column, origin: Column) -> Column:
        twice = _sum(F.transform(edges, lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]))
        lines = let(F.when(twice > 0, 1.0).otherwise(-1.0), lambda left: F.transform(edges, lambda e: moved(e, left)))
        return let(lines, lambda ls: F.when(F.size(ls) >= 3, F.zip_with(turned(ls, -1), ls, lambda l1, l2: meet(l1, l2, origin))))

    def from_points(xy: Column, origin: Column) -> Column:
        raw = F.arrays_zip(xy.alias("p"), turned(xy).alias("q"), by.alias("d"))
        return let(F.filter(raw, lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]) > 1e-9), lambda edges: from_edges(edges, origin))

    sound = let(geo.vertex_mean(ring), lambda origin: let(planar(ring, origin), lambda xy: from_points(xy, origin)))
    return F.when(F.size(ring) >= 3, sound)


def headland(ring: Column, width: Column, inset_m: Column) -> Column:
    """(kind, ring, scale, reason): the ring without its headland and the share of area left, or waived and whole."""
    return headland_by_edge(ring, width, F.transform(ring, lambda p: inset_m))


def headland_by_edge(ring: Column, width: Column, by: Column) -> Column:
    """As `headland`, with the metres of each edge in the array `by`: the edge from a vertex to the next has the vertex's place. The widest counts for
    what is too narrow."""
    inset_m = F.array_max(by)

    def judge(v: Column) -> Column:
        reason = (
            F.when(ring.isNull() | (F.size(ring) < 3), "outline")
            .when(~F.coalesce(inset_m > 0, F.lit(False)), "none set")
            .when((width > 0) & (width <= inset_m * 2 + WIDTH_SLACK_M), "narrow")
            .when((v["after"] <= 0) | (v["after"] >= v["before"]) | (v["after"] < v["before"] * COLLAPSE_SHARE), "collapsed")
        )
        return let(reason, lambda why: F.struct(
            F.when(why.isNull(), "applied").otherwise("waived").alias("kind"),
            F.when(why.isNull(), v["inner"]).otherwise(ring).alias("ring"),
            F.when(why.isNull(), v["after"] / v["before"]).otherwise(F.lit(1.0)).alias("scale"),
            why.alias("reason"),
        ))

    areas = lambda inner: F.struct(inner.alias("inner"), geo.ring_area(ring).alias("before"), F.coalesce(geo.ring_area(inner), F.lit(0.0)).alias("after"))
    return let(let(inset(ring, by), areas), judge)


def interior_point(ring: Column, samples: int = 24) -> Column:
    """A place inside the ring: the mean of its vertices if that is inside, else the inside one of a grid over its box that is nearest to it; null if
    there is none."""
    steps = F.sequence(F.lit(1), F.lit(samples - 1))
    struct = lambda lat, lng: F.struct(lat.alias("lat"), lng.alias("lng"))

    def nearest(v: Column) -> Column:
        def at(i: Column, j: Column) -> Column:
            lat = v["f"]["south"] + (v["f"]["north"] - v["f"]["south"]) * i / samples
            lng = v["f"]["west"] + (v["f"]["east"] - v["f"]["west"]) * j / samples
            far = geo.planar_distance(v["c"]["lat"], v["c"]["lng"], lat, lng)
            return F.struct(far.alias("d"), i.alias("i"), j.alias("j"), lat.alias("lat"), lng.alias("lng"))

        grid = F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: at(i, j))))
        best = F.array_min(F.filter(grid, lambda p: geo.point_in_ring(p["lat"], p["lng"], ring)))
        found = let(best, lambda b: F.when(b.isNotNull(), struct(b["lat"], b["lng"])))
        return F.when(geo.point_in_ring(v["c"]["lat"], v["c"]["lng"], ring), v["c"]).otherwise(found)

    whole = let(F.struct(geo.vertex_mean(ring).alias("c"), geo.footprint(ring).alias("f")), nearest)
    return F.when(F.size(ring) >= 3, whole)
