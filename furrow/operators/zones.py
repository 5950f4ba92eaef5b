"""Zones of one rate: grouping by ring gap, sweeps along a heading, headings by cost, headlands, hits and brushes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions import geo, rings
from furrow.functions import kernels as kn
from furrow.operators.graph import connected_components

#: Travel that an interruption costs, in lane spacings; intervals nearer than this (metres) touch. Fixed values.
HOP_PENALTY_SPACINGS = 2
TOUCH_M = 1e-6


def near_rings(zones: DataFrame, distance_m: float, id_col: str = "zone_id", ring: str = "ring", rate: str = "rate_lha") -> DataFrame:
    """Pairs (a, b), a < b, of zones of one rate (to four decimals; none is a rate) whose rings are at most `distance_m` apart.

    Boxes grown by half the distance stand in buckets, so the join is on bucket and rate; a pair is tested once, in the first
    bucket that both stand in, and the exact gap only where the boxes meet. Rates meet bucket by bucket, so a frequent rate spreads.
    """
    key = F.coalesce(F.format_string("%.4f", F.when(~F.isnan(rate), F.col(rate).cast("double"))), F.lit("none"))
    half = distance_m / 2 / geo.M_PER_DEG
    r = zones.filter(F.size(ring) >= 3).select(F.col(id_col).alias("id"), F.col(ring).alias("ring"), key.alias("rate"))
    box = r.select("*", geo.footprint(F.col("ring")).alias("f"))
    pad = half / F.greatest(F.lit(0.01), F.cos(F.radians(F.greatest(F.abs("f.south"), F.abs("f.north")))))
    box = box.select("id", "ring", "rate", (F.col("f.south") - half).alias("s"), (F.col("f.north") + half).alias("n"), (F.col("f.west") - pad).alias("w"), (F.col("f.east") + pad).alias("e"))
    size = F.lit(max(4 * half, 1e-4))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    placed = box.withColumn("by", F.explode(span("s", "n"))).withColumn("bx", F.explode(span("w", "e")))
    one, two = placed.alias("p"), placed.alias("q")
    meet = (F.col("p.rate") == F.col("q.rate")) & (F.col("p.by") == F.col("q.by")) & (F.col("p.bx") == F.col("q.bx")) & (F.col("p.id") < F.col("q.id"))
    first = (F.floor(F.greatest("p.s", "q.s") / size) == F.col("p.by")) & (F.floor(F.greatest("p.w", "q.w") / size) == F.col("p.bx"))
    boxes = geo.bounds_overlap(F.col("p.n"), F.col("p.s"), F.col("p.e"), F.col("p.w"), F.col("q.n"), F.col("q.s"), F.col("q.e"), F.col("q.w"))
    return one.join(two, meet & first & boxes).filter(rings.ring_gap(F.col("p.ring"), F.col("q.ring")) <= distance_m).select(F.col("p.id").alias("src"), F.col("q.id").alias("dst"))


def zone_groups(zones: DataFrame, distance_m: float, id_col: str = "zone_id", ring: str = "ring", rate: str = "rate_lha") -> DataFrame:
    """Zones with `group`, the smallest id of those that are joined over any number of gaps of at most `distance_m`; a distance of
    0 or less joins nothing. Zones below three points go."""
    usable = zones.filter(F.size(ring) >= 3)
    if not distance_m > 0:
        return usable.withColumn("group", F.col(id_col))
    labels = connected_components(near_rings(zones, distance_m, id_col, ring, rate))
    return usable.join(labels, usable[id_col] == labels["node"], "left").withColumn("group", F.coalesce("component", id_col)).drop("node", "component")


def group_rows(grouped: DataFrame, id_col: str = "zone_id", ring: str = "ring") -> DataFrame:
    """A row a group, in the order of members' ids: (group, members, rings). A group is what one sweep flies, which its mission bounds."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(ring).alias("ring"))))
    return grouped.groupBy("group").agg(listed.alias("m")).select("group", F.col("m.id").alias("members"), F.col("m.ring").alias("rings")).orderBy("group")


def sweep_along(groups: DataFrame, boundary: Column, step_m: float, heading: Column, *keys: str) -> DataFrame:
    """(keys, lane, nth, zone_id, a, b): sprayed segments of lanes `step_m` apart along the heading, in the order they are flown.

    `groups` has members and rings. Lanes are centred on the group; a lane is cut by each ring, parts whose middle isn't in the ring
    and in one of the boundary's rings (a Column of rings) go, parts that touch are one and carry the first zone, and each other lane runs back.
    """
    centre = geo.vertex_mean(F.flatten("rings"))
    g = groups.select(*keys, "members", "rings", boundary.alias("__fence"), heading.alias("__theta"), centre.alias("__c"))
    u = lambda p: p["x"] * F.cos("__theta") + p["y"] * F.sin("__theta")
    v = lambda p: p["y"] * F.cos("__theta") - p["x"] * F.sin("__theta")
    flat = lambda r: F.transform(rings.planar(r, F.col("__c")), lambda p: F.struct(u(p).alias("lng"), v(p).alias("lat")))
    g = g.withColumns({"__own": F.transform("rings", flat), "__fence": F.transform("__fence", flat)})
    vs = F.flatten("__own")["lat"]
    low, tall = F.array_min(vs), F.array_max(vs) - F.array_min(vs)
    lanes = F.greatest(F.lit(1), F.ceil(tall / step_m)).cast("int")
    g = g.withColumns({"__low": low, "__tall": tall, "__n": lanes}).filter(F.col("__tall") >= 0.5)
    g = g.withColumn("__lane", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    g = g.withColumn("__y", F.col("__low") + (F.col("__tall") - (F.col("__n") - 1) * step_m) / 2 + F.col("__lane") * step_m)
    m = g.select(*keys, "__c", "__theta", "__fence", "__lane", "__y", F.explode(F.arrays_zip(F.col("members").alias("id"), F.col("__own").alias("ring"))).alias("m"))
    y, ring = F.col("__y"), F.col("m.ring")
    met = F.zip_with(ring, rings.turned(ring), lambda p, q: F.when((p["lat"] > y) != (q["lat"] > y), p["lng"] + (q["lng"] - p["lng"]) * (y - p["lat"]) / (q["lat"] - p["lat"])))
    m = m.withColumn("__x", F.array_sort(F.filter(met, lambda x: x.isNotNull()))).filter(F.size("__x") >= 2)
    m = m.select("*", F.explode(F.arrays_zip(F.slice("__x", F.lit(1), F.size("__x") - 1).alias("x1"), F.slice("__x", F.lit(2), F.size("__x") - 1).alias("x2"))).alias("s"))
    middle = (F.col("s.x1") + F.col("s.x2")) / 2
    inside = geo.point_in_ring(y, middle, ring) & F.exists("__fence", lambda r: geo.point_in_ring(y, middle, r))
    cut = m.filter((F.col("s.x2") - F.col("s.x1") >= TOUCH_M) & inside).select(*keys, "__c", "__theta", "__lane", "__y", F.col("m.id").alias("zone_id"), F.col("s.x1").alias("x1"), F.col("s.x2").alias("x2"))
    lane = Window.partitionBy(*keys, "__lane").orderBy("x1", "x2", "zone_id")
    reach = F.max("x2").over(lane.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((reach.isNull() | (F.col("x1") > reach + TOUCH_M)).cast("int")).over(lane)
    runs = cut.withColumn("__i", island).groupBy(*keys, "__lane", "__i").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min_by("zone_id", F.struct("x1", "x2", "zone_id")).alias("zone_id"), *[F.first(c).alias(c) for c in ("__c", "__theta", "__y")])
    per = Window.partitionBy(*keys).orderBy("__lane")
    flown = runs.withColumn("__flip", F.dense_rank().over(per) % 2 == 0)
    back = lambda x: F.struct(
        (F.col("__c.lat") + (x * F.sin("__theta") + F.col("__y") * F.cos("__theta")) / geo.M_PER_DEG).alias("lat"),
        (F.col("__c.lng") + (x * F.cos("__theta") - F.col("__y") * F.sin("__theta")) / geo.m_per_deg_lng(F.col("__c.lat"))).alias("lng"),
    )
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("__lane", F.when(F.col("__flip"), -F.col("x1")).otherwise(F.col("x1"))))
    return flown.select(
        *keys, F.col("__lane").alias("lane"), nth.alias("nth"), "zone_id",
        back(F.when(F.col("__flip"), F.col("x2")).otherwise(F.col("x1"))).alias("a"), back(F.when(F.col("__flip"), F.col("x1")).otherwise(F.col("x2"))).alias("b"),
    )


def sweep_costs(segments: DataFrame, spacing_m: float, *keys: str) -> DataFrame:
    """(keys, cost_m): ground covered, with the hops between segments, and a fixed charge an interruption."""
    before = F.lag("b").over(Window.partitionBy(*keys).orderBy("nth"))
    d = lambda p, q: geo.planar_distance(p["lat"], p["lng"], q["lat"], q["lng"])
    hop = segments.withColumn("__before", before)
    cost = d(F.col("a"), F.col("b")) + F.when(F.col("__before").isNotNull(), d(F.col("__before"), F.col("a")) + HOP_PENALTY_SPACINGS * spacing_m).otherwise(0.0)
    return hop.groupBy(*keys).agg(F.sum(cost).alias("cost_m"))


def field_sweep(groups: DataFrame, boundary: Column, field_theta: Column, spacing_m: float, repeats: int = 1) -> DataFrame:
    """(group, heading, lane, nth, zone_id, a, b) along the heading of least cost; a later candidate must gain over a millionth of a metre."""
    spacing = max(0.5, spacing_m)
    tried = groups.select("group", "members", "rings", boundary.alias("fence"), F.posexplode(rings.heading_candidates(F.col("rings"), field_theta)).alias("try", "heading"))
    segments = sweep_along(tried, F.col("fence"), spacing / max(1, repeats), F.col("heading"), "group", "try", "heading")
    costs = sweep_costs(segments, spacing, "group", "try", "heading")
    best = costs.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("try", "cost_m"))).alias("c"))
    first = F.aggregate(F.slice("c", F.lit(2), F.size("c") - 1), F.col("c")[0], lambda b, x: F.when(x["cost_m"] < b["cost_m"] - 1e-6, x).otherwise(b))
    return segments.join(best.select("group", first["try"].alias("try")), ["group", "try"]).drop("try")


def split_on_hops(segments: DataFrame, longest_m: float, *keys: str) -> DataFrame:
    """Append `fragment`, from 0: it counts up where the hop from the segment before is longer than `longest_m`."""
    w = Window.partitionBy(*keys).orderBy("nth")
    p, q = F.lag("b").over(w), F.col("a")
    far = geo.planar_distance(F.col("__p.lat"), F.col("__p.lng"), q["lat"], q["lng"]) > longest_m
    return segments.withColumn("__p", p).withColumn("fragment", F.sum(F.coalesce(far, F.lit(False)).cast("int")).over(w)).drop("__p")


def with_width(zones: DataFrame, ring: str = "ring", out: str = "width_m") -> DataFrame:
    """Append the metres between the nearest parallels that hold each ring. A hull takes steps that no expression has, so this
    runs over Arrow batches, between projections and not inside one."""
    schema = T.StructType([f for f in zones.schema if f.name != out] + [T.StructField(out, T.DoubleType())])
    kept = [f.name for f in schema][:-1]
    xy = rings.let(geo.vertex_mean(F.col(ring)), lambda origin: rings.planar(F.col(ring), origin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]).astype(int)
            points = np.column_stack([flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)])
            widths = [kn.least_width(points[a:z]) if z - a > 2 else 0.0 for a, z in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(widths, pa.float64())], names=[*kept, out])

    return zones.select(*kept, xy.alias("__xy")).mapInArrow(run, schema)


def headland_totals(zones: DataFrame, inset_m: Column, ring: str = "ring", area: str = "area_m2", rate: str = "rate_lha") -> DataFrame:
    """One row: hectares and litres left inside the headland, and how many zones it was waived for."""
    h = with_width(zones, ring, "__w").withColumn("__h", rings.headland(F.col(ring), F.col("__w"), inset_m))
    left = F.col(area) * F.col("__h.scale")
    return h.agg((F.sum(left) / 10_000).alias("sprayed_ha"), F.sum(left / 10_000 * F.col(rate)).alias("volume_l"), F.count_if(F.col("__h.kind") == "waived").alias("waived"))


def cells_near(cells: DataFrame, points: DataFrame, radius_m: float, cell_id: str = "cell_id", point_id: str = "point_id") -> DataFrame:
    """(point, cell) of cells whose centre (lat, lng) lies within the radius of a brush point; buckets are as tall as the radius."""
    size = radius_m / geo.M_PER_DEG
    wide = F.ceil(1 / F.greatest(F.lit(0.01), F.cos(F.radians(F.abs(F.col("p_lat")) + size)))).cast("int")
    p = points.select(F.col(point_id), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    p = p.withColumn("by", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.floor(F.col("p_lat") / size) + d)))
    p = p.withColumn("bx", F.explode(F.transform(F.sequence(-wide, wide), lambda d: F.floor(F.col("p_lng") / size) + d)))
    c = cells.select(F.col(cell_id), "lat", "lng", F.floor(F.col("lat") / size).alias("cy"), F.floor(F.col("lng") / size).alias("cx"))
    dy, dx = (F.col("lat") - F.col("p_lat")) * geo.M_PER_DEG, (F.col("lng") - F.col("p_lng")) * geo.m_per_deg_lng(F.col("p_lat"))
    return p.join(c, (F.col("by") == F.col("cy")) & (F.col("bx") == F.col("cx"))).filter(dx * dx + dy * dy <= radius_m * radius_m).select(point_id, cell_id)


def tile_list(bounds: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """The tiles (z, x, y) over the boxes (west, south, east, north) for each zoom, in the order in which a bake resumes."""
    out = bounds.withColumn("z", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))
    two = F.pow(F.lit(2.0), F.col("z"))
    x = lambda c: F.floor((F.col(c) + 180) / 360 * two)
    y = lambda c: F.floor((1 - F.log(F.tan(F.radians(c)) + 1 / F.cos(F.radians(c))) / math.pi) / 2 * two)
    span = lambda a, b: F.sequence(F.least(a, b), F.greatest(a, b))
    out = out.withColumn("x", F.explode(span(x("west"), x("east")))).withColumn("y", F.explode(span(y("north"), y("south"))))
    return out.drop("west", "south", "east", "north")
