"""Spatial joins and lattices. Range conditions become equi-joins on grid buckets, so nothing is crossed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import geo
from furrow.operators.graph import connected_components
from furrow.session import dealt, ensure_checkpoint_dir

#: Cell numbers are packed into one long: two signed halves of 31 bits.
HALF = 1 << 30
#: Sites of a cell that are compared one by one, the size in metres from which no cell is cut, and what rounding may take from a bound.
LEAF_SITES, FINEST_M, SLACK = 32, 1e-8, 1e-9


def cell_key(col: Column, row: Column) -> Column:
    return (col.cast("long") + HALF) * (2 * HALF) + (row.cast("long") + HALF)


def cell_of(key: Column) -> tuple[Column, Column]:
    return F.floor(key / (2 * HALF)) - HALF, key % (2 * HALF) - HALF


def points_in_rings(points: DataFrame, rings: DataFrame, lat: str = "lat", lng: str = "lng", ring: str = "ring") -> DataFrame:
    """Pairs of points and rings that hold them, joined on buckets; the box test comes before the ray cast.

    A ring's bucket is as wide as its box, up to the next power of two, so it stands in four buckets at most, and a point in one
    of each width that some ring has: small rings among large ones neither fill many buckets nor share a few.
    """
    box = {f"__{f}_{c}": getattr(F, f"array_{f}")(F.col(ring).getField(c)) for f in ("min", "max") for c in ("lat", "lng")}
    wide = F.greatest(F.col("__max_lat") - F.col("__min_lat"), F.col("__max_lng") - F.col("__min_lng"), F.lit(1e-9))
    r = rings.withColumns(box).filter("__min_lat IS NOT NULL").withColumn("__level", F.ceil(F.log2(wide)).cast("int"))
    levels = sorted(row[0] for row in r.select("__level").distinct().collect())  # as many as box sizes have powers of two
    size = F.pow(F.lit(2.0), F.col("__level"))
    span = lambda c: F.sequence(F.floor(F.col(f"__min_{c}") / size), F.floor(F.col(f"__max_{c}") / size))
    r = r.withColumn("__by", F.explode(span("lat"))).withColumn("__bx", F.explode(span("lng")))
    p = points.withColumn("__at", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")))
    place = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__at")))
    p = p.withColumns({"__py": place(lat), "__px": place(lng)})
    near = (F.col("__at") == F.col("__level")) & (F.col("__py") == F.col("__by")) & (F.col("__px") == F.col("__bx"))
    inside = F.col(lat).between(F.col("__min_lat"), F.col("__max_lat")) & F.col(lng).between(F.col("__min_lng"), F.col("__max_lng"))
    hit = p.join(r, near & inside).filter(geo.point_in_ring(F.col(lat), F.col(lng), F.col(ring)))
    return hit.drop("__at", "__level", "__by", "__bx", "__py", "__px", *box)


def nearest_within(points: DataFrame, sites: DataFrame, radius_m: float, id_col: str = "id", site_id: str = "site_id") -> DataFrame:
    """(id, site_id, distance) of the nearest site within the radius, ties to the smaller site id.

    Places are matched, not rows, so copies cost nothing. Sites lie in cells as tall and wide as the radius; a cell of more than
    LEAF_SITES is cut into 16, and so on. The sites of a place's own smallest cell give a first bound. Then a place meets the cells
    about it (more where meridians converge) and goes down only into those that neither the bound nor the farthest site of another
    cell rules out, so dense sites add steps, a power of 16 each, and few pairs.
    """
    ensure_checkpoint_dir(sites.sparkSession)
    size = radius_m / geo.SITE_RADIUS_M * 180 / math.pi * 1.001
    finite = lambda df: df.filter((F.abs("lat") < math.inf) & (F.abs("lng") < math.inf))
    spots = finite(sites).groupBy("lat", "lng").agg(F.min(site_id).alias(site_id)).checkpoint()
    # Powers of two scale exactly, so cells nest.
    cell = lambda c, depth: F.floor(F.col(c) / size * F.pow(F.lit(4.0), depth))
    box = {f"{f}_{c}": getattr(F, f)(c) for c in ("lat", "lng") for f in ("min", "max")}

    def nodes(depth: int) -> DataFrame:
        keys = [cell(c, F.lit(depth)).alias(k) for c, k in (("lat", "cy"), ("lng", "cx"))]
        return spots.groupBy(*keys).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in box.items()])

    def reach() -> dict[str, Column]:
        """No site of the box is nearer than `near` or farther than `far`."""
        gap = lambda c: F.greatest(F.col(f"min_{c}") - F.col(c), F.col(c) - F.col(f"max_{c}"), F.lit(0.0))
        span = lambda c: F.greatest(F.col(f"max_{c}") - F.col(c), F.col(c) - F.col(f"min_{c}"))
        turn = F.radians(span("lat")) / 2  # the mean latitude is so far from the place's at most, and its cosine no farther
        narrow, broad = F.greatest(F.lit(0.0), F.col("k") - turn), F.least(F.lit(1.0), F.col("k") + turn)
        metres = lambda y, x: F.sqrt(y * y + x * x) * geo.SITE_RADIUS_M
        near = metres(F.radians(gap("lat")), F.radians(gap("lng")) * narrow) * (1 - SLACK)
        return {"near": near, "far": metres(F.radians(span("lat")), F.radians(span("lng")) * broad) * (1 + SLACK)}

    def open_to(met: DataFrame) -> DataFrame:
        best = F.least("best", F.min("far").over(Window.partitionBy("lat", "lng")))
        return met.filter("near <= best").withColumn("best", best).filter("near <= best")

    levels = [nodes(0)]
    while radius_m > FINEST_M * 4 ** (len(levels) - 1) and (levels[-1].agg(F.max("n")).first()[0] or 0) > LEAF_SITES:
        levels.append(nodes(len(levels)))
    last = len(levels) - 1
    depths = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("depth")
    cells = {"cy": cell("lat", F.col("depth")), "cx": cell("lng", F.col("depth"))}
    leaves = levels[last].select(F.lit(last).alias("depth"), "cy", "cx")
    for depth in range(last):
        leaves = leaves.unionByName(levels[depth].filter(F.col("n") <= LEAF_SITES).select(F.lit(depth).alias("depth"), "cy", "cx"))
    homes = spots.select("*", depths).withColumns(cells).join(leaves, ["depth", "cy", "cx"]).groupBy("lat", "lng", site_id).agg(F.min("depth").alias("depth"))
    homes = homes.withColumns(cells).withColumnsRenamed({"lat": "s_lat", "lng": "s_lng"}).checkpoint()
    d = geo.site_distance(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng"))
    places = finite(points).select("lat", "lng").distinct()
    own = places.select("*", depths).withColumns(cells).join(homes, ["depth", "cy", "cx"]).groupBy("lat", "lng").agg(F.min(d).alias("best"))
    bound = F.least(F.lit(float(radius_m)), F.col("best") * (1 + SLACK))  # least skips nulls
    places = dealt(places.join(own, ["lat", "lng"], "left").select("lat", "lng", F.abs(F.cos(F.radians("lat"))).alias("k"), bound.alias("best")), "lat", "lng")
    places = places.withColumns({"py": cell("lat", F.lit(0)), "px": cell("lng", F.lit(0))})
    wide = F.ceil(1 / F.greatest(F.cos(F.radians(F.greatest(F.abs("min_lat"), F.abs("max_lat")) + size)), F.lit(0.01))).cast("int")
    about = levels[0].withColumn("py", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
    about = about.withColumn("px", F.explode(F.sequence(F.col("cx") - wide, F.col("cx") + wide)))
    met = open_to(places.join(about, ["py", "px"]).withColumns({**reach(), "depth": F.lit(0)}).drop("py", "px", *box))
    for depth in range(1, last + 1):
        inner = levels[depth].select(F.shiftright("cy", 2).alias("py"), F.shiftright("cx", 2).alias("px"), F.col("cy").alias("iy"), F.col("cx").alias("ix"), F.col("n").alias("m"), *box)
        cut = (F.col("depth") == depth - 1) & (F.col("n") > LEAF_SITES)
        down = met.join(inner, cut & (F.col("cy") == F.col("py")) & (F.col("cx") == F.col("px")), "left")
        new = {**reach(), "depth": F.lit(depth), "cy": F.col("iy"), "cx": F.col("ix"), "n": F.col("m")}
        met = open_to(down.select("lat", "lng", "k", "best", *[F.when(F.col("m").isNotNull(), v).otherwise(F.col(k)).alias(k) for k, v in new.items()]))
    pairs = met.select("lat", "lng", "depth", "cy", "cx").join(homes, ["depth", "cy", "cx"]).withColumn("distance", d).filter(F.col("distance") <= radius_m)
    found = pairs.groupBy("lat", "lng").agg(F.min(F.struct("distance", site_id)).alias("m"))
    best = points.select(id_col, "lat", "lng").join(found, ["lat", "lng"]).groupBy(id_col).agg(F.min("m").alias("m"))
    return best.select(id_col, f"m.{site_id}", "m.distance")


def match_site(missions: DataFrame, sites: DataFrame, radius_m: float = 2000.0) -> DataFrame:
    """(mission_id, site_id): the mission's own field if it is a site, however far, else the nearest in the radius."""
    own = missions.join(sites.select("site_id"), F.col("field_id") == F.col("site_id"), "left").select("mission_id", F.col("site_id").alias("own"), "lat", "lng")
    near = nearest_within(own.filter("own IS NULL AND lat IS NOT NULL AND lng IS NOT NULL"), sites, radius_m, "mission_id")
    joined = own.join(near, "mission_id", "left")
    return joined.select("mission_id", F.coalesce("own", "site_id").alias("site_id"))


def adjacent_cells(cells: DataFrame, *same: str) -> DataFrame:
    """Edges (src, dst) between 4-adjacent cells (col, row) with equal values; an equi-join on the neighbour's key."""
    here = cells.select(cell_key(F.col("col"), F.col("row")).alias("src"), *same)
    right = cells.select(cell_key(F.col("col"), F.col("row")).alias("src"), cell_key(F.col("col") + 1, F.col("row")).alias("dst"), *same)
    down = cells.select(cell_key(F.col("col"), F.col("row")).alias("src"), cell_key(F.col("col"), F.col("row") + 1).alias("dst"), *same)
    to = here.withColumnRenamed("src", "dst")
    return right.unionByName(down).join(to, ["dst", *same]).select("src", "dst")


def cell_components(cells: DataFrame, *same: str) -> DataFrame:
    """(col, row, *same, component): the smallest cell key of the connected zone; lone cells are their own."""
    labels = connected_components(adjacent_cells(cells, *same))
    keyed = cells.select("col", "row", *same, cell_key(F.col("col"), F.col("row")).alias("key"))
    return keyed.join(labels, keyed["key"] == labels["node"], "left").select("col", "row", *same, F.coalesce("component", "key").alias("component"))


def row_strips(cells: DataFrame, *keys: str) -> DataFrame:
    """Runs of adjacent cells in a row: (keys, row, first_col, last_col)."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    runs = cells.withColumn("island", F.col("col") - F.row_number().over(w)).groupBy(*keys, "row", "island")
    return runs.agg(F.min("col").alias("first_col"), F.max("col").alias("last_col")).drop("island")


def outline_edges(cells: DataFrame, *keys: str) -> DataFrame:
    """Cell sides that belong to one cell of a zone only, as (keys, x1, y1, x2, y2); shared sides cancel."""
    x, y = F.col("col"), F.col("row")
    side = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    sides = F.array(side(x, y, x + 1, y), side(x, y + 1, x + 1, y + 1), side(x, y, x, y + 1), side(x + 1, y, x + 1, y + 1))
    long = cells.select(*keys, F.explode(sides).alias("e")).select(*keys, "e.*")
    return long.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.count("*").alias("n")).filter("n = 1").drop("n")


def proximity_groups(points: DataFrame, distance: float, rate: str = "rate", id_col: str = "id") -> DataFrame:
    """(id, group): transitive clusters of points of one rate (null is a rate) within a planar distance.

    A distance of 0 or less leaves every point alone. Buckets are as wide as the distance; of each pair of buckets
    only half is looked up.
    """
    if distance <= 0:
        return points.select(id_col, F.col(id_col).alias("group"))
    p = points.select(F.col(id_col), F.col("x"), F.col("y"), F.col(rate).alias("r"), F.floor(F.col("x") / distance).alias("bx"), F.floor(F.col("y") / distance).alias("by"))
    half = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    left = p.withColumn("n", F.explode(half)).select(F.col(id_col).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "r", (F.col("bx") + F.col("n.dx")).alias("bx"), (F.col("by") + F.col("n.dy")).alias("by"))
    right = p.select(F.col(id_col).alias("b"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("r").alias("r2"), F.col("bx").alias("bx2"), F.col("by").alias("by2"))
    near = (F.col("bx") == F.col("bx2")) & (F.col("by") == F.col("by2")) & F.col("r").eqNullSafe(F.col("r2")) & (F.col("a") != F.col("b"))
    dx, dy = F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    edges = left.join(right, near & (dx * dx + dy * dy <= distance * distance)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    labels = connected_components(edges)
    return points.join(labels, points[id_col] == labels["node"], "left").select(id_col, F.coalesce("component", points[id_col]).alias("group"))


def migrate_cells(old: DataFrame, size_old: float, size_new: float, cos: float, sin: float, new_cells: DataFrame) -> DataFrame:
    """Claims of old cells on a rotated lattice: (col, row, new_col, new_row, dist2, landed); one row an old cell."""
    cx, cy = (F.col("col") + 0.5) * size_old, (F.col("row") + 0.5) * size_old
    rx, ry = cx * cos + cy * sin, cy * cos - cx * sin
    moved = old.withColumns({"new_col": F.floor(rx / size_new), "new_row": F.floor(ry / size_new)})
    dx, dy = rx - (F.col("new_col") + 0.5) * size_new, ry - (F.col("new_row") + 0.5) * size_new
    moved = moved.withColumn("dist2", dx * dx + dy * dy)
    known = new_cells.select(F.col("col").alias("new_col"), F.col("row").alias("new_row")).distinct().withColumn("landed", F.lit(True))
    return moved.join(known, ["new_col", "new_row"], "left").withColumn("landed", F.coalesce("landed", F.lit(False)))


def resolve_claims(claims: DataFrame, rank: str = "rank", ordinal: str = "ordinal") -> DataFrame:
    """The winner of each new cell: higher rank, then nearer, then earlier."""
    order = Window.partitionBy("new_col", "new_row").orderBy(F.col(rank).desc(), "dist2", ordinal)
    return claims.filter("landed").withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def migration_counts(claims: DataFrame, confirm_above: float = 0.3) -> DataFrame:
    n = claims.agg(F.count("*").alias("decided"), F.count_if("landed").alias("moved"))
    lost = F.col("decided") - F.col("moved")
    share = F.when(F.col("decided") > 0, lost / F.col("decided")).otherwise(F.lit(0.0))
    return n.select("decided", "moved", lost.alias("lost"), share.alias("loss"), (share > confirm_above).alias("confirm"))


def covariance(points: DataFrame, *keys: str) -> DataFrame:
    """Centroid, box, principal axis and anisotropy of whole-number points (x, y) by key, from exact sums."""
    x, y = F.col("x"), F.col("y")
    s = points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
        F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"),
    )
    n = F.col("n")
    var = lambda a, b, ab: (n * F.col(ab) - F.col(a) * F.col(b)).cast("double") / (n * n).cast("double")
    vx, vy, cxy = var("sx", "sx", "sxx"), var("sy", "sy", "syy"), var("sx", "sy", "sxy")
    root = F.sqrt((vx - vy) * (vx - vy) / 4 + cxy * cxy)
    major, minor = (vx + vy) / 2 + root, (vx + vy) / 2 - root  # in sums of squares, as many times as there are points
    return s.select(
        *keys, "n", (F.col("sx") / n).alias("cx"), (F.col("sy") / n).alias("cy"), "min_x", "max_x", "min_y", "max_y",
        (0.5 * F.atan2(2 * cxy, vx - vy)).alias("axis"), F.when(minor * n > 1e-9, major / minor).otherwise(F.lit(float("inf"))).alias("anisotropy"),
    )
