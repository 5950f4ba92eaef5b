"""Cells and rasters: stored state joined to cells, features of the pixels in each cell, samples at a time, claims by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import geo
from furrow.operators.spatial import points_in_rings

#: Pixels that a cell must hold, and about how many are read of it. Fixed values.
MIN_PIXELS, PIXEL_CAP = 30, 400


def with_stored(cells: DataFrame, rates: DataFrame, detections: DataFrame, key: str = "cell_id") -> DataFrame:
    """Cells with their stored rate (undecided where there is none) and detection score; stored ids that are no cell go."""
    r = rates.select(key, "state", "source", "rate_lha")
    d = detections.select(key, "score")
    j = cells.join(r, key, "left").join(d, key, "left")
    return j.withColumns({"state": F.coalesce("state", F.lit("untreated")), "source": F.coalesce("source", F.lit("default"))})


def pixel_of(lat: Column, lng: Column, box: dict[str, float], width: int, height: int) -> tuple[Column, Column]:
    """The pixel (x, y) of a raster over `box` that holds a place."""
    return F.floor((lng - box["west"]) / (box["east"] - box["west"]) * width), F.floor((box["north"] - lat) / (box["north"] - box["south"]) * height)


def place_of(x: Column, y: Column, box: dict[str, float], width: int, height: int) -> tuple[Column, Column]:
    """The middle (lat, lng) of a pixel."""
    return box["north"] - (y + 0.5) / height * (box["north"] - box["south"]), box["west"] + (x + 0.5) / width * (box["east"] - box["west"])


def second_raster(pixels: DataFrame, values: DataFrame, box: dict[str, float], width: int, height: int) -> DataFrame:
    """Append `index`: the value of a second raster (x, y, value) at each pixel's place (lat, lng); null beyond it or where it has no number.
    Rasters may differ in size, so the pixel's key in the second one is derived, and the join is on that key."""
    x, y = pixel_of(F.col("lat"), F.col("lng"), box, width, height)
    v = values.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("value").alias("index"))
    keyed = pixels.withColumns({"__x": x, "__y": y})
    return keyed.join(v, ["__x", "__y"], "left").drop("__x", "__y")


def cell_pixels(pixels: DataFrame, cells: DataFrame, box: dict[str, float], width: int, height: int, cap: int = PIXEL_CAP) -> DataFrame:
    """Pixels (x, y, r, g, b, a, ...) with the cells whose ring holds their middle, at the cell's stride: the larger a cell, the sparser.

    Off-field (alpha 0) and black pixels go. The join is on buckets as wide as the cells' boxes.
    """
    f = geo.footprint(F.col("ring"))
    x0, y0 = pixel_of(F.col("__f.north"), F.col("__f.west"), box, width, height)
    x1, y1 = pixel_of(F.col("__f.south"), F.col("__f.east"), box, width, height)
    edge = lambda v, most: F.least(F.greatest(v, F.lit(0)), F.lit(most - 1))
    c = cells.select("cell_id", "ring", f.alias("__f")).select("cell_id", "ring", edge(x0, width).alias("x0"), edge(x1, width).alias("x1"), edge(y0, height).alias("y0"), edge(y1, height).alias("y1"))
    area = F.greatest(F.lit(1), F.col("x1") - F.col("x0") + 1) * F.greatest(F.lit(1), F.col("y1") - F.col("y0") + 1)
    c = c.withColumn("stride", F.greatest(F.lit(1), F.floor(F.sqrt(area / cap)))).select("cell_id", "ring", "x0", "y0", "stride")
    lat, lng = place_of(F.col("x"), F.col("y"), box, width, height)
    p = pixels.filter((F.col("a") > 0) & (F.col("r") + F.col("g") + F.col("b") > 0)).withColumns({"lat": lat, "lng": lng})
    held = points_in_rings(p, c)
    return held.filter(((F.col("x") - F.col("x0")) % F.col("stride") == 0) & ((F.col("y") - F.col("y0")) % F.col("stride") == 0)).drop("ring", "x0", "y0", "stride")


def cell_features(held: DataFrame, with_index: bool = False) -> DataFrame:
    """(cell_id, pixels, usable, features): twelve numbers a cell from its pixels, and four more from `index`; none below MIN_PIXELS.

    Shares of red, green and blue, brightness and its deviation, deviations of the shares, excess green and its deviation, and the
    tenth and ninetieth hundredth of the green-red index. A cell's list is as long as its cap allows (stride keeps it under four caps).
    """
    r, g, b = F.col("r").cast("double"), F.col("g").cast("double"), F.col("b").cast("double")
    total = r + g + b
    p = held.withColumns({"__r": r / total, "__g": g / total, "__b": b / total, "__i": total / 3, "__n": F.when(g + r > 0, (g - r) / (g + r)).otherwise(F.lit(0.0))})
    p = p.withColumn("__e", 2 * F.col("__g") - F.col("__r") - F.col("__b"))

    def rank(values: Column, q: float) -> Column:
        return F.element_at(values, F.least(F.size(values), F.floor(F.lit(q) * (F.size(values) - 1) + 0.5).cast("int") + 1))

    mean, sd = lambda c: F.avg(c), lambda c: F.stddev_pop(c)
    numbers = {"m_r": mean("__r"), "m_g": mean("__g"), "m_b": mean("__b"), "m_i": mean("__i"), "s_i": sd("__i"), "s_r": sd("__r"), "s_g": sd("__g"), "s_b": sd("__b"), "m_e": mean("__e"), "s_e": sd("__e")}
    lists = {"l_n": F.sort_array(F.collect_list("__n"))}
    if with_index:
        numbers |= {"m_x": mean("index"), "s_x": sd("index")}
        lists["l_x"] = F.sort_array(F.collect_list("index"))
    s = p.groupBy("cell_id").agg(F.count("*").alias("pixels"), *[v.alias(k) for k, v in {**numbers, **lists}.items()])
    features = [F.col(k) for k in ("m_r", "m_g", "m_b", "m_i", "s_i", "s_r", "s_g", "s_b", "m_e", "s_e")] + [rank(F.col("l_n"), 0.1), rank(F.col("l_n"), 0.9)]
    if with_index:
        some = F.size("l_x") > 0
        features += [F.coalesce(x, F.lit(0.0)) for x in (F.col("m_x"), F.col("s_x"), F.when(some, rank(F.col("l_x"), 0.1)), F.when(some, rank(F.col("l_x"), 0.9)))]
    usable = F.col("pixels") >= MIN_PIXELS
    return s.select("cell_id", "pixels", usable.alias("usable"), F.when(usable, F.array(*features)).otherwise(F.array().cast("array<double>")).alias("features"))


def sampling_verdict(features: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: cells, those with too few pixels, the middle pixel count, and whether enough were measured. Cells without a pixel count."""
    n = cells.select("cell_id").join(features.select("cell_id", "pixels", "usable"), "cell_id", "left").select(F.coalesce("pixels", F.lit(0)).alias("pixels"), F.coalesce("usable", F.lit(False)).alias("usable"))
    s = n.groupBy("pixels", "usable").agg(F.count("*").alias("c"))
    lists = F.array_sort(F.collect_list(F.struct("pixels", "c")))  # one entry a distinct count
    t = s.agg(F.sum("c").alias("cells"), F.sum(F.when(~F.col("usable"), F.col("c")).otherwise(0)).alias("under"), lists.alias("l"))
    at = F.floor(0.5 * (F.col("cells") - 1) + 0.5)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v"))
    step = lambda a, e: F.struct((a["seen"] + e["c"]).alias("seen"), F.when(a["v"].isNull() & (a["seen"] + e["c"] > at), e["pixels"]).otherwise(a["v"]).alias("v"))
    return t.select("cells", "under", F.aggregate("l", start, step)["v"].alias("middle"), (F.col("cells") - F.col("under") >= 2).alias("ok"))


def nearest_claims(claims: DataFrame) -> DataFrame:
    """The winner of each new cell by distance only, then the earlier one; for detections, which have no rank."""
    w = Window.partitionBy("new_col", "new_row").orderBy("dist2", "ordinal")
    return claims.filter("landed").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def first_not_ended(probes: DataFrame, segments: DataFrame, key: str, at: str, end: str, *carry: str) -> DataFrame:
    """Probes with the first segment that ends at or after them (a closed end), null past the last; one sort of the union."""
    s = segments.select(F.col(key), F.col(end).alias("__t"), F.lit(True).alias("__s"), F.struct(F.col(end).alias("__end"), *carry).alias("__c"))
    p = probes.select(F.col(key), F.col(at).alias("__t"), F.lit(False).alias("__s"), F.struct(*probes.columns).alias("__p"))
    # Backwards in time the last segment seen is the first that ends later; at equal times it is seen before the probe.
    w = Window.partitionBy(key).orderBy(F.col("__t").desc(), F.col("__s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = s.unionByName(p, allowMissingColumns=True).withColumn("__f", F.last(F.when(F.col("__s"), F.col("__c")), ignorenulls=True).over(w)).filter(~F.col("__s"))
    return found.select("__p.*", *[F.col(f"__f.{c}").alias(c) for c in carry])


def covered_at(probes: DataFrame, legs: DataFrame, key: str, at: str) -> DataFrame:
    """Probes with `covered`: the distance flown at their time, with the share of the leg under way, from legs (t_start, t_end, distance at
    the end, leg); 0 before the first and all of it after the last."""
    found = first_not_ended(probes, legs, key, at, "t_end", "t_start", "t_end", "distance", "leg")
    total = legs.groupBy(key).agg(F.max("distance").alias("__all"))
    share = F.when(F.col("t_end") > F.col("t_start"), (F.col(at) - F.col("t_start")) / (F.col("t_end") - F.col("t_start"))).otherwise(F.lit(1.0))
    inside = F.col("distance") - F.col("leg") * (1 - geo.clamp(share, 0.0, 1.0))
    return found.join(total, key, "left").select(*probes.columns, F.when(F.col("t_end").isNull(), F.coalesce("__all", F.lit(0.0))).otherwise(inside).alias("covered"))


def snapped(samples: DataFrame, key: str, t: str, flag: str, step: float) -> DataFrame:
    """(key, t, flag) every `step` between samples: a switch can't be half on, so it takes the nearer sample's state, the later one halfway."""
    w = Window.partitionBy(key).orderBy(t)
    pairs = samples.select(key, F.col(t).alias("t0"), F.col(flag).alias("f0"), F.lead(t).over(w).alias("t1"), F.lead(flag).over(w).alias("f1")).filter("t1 > t0")
    ticks = F.sequence(F.ceil(F.col("t0") / step), F.ceil(F.col("t1") / step) - 1)
    at = pairs.filter(F.ceil(F.col("t1") / step) - 1 >= F.ceil(F.col("t0") / step)).withColumn("n", F.explode(ticks)).withColumn("t", F.col("n") * F.lit(step))
    return at.select(key, "t", F.when((F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")) < 0.5, F.col("f0")).otherwise(F.col("f1")).alias(flag))
