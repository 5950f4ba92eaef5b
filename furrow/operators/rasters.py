"""Prescription rasters: zones burnt into pixels by scanlines, with the boundary as a hard mask.

A ring gives even-odd spans of pixel columns for each pixel row; spans of zones and boundaries meet by field and row, and only what lies in both
is exploded to pixels. Overlaps take the highest rate: a maximum, which is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import geo

#: What a pixel outside the boundary holds where the format has such a value. Fixed value.
NODATA = -9999.0
#: Pixels that a field's raster may have. Fixed value.
MAX_PIXELS = 2_000_000


def ring_spans(rings: DataFrame, grids: DataFrame, field: str, *kept: str) -> DataFrame:
    """(field, kept, y, x0, x1): the pixels whose centres lie in each ring (array<struct<lat,lng>>), as spans of columns, ends included.

    `grids` holds (field, origin_lat, origin_lng, pixel_lat, pixel_lng, width, height), the origin being the north-west corner, one row a field.
    """
    g = rings.filter(F.size("ring") >= 3).select(field, *kept, "ring").join(grids, field)
    lats = F.transform("ring", lambda p: p["lat"])
    row = lambda lat: (F.col("origin_lat") - lat) / F.col("pixel_lat") - 0.5
    first = F.greatest(F.lit(0), F.ceil(row(F.array_max(lats)))).cast("int")
    last = F.least(F.col("height") - 1, F.floor(row(F.array_min(lats)))).cast("int")
    lines = g.withColumns({"first": first, "last": last}).filter("first <= last").withColumn("y", F.explode(F.sequence("first", "last")))
    lines = lines.withColumn("lat", F.col("origin_lat") - (F.col("y") + 0.5) * F.col("pixel_lat"))

    def crossing(p: Column, q: Column) -> Column:
        at = (q["lng"] - p["lng"]) * (F.col("lat") - p["lat"]) / (q["lat"] - p["lat"] + 1e-12) + p["lng"]
        return F.when((p["lat"] > F.col("lat")) != (q["lat"] > F.col("lat")), at)

    met = F.array_sort(F.filter(F.zip_with("ring", geo.next_vertices(F.col("ring")), crossing), lambda v: v.isNotNull()))
    lines = lines.withColumn("met", met).filter(F.size("met") >= 2)
    # The first column whose centre is not west of a crossing.
    column = lambda lng: F.ceil((lng - F.col("origin_lng")) / F.col("pixel_lng") - 0.5).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("met") / 2).cast("int") - 1), lambda i: F.struct(column(F.get("met", i * 2)).alias("x0"), (column(F.get("met", i * 2 + 1)) - 1).alias("x1")))
    spans = lines.select(field, *kept, "y", "width", F.explode(pairs).alias("s"))
    spans = spans.select(field, *kept, "y", F.greatest(F.lit(0), "s.x0").alias("x0"), F.least(F.col("width") - 1, "s.x1").alias("x1"))
    return spans.filter("x0 <= x1")


def burn_zones(grids: DataFrame, zones: DataFrame, boundaries: DataFrame, field: str, nodata_outside: bool = True) -> DataFrame:
    """(field, y, x, rate): every pixel of each field's raster as a 32-bit float.

    A pixel takes the highest rate above 0 of the zones (field, ring, rate_lha) over its centre, if that lies in a ring of the boundary too; others are 0, or
    NODATA outside the boundary if the format has it. A raster above the ceiling is an error.
    """
    size = F.col("width").cast("long") * F.col("height")
    g = grids.withColumn("height", F.when(size <= MAX_PIXELS, F.col("height")).otherwise(F.raise_error(F.lit("a raster has too many pixels")).cast("int")))
    inside = ring_spans(boundaries, g, field).select(field, "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    over = ring_spans(zones.filter("rate_lha > 0"), g, field, "rate_lha").join(inside, [field, "y"]).filter("x0 <= b1 AND b0 <= x1")
    burnt = over.select(field, "y", F.explode(F.sequence(F.greatest("x0", "b0"), F.least("x1", "b1"))).alias("x"), F.col("rate_lha").cast("float").alias("rate"))
    base = g.select(field, "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    default = NODATA if nodata_outside else 0.0
    ground = base.select(field, "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"), F.lit(default).cast("float").alias("rate"))
    layers = ground.unionByName(burnt)
    if nodata_outside:
        layers = layers.unionByName(inside.select(field, "y", F.explode(F.sequence("b0", "b1")).alias("x"), F.lit(0.0).cast("float").alias("rate")))
    return layers.groupBy(field, "y", "x").agg(F.max("rate").alias("rate"))


def raster_rows(pixels: DataFrame, field: str) -> DataFrame:
    """(field, y, rates): each pixel row from west to east, as wide as its raster."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("x", "rate"))), lambda p: p["rate"])
    return pixels.groupBy(field, "y").agg(row.alias("rates"))


def raster_summary(pixels: DataFrame, field: str) -> DataFrame:
    """(field, treated, untreated, no_data, min, max) of a burnt raster; min and max over treated pixels, 0 if there are none."""
    rate = F.col("rate")
    treated = F.when(rate > 0, rate)
    ends = [F.coalesce(f(treated), F.lit(0.0).cast("float")).alias(n) for n, f in (("min", F.min), ("max", F.max))]
    return pixels.groupBy(field).agg(F.count_if(rate > 0).alias("treated"), F.count_if(rate == 0).alias("untreated"), F.count_if(rate == NODATA).alias("no_data"), *ends)
