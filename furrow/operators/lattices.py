"""Treatment lattices: a field's boundary cut into square cells along its heading.

Rings are turned into the lattice's frame once, where a cell is a unit square. Rows of candidate cells are exploded from the box and dealt out. A cell whose
corners all lie in the boundary is whole; the others are clipped along the cell's four sides, many cells at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import clips, geo, rings
from furrow.operators import zones
from furrow.session import shuffle_width

#: Ceilings above which a field is refused, and the share of a cell below which a piece is a sliver. Fixed values.
MAX_CELLS, MAX_CANDIDATES = 20_000, 80_000
SLIVER_SHARE = 0.01


def treatment_lattice(fields: DataFrame, field: str) -> DataFrame:
    """(field, col, row, ring, area_m2, share, clipped, centroid): the cells of each field.

    `fields` holds rings (array of array<struct<lat,lng>>), origin (struct<lat,lng>), heading (radians), swath_m and cell_multiple. Cells are numbered from
    the origin outward, so an extended boundary renumbers none. A clipped cell takes the piece of the first ring that has one; slivers below a hundredth of
    a cell go. `share` is the piece's part of the cell on the lattice's plane. A field of more than MAX_CANDIDATES candidates is an error; fields of
    more than MAX_CELLS cells are those of `oversized`.
    """
    size = F.col("swath_m") * F.col("cell_multiple")
    lat0, lng0, wide = F.col("origin.lat"), F.col("origin.lng"), geo.m_per_deg_lng(F.col("origin.lat"))
    f = fields.select(field, "rings", size.cast("double").alias("size"), lat0.alias("lat0"), lng0.alias("lng0"), wide.alias("wide"), F.cos("heading").alias("cos"), F.sin("heading").alias("sin"))
    f = f.filter(F.col("size") > 0)
    x, y = (lambda p: (p["lng"] - F.col("lng0")) * F.col("wide")), (lambda p: (p["lat"] - F.col("lat0")) * geo.M_PER_DEG)
    local = lambda p: F.struct(((y(p) * F.col("cos") - x(p) * F.col("sin")) / F.col("size")).alias("lat"), ((x(p) * F.col("cos") + y(p) * F.col("sin")) / F.col("size")).alias("lng"))
    f = f.withColumn("flat", F.transform("rings", lambda r: F.transform(r, local))).drop("rings")
    all_points = F.flatten("flat")
    lats, lngs = F.transform(all_points, lambda p: p["lat"]), F.transform(all_points, lambda p: p["lng"])
    low, high = lambda v: F.floor(F.array_min(v)).cast("int"), lambda v: F.ceil(F.array_max(v)).cast("int")
    f = f.withColumns({"c0": low(lngs), "c1": high(lngs), "r0": low(lats), "r1": high(lats)})
    n = (F.col("c1") - F.col("c0") + 1).cast("long") * (F.col("r1") - F.col("r0") + 1)
    f = f.withColumn("r0", F.when(n <= MAX_CANDIDATES, F.col("r0")).otherwise(F.raise_error(F.lit("a field has too many cells")).cast("int")))
    # Few fields make many cells, each with work to do: a field's rows are dealt out before its cells are made.
    f = f.withColumn("row", F.explode(F.sequence("r0", "r1"))).repartition(shuffle_width(fields.sparkSession, fields), field, "row")
    kind = fields.schema[field].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, lat0, lng0, wide, cos, sin = (batch.column(n).to_numpy() for n in ("size", "lat0", "lng0", "wide", "cos", "sin"))
            for c in clips.cells(batch.column("flat"), batch.column("row"), batch.column("c0"), batch.column("c1")):
                own = np.repeat(c.band, c.count)
                lat = lat0[own] + (c.lng * sin[own] + c.lat * cos[own]) * size[own] / geo.M_PER_DEG
                lng = lng0[own] + (c.lng * cos[own] - c.lat * sin[own]) * size[own] / wide[own]
                ground = clips.Rings(lat, lng, c.count)
                area = ground.area_m2()
                keep = area >= size[c.band] * size[c.band] * SLIVER_SHARE
                mid_lat, mid_lng = ground.means()
                point = [pa.field("lat", pa.float64()), pa.field("lng", pa.float64())]
                ring = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(c.count)), pa.int32()), pa.StructArray.from_arrays([pa.array(lat), pa.array(lng)], fields=point))
                made = {field: batch.column(field).take(pa.array(c.band)), "col": pa.array(c.col), "row": pa.array(c.row), "ring": ring, "area_m2": pa.array(area), "share": pa.array(clips.Rings(c.lat, c.lng, c.count).shoelace())}
                made |= {"clipped": pa.array(~c.whole), "centroid": pa.StructArray.from_arrays([pa.array(mid_lat), pa.array(mid_lng)], fields=point)}
                yield pa.RecordBatch.from_pydict(made).filter(pa.array(keep))

    bands = f.select(field, "row", "c0", "c1", "size", "lat0", "lng0", "wide", "cos", "sin", "flat")
    return bands.mapInArrow(cut, f"{field} {kind}, col int, row int, ring {rings.RING}, area_m2 double, share double, clipped boolean, centroid struct<lat:double,lng:double>")


def oversized(cells: DataFrame, field: str) -> DataFrame:
    """(field, cells) of the fields with more cells than one may have."""
    return cells.groupBy(field).agg(F.count("*").alias("cells")).filter(F.col("cells") > MAX_CELLS)


def lattice_warnings(fields: DataFrame, field: str) -> DataFrame:
    """(field, kind, ring, width_m): cells smaller than the swath (no ring), and rings narrower than it, by their hull."""
    size = F.col("swath_m") * F.col("cell_multiple")
    small = fields.filter(size < F.col("swath_m")).select(field, F.lit("sub-swath-cell").alias("kind"), F.lit(None).cast("int").alias("ring"), size.cast("double").alias("width_m"))
    each = fields.select(field, "swath_m", F.posexplode("rings").alias("at", "ring"))
    narrow = zones.with_width(each, out="width_m").filter((F.col("width_m") > 0) & (F.col("width_m") < F.col("swath_m")))
    return small.unionByName(narrow.select(field, F.lit("narrower-than-swath").alias("kind"), F.col("at").alias("ring"), "width_m"))
