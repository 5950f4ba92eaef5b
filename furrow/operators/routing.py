"""Places and ways in a field: routes that stay inside, cells under a point, zones in their field."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import geo
from furrow.functions.kernels import metres
from furrow.session import dealt

#: Cells along a side of a route's lattice, and parts of a segment whose ends must lie inside. Fixed values.
LATTICE, SAMPLES = 48, 12


class Field:
    """Rings as arrays of edges, for tests of many places at once."""

    def __init__(self, rings: list[list[dict]]):
        self.rings = [np.array([(p["lat"], p["lng"]) for p in r], float).reshape(-1, 2) for r in rings]

    def holds(self, places: np.ndarray) -> np.ndarray:
        """Whether each place (lat, lng) lies in a ring."""
        out = np.zeros(len(places), bool)
        lat, lng = places[:, :1], places[:, 1:]
        for ring in self.rings:
            a, b = ring, np.roll(ring, -1, axis=0)
            at = (b[:, 1] - a[:, 1]) * (lat - a[:, 0]) / (b[:, 0] - a[:, 0] + 1e-12) + a[:, 1]
            out |= np.count_nonzero(((a[:, 0] > lat) != (b[:, 0] > lat)) & (lng < at), axis=1) % 2 == 1
        return out

    def straight(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the places along a segment lie inside; its ends don't count."""
        t = np.arange(1, SAMPLES)[:, None] / SAMPLES
        return bool(self.holds(a + (b - a) * t).all())


def _steps(free: np.ndarray, start: int, goal: int, side: int) -> list[int]:
    """The cells of a shortest way over free cells, four ways, breadth first; none if there is none."""
    came = {start: start}
    edge = deque([start])
    while edge and goal not in came:
        here = edge.popleft()
        row, col = divmod(here, side)
        for to, inside in ((here + side, row + 1 < side), (here - side, row > 0), (here + 1, col + 1 < side), (here - 1, col > 0)):
            if inside and free[to] and to not in came:
                came[to] = here
                edge.append(to)
    if goal not in came:
        return []
    out = [goal]
    while out[-1] != start:
        out.append(came[out[-1]])
    return out[::-1]


def route_inside(a: np.ndarray, b: np.ndarray, field: Field, side: int = LATTICE) -> tuple[np.ndarray, int, bool]:
    """(path, steps, inside): the straight line if it stays inside; else a way over the lattice's cells, pulled tight.

    If none stays inside, the straight line and False.
    """
    ends = np.stack([a, b])
    if field.straight(a, b):
        return ends, 0, True
    every = np.vstack([*field.rings, ends])
    low, step = every.min(axis=0), (every.max(axis=0) - every.min(axis=0)) / side
    if not field.rings or not (step > 0).all():
        return ends, 0, False
    row, col = np.divmod(np.arange(side * side), side)
    centres = low + (np.stack([row, col], axis=1) + 0.5) * step
    free = field.holds(centres)
    if not free.any():
        return ends, 0, False
    start, goal = (int(np.argmin(np.where(free, metres(p, centres), np.inf))) for p in (a, b))
    cells = _steps(free, start, goal, side)
    if not cells:
        return ends, 0, False
    raw = np.vstack([a, centres[cells], b])
    path, here = [raw[0]], 0
    while here < len(raw) - 1:
        here = next((k for k in range(len(raw) - 1, here, -1) if field.straight(raw[here], raw[k])), here + 1)
        path.append(raw[here])
    tight = np.array(path)
    if all(field.straight(p, q) for p, q in zip(tight, tight[1:], strict=False)):
        return tight, len(cells), True
    return ends, len(cells), False


def routes_inside(legs: DataFrame, route: str, side: int = LATTICE) -> DataFrame:
    """(route, path, steps, inside, length_m) of legs (route, a, b, rings): a and b are structs of lat and lng, rings an array of rings.

    A leg is one row, and its lattice bounds its work; legs are dealt out and read in Arrow batches, a leg at a time. `steps` counts the lattice cells of the way, 0 for
    a straight one.
    """
    kind = legs.schema[route].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b = (np.array([r[k]["lat"], r[k]["lng"]], float) for k in "ab")
                path, steps, inside = route_inside(a, b, Field(r["rings"] or []), side)
                length = float(metres(path[:-1], path[1:]).sum())
                out.append({route: r[route], "path": [{"lat": float(p[0]), "lng": float(p[1])} for p in path], "steps": steps, "inside": inside, "length_m": length})
            point = pa.struct([("lat", pa.float64()), ("lng", pa.float64())])
            yield pa.RecordBatch.from_pylist(out, pa.schema([batch.schema.field(0), ("path", pa.list_(point)), ("steps", pa.int32()), ("inside", pa.bool_()), ("length_m", pa.float64())]))

    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    return dealt(legs.filter(there).select(route, "a", "b", "rings"), route).mapInArrow(run, f"{route} {kind}, path array<struct<lat:double,lng:double>>, steps int, inside boolean, length_m double")


def cell_at(lat: Column, lng: Column, origin: Column, heading: Column, size_m: Column) -> tuple[Column, Column]:
    """The lattice cell (col, row) over a place, on a lattice that is turned by `heading` about its origin."""
    x, y = (lng - origin["lng"]) * geo.m_per_deg_lng(origin["lat"]), (lat - origin["lat"]) * geo.M_PER_DEG
    return F.floor((x * F.cos(heading) + y * F.sin(heading)) / size_m).cast("int"), F.floor((y * F.cos(heading) - x * F.sin(heading)) / size_m).cast("int")


def hit_cells(points: DataFrame, fields: DataFrame, cells: DataFrame, field: str) -> DataFrame:
    """Points (field, lat, lng, ...) with the field's cell (col, row) under them; those over none go.

    The cell's number follows from the place, so the join is on keys; a clipped cell's ring then decides. Both joins are merged, since a few fields' size
    tells nothing of how many cells they make: a plan's estimate would send all of them through the driver.
    """
    lattice = fields.select(field, "origin", "heading", (F.col("swath_m") * F.col("cell_multiple")).alias("__size"))
    col, row = cell_at(F.col("lat"), F.col("lng"), F.col("origin"), F.col("heading"), F.col("__size"))
    keyed = points.join(lattice.hint("merge"), field).withColumns({"col": col, "row": row}).drop("origin", "heading", "__size")
    hit = keyed.join(cells.select(field, "col", "row", "clipped", F.col("ring").alias("__ring")).hint("merge"), [field, "col", "row"])
    return hit.filter(~F.col("clipped") | geo.point_in_ring(F.col("lat"), F.col("lng"), F.col("__ring"))).drop("clipped", "__ring")


def zones_in_field(zones: DataFrame, boundaries: DataFrame, field: str) -> DataFrame:
    """The zones (field, ring, ...) whose vertex mean lies in a ring of their field's boundary (field, ring)."""
    whole = boundaries.filter(F.size("ring") >= 3).groupBy(field).agg(F.collect_list("ring").alias("__rings"))
    c = geo.vertex_mean(F.col("ring"))
    near = zones.filter(F.size("ring") >= 3).withColumn("__c", c).join(whole, field)
    return near.filter(F.exists("__rings", lambda r: geo.point_in_ring(F.col("__c.lat"), F.col("__c.lng"), r))).drop("__c", "__rings")
