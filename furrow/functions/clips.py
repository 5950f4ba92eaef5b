"""Numpy kernels that cut rings into square cells, many cells of many rings at once.

Rings lie one behind the other in flat arrays of vertices, with a count for each. Sums run in the order of the vertices, so results don't depend on batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from furrow.functions.geo import AREA_RADIUS_M

#: Vertices that are worked on at once. Fixed value, which bounds memory only.
AT_ONCE = 1 << 19


@dataclass
class Rings:
    lat: np.ndarray
    lng: np.ndarray
    count: np.ndarray

    def own(self) -> np.ndarray:
        """The ring of each vertex."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def following(self) -> np.ndarray:
        """The place of the vertex after each in its ring."""
        after, ends, some = np.arange(1, len(self.lat) + 1), np.cumsum(self.count), self.count > 0
        after[ends[some] - 1] = (ends - self.count)[some]
        return after

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.own(), values, len(self.count))

    def take(self, rings: np.ndarray) -> Rings:
        count = self.count[rings]
        first = (np.cumsum(self.count) - self.count)[rings]
        at = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
        return Rings(self.lat[at], self.lng[at], count)

    def holds(self, lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
        """Whether each ring holds its own place, by the parity of edge crossings."""
        own, after = self.own(), self.following()
        y, x, next_y, next_x = lat[own], lng[own], self.lat[after], self.lng[after]
        with np.errstate(all="ignore"):
            at = (next_x - self.lng) * (y - self.lat) / (next_y - self.lat + 1e-12) + self.lng
            crossed = ((self.lat > y) != (next_y > y)) & (x < at)
        return np.bincount(own[crossed], minlength=len(self.count)) % 2 == 1

    def half(self, a: float, b: float, c: np.ndarray) -> Rings:
        """The parts where a * lng + b * lat + c >= 0; each vertex inside is followed by its edge's crossing, if there is one."""
        own, after = self.own(), self.following()
        side = a * self.lng + b * self.lat + c[own]
        to = side[after]
        met = ((side >= 0) != (to >= 0)) & ~np.isnan(side) & ~np.isnan(to)
        with np.errstate(all="ignore"):
            t = side / (side - to)
        crossing = lambda v: v + (v[after] - v) * t
        kept = np.stack([side >= 0, met], axis=1).ravel()
        pick = lambda v: np.stack([v, crossing(v)], axis=1).ravel()[kept]
        with np.errstate(all="ignore"):
            return Rings(pick(self.lat), pick(self.lng), np.bincount(np.repeat(own, 2)[kept], minlength=len(self.count)))

    def in_boxes(self, south: np.ndarray, west: np.ndarray, north: np.ndarray, east: np.ndarray) -> Rings:
        """Each ring's part in its own level box; where the ring enters twice, the parts hang together by connectors without area."""
        return self.half(1, 0, -west).half(-1, 0, east).half(0, 1, -south).half(0, -1, north)

    def shoelace(self) -> np.ndarray:
        """Areas on the plane, whatever the direction."""
        after = self.following()
        return np.abs(self.sums(self.lng * self.lat[after] - self.lat * self.lng[after])) / 2

    def area_m2(self) -> np.ndarray:
        """Square metres of rings on the ground."""
        after, sine = self.following(), np.sin(np.radians(self.lat))
        return np.abs(self.sums(np.radians(self.lng[after] - self.lng) * (2 + sine + sine[after])) * AREA_RADIUS_M * AREA_RADIUS_M / 2)

    def means(self) -> tuple[np.ndarray, np.ndarray]:
        return self.sums(self.lat) / self.count, self.sums(self.lng) / self.count


@dataclass
class Cells:
    """Pieces of rings in cells: the band of each, its place on the lattice, whether it is a whole cell, and the pieces' vertices."""

    band: np.ndarray
    col: np.ndarray
    row: np.ndarray
    whole: np.ndarray
    lat: np.ndarray
    lng: np.ndarray
    count: np.ndarray


def _counts(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def cells(boundaries: pa.Array, rows: pa.Array, first: pa.Array, last: pa.Array, size: float = 1.0) -> Iterator[Cells]:
    """The pieces of the cells of each band: a row of cells of one boundary (list<list<struct<lat,lng>>>), from column `first` to `last`.

    A cell whose corners all lie in rings is whole. Any other takes the piece of the first ring that has one of three vertices and more.
    """
    parts, flat = _counts(boundaries), boundaries.flatten()
    points = flat.flatten()
    every = Rings(*(pc.cast(pc.struct_field(points, n), pa.float64()).to_numpy(zero_copy_only=False) for n in ("lat", "lng")), _counts(flat))
    part_at = np.cumsum(parts) - parts
    row, low, high = (v.to_numpy().astype(np.int64) for v in (rows, first, last))
    wide = high - low + 1
    weight = np.bincount(np.repeat(np.arange(len(parts)), parts), every.count, len(parts)).astype(np.int64) + 1
    # Bands of many vertices are cut into stretches, and stretches are put together until they are much work.
    per = np.maximum(1, AT_ONCE // weight)
    n = -(-wide // per)
    band = np.repeat(np.arange(len(n)), n)
    start = low[band] + (np.arange(len(band)) - np.repeat(np.cumsum(n) - n, n)) * per[band]
    length = np.minimum(per[band], high[band] + 1 - start)
    heap = np.cumsum(length * weight[band]) // AT_ONCE
    for stretch in np.split(np.arange(len(band)), np.flatnonzero(np.diff(heap)) + 1):
        if len(stretch):
            each = length[stretch]
            cell = np.repeat(band[stretch], each)
            col = np.arange(each.sum()) + np.repeat(start[stretch] - (np.cumsum(each) - each), each)
            yield _pieces(every, parts, part_at, cell, col, row[cell], size)


def _pieces(every: Rings, parts: np.ndarray, part_at: np.ndarray, band: np.ndarray, col: np.ndarray, row: np.ndarray, size: float) -> Cells:
    """The pieces of single cells, of all rings of their band."""
    n = parts[band]
    cell = np.repeat(np.arange(len(band)), n)  # of each pair of a cell and a ring
    ring = part_at[band][cell] + np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
    whole = np.ones(len(band), bool)
    pairs = every.take(ring)
    for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1)):
        held = pairs.holds(((row + dy) * size)[cell], ((col + dx) * size)[cell])
        whole &= np.bincount(cell[held], minlength=len(band)) > 0
    open_ = np.flatnonzero(~whole[cell])
    y, x = (row * size)[cell[open_]], (col * size)[cell[open_]]
    cut = every.take(ring[open_]).in_boxes(y, x, y + size, x + size)
    good = np.flatnonzero(cut.count >= 3)
    owner, at = np.unique(cell[open_][good], return_index=True)  # the first ring's piece
    cut = cut.take(good[at])
    full = np.flatnonzero(whole)
    corner = lambda v, steps: (v[full, None] + np.array(steps)).ravel() * size
    lat, lng = np.append(corner(row, (0, 0, 1, 1)), cut.lat), np.append(corner(col, (0, 1, 1, 0)), cut.lng)
    of = np.append(full, owner)
    return Cells(band[of], col[of].astype(np.int32), row[of].astype(np.int32), whole[of], lat, lng, np.append(np.full(len(full), 4), cut.count))
