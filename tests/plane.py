"""Slow plane geometry over numpy that the expressions are held against."""

import numpy as np

from furrow.functions.kernels import least_width, signed_area


def clip_convex(ring: np.ndarray, clipper: np.ndarray) -> np.ndarray:
    """The part of a ring inside a convex ring (either direction), edge by edge of the clipper."""
    if signed_area(clipper) < 0:
        clipper = clipper[::-1]
    out = ring
    for a, b in zip(clipper, np.roll(clipper, -1, axis=0), strict=True):
        if not len(out):
            break
        edge = b - a
        side = edge[0] * (out[:, 1] - a[1]) - edge[1] * (out[:, 0] - a[0])
        after, side2 = np.roll(out, -1, axis=0), np.roll(side, -1)
        cross = (side < 0) != (side2 < 0)
        t = np.where(cross, side / np.where(cross, side - side2, 1.0), 0.0)
        met = out + t[:, None] * (after - out)
        # each vertex, if inside, is followed by its edge's crossing, if there is one
        both = np.stack([out, met], axis=1).reshape(-1, 2)
        out = both[np.stack([side >= 0, cross], axis=1).reshape(-1)]
    return out


def inset(ring: np.ndarray, by: np.ndarray) -> np.ndarray | None:
    """Each edge moved inward by its own distance; corners are where moved edges meet. None if nothing sound is left."""
    area = signed_area(ring)
    if len(ring) < 3 or abs(area) < 1e-9:
        return None
    if area < 0:
        ring, by = ring[::-1], np.roll(by[::-1], -1)
    edge = np.roll(ring, -1, axis=0) - ring
    length = np.hypot(edge[:, 0], edge[:, 1])
    if (length < 1e-9).any():
        return None
    along = edge / length[:, None]
    start = ring + np.stack([-along[:, 1], along[:, 0]], axis=1) * by[:, None]
    before, origin = np.roll(along, 1, axis=0), np.roll(start, 1, axis=0)
    turn = before[:, 0] * along[:, 1] - before[:, 1] * along[:, 0]
    gap = start - origin
    straight = np.abs(turn) < 1e-9
    t = (gap[:, 0] * along[:, 1] - gap[:, 1] * along[:, 0]) / np.where(straight, 1.0, turn)
    out = np.where(straight[:, None], start, origin + before * t[:, None])
    moved = np.roll(out, -1, axis=0) - out
    if (np.einsum("ij,ij->i", moved, along) <= 0).any():  # an edge turned over
        return None
    return out


def headland(ring: np.ndarray, by: np.ndarray) -> tuple[str, np.ndarray, float, str | None]:
    """(kind, ring, area share, reason): inset, or waived where the ring is too narrow for it or little would be left."""
    whole = abs(signed_area(ring))
    if not (by > 0).any():
        return "none", ring, 1.0, None
    if least_width(ring) <= 2 * float(by.max()) + 1e-6:
        return "waived", ring, 1.0, "narrow"
    inner = inset(ring, by)
    if inner is None:
        return "waived", ring, 1.0, "collapsed"
    left = abs(signed_area(inner))
    if left >= whole or left < 0.01 * whole:
        return "waived", ring, 1.0, "area"
    return "inset", inner, left / whole, None


def inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd test of many points."""
    x, y = points[:, 0][:, None], points[:, 1][:, None]
    a, b = ring, np.roll(ring, -1, axis=0)
    high = (a[:, 1] > y) != (b[:, 1] > y)
    at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1] + 1e-12) + a[:, 0]
    return (np.count_nonzero(high & (x < at), axis=1) % 2) == 1


def interior_point(ring: np.ndarray, grid: int = 23) -> np.ndarray:
    """The vertex mean if it is inside, else the inside grid point nearest to it."""
    mean = ring.mean(axis=0)
    if inside(mean[None, :], ring)[0]:
        return mean
    low, high = ring.min(axis=0), ring.max(axis=0)
    share = (np.arange(grid) + 0.5) / grid
    gx, gy = np.meshgrid(low[0] + share * (high[0] - low[0]), low[1] + share * (high[1] - low[1]))
    points = np.stack([gx.ravel(), gy.ravel()], axis=1)
    points = points[inside(points, ring)]
    if not len(points):
        return mean
    return points[np.argmin(((points - mean) ** 2).sum(axis=1))]


def segment_gap(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> float:
    """Distance between two segments, 0 where they cross."""
    r, s, w = b - a, d - c, c - a
    den = r[0] * s[1] - r[1] * s[0]
    if abs(den) > 1e-12:
        t, u = (w[0] * s[1] - w[1] * s[0]) / den, (w[0] * r[1] - w[1] * r[0]) / den
        if 0 <= t <= 1 and 0 <= u <= 1:
            return 0.0

    def to(p, q, e):
        ee = float(e @ e)
        t = min(1.0, max(0.0, float((p - q) @ e) / ee)) if ee > 0 else 0.0
        return float(np.hypot(*(p - (q + t * e))))

    return min(to(a, c, s), to(b, c, s), to(c, a, r), to(d, a, r))


def ring_gap(one: np.ndarray, two: np.ndarray) -> float:
    """Distance between rings, 0 if they touch or one holds the other."""
    if inside(one[:1], two)[0] or inside(two[:1], one)[0]:
        return 0.0
    return min(segment_gap(a, b, c, d) for a, b in zip(one, np.roll(one, -1, axis=0), strict=True) for c, d in zip(two, np.roll(two, -1, axis=0), strict=True))


def shortest_path(free: np.ndarray, start: tuple[int, int], goal: tuple[int, int]) -> list[tuple[int, int]]:
    """Breadth-first route over the free cells of a grid, eight ways; empty if there is none."""
    if not (free[start] and free[goal]):
        return []
    came = {start: start}
    edge = [start]
    while edge and goal not in came:
        grown = []
        for r, c in edge:
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    n = (r + dr, c + dc)
                    if n not in came and 0 <= n[0] < free.shape[0] and 0 <= n[1] < free.shape[1] and free[n]:
                        came[n] = (r, c)
                        grown.append(n)
        edge = grown
    if goal not in came:
        return []
    out = [goal]
    while out[-1] != start:
        out.append(came[out[-1]])
    return out[::-1]
