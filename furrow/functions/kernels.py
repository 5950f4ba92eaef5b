"""Plane-geometry kernels over numpy, for operators that no Column expression can state."""

from __future__ import annotations

import numpy as np


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull, without repeats."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows):
        kept: list[np.ndarray] = []
        for q in rows:
            while len(kept) > 1:
                u, v = kept[-1] - kept[-2], q - kept[-2]
                if u[0] * v[1] - u[1] * v[0] > 0:
                    break
                kept.pop()
            kept.append(q)
        return kept

    lower, upper = half(p), half(p[::-1])
    return np.array(lower[:-1] + upper[:-1])


def least_width(points: np.ndarray) -> float:
    """The narrowest distance between parallels that hold the points; overstates nothing convex."""
    hull = convex_hull(points)
    if len(hull) < 3:
        return 0.0
    edge = np.roll(hull, -1, axis=0) - hull
    normal = np.stack([-edge[:, 1], edge[:, 0]], axis=1) / np.hypot(edge[:, 0], edge[:, 1])[:, None]
    reach = normal @ hull.T
    return float((reach.max(axis=1) - reach.min(axis=1)).min())


def recurrence(keep: np.ndarray, add: np.ndarray) -> np.ndarray:
    """s[i] = keep[i] * s[i-1] + add[i] from s[-1] = 0, in logarithmically many vector steps; keep is within 0..1, so nothing grows."""
    a, b, d = keep.astype(float), add.astype(float), 1
    while d < len(b):
        b[d:], a[d:] = b[d:] + a[d:] * b[:-d], a[d:] * a[:-d]
        d *= 2
    return b


def order_stops(points: np.ndarray, home: np.ndarray, sweeps: int = 12) -> list[int]:
    """A short closed tour from home: nearest neighbour, then reversals that shorten it, in at most `sweeps` rounds. Distances are
    computed as they are needed, a row at a time."""
    n = len(points)
    if not n:
        return []
    full = np.vstack([home, points])
    far = lambda i, js: np.hypot(full[js, 0] - full[i, 0], full[js, 1] - full[i, 1])
    left, order, here = np.arange(1, n + 1), [], 0
    while len(left):
        k = int(np.argmin(far(here, left)))
        here = int(left[k])
        left = np.delete(left, k)
        order.append(here)
    tour = np.array([0, *order, 0])
    for _ in range(sweeps):
        better = False
        for i in range(1, n):
            a, b = tour[i - 1], tour[i]
            js = np.arange(i + 1, n + 1)
            here, after = tour[js], tour[js + 1]
            gain = far(a, np.array([b]))[0] + np.hypot(*(full[here] - full[after]).T) - far(a, here) - far(b, after)
            k = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[k] > 1e-6:
                j = int(js[k])
                tour[i : j + 1] = tour[i : j + 1][::-1]
                better = True
        if not better:
            break
    return (tour[1:-1] - 1).tolist()


#: Metres of a degree, as everywhere on the plane.
_DEGREE = 111_320.0
#: The ways round a fragment, by the ends fa, fb, la, lb: where it begins and where it ends. Two and three run the passes backwards, one
#: and three each pass.
STARTS, ENDS = (0, 1, 2, 3), (3, 2, 1, 0)


def metres(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Planar metres between places (lat, lng), at their middle latitude."""
    dx = (q[..., 1] - p[..., 1]) * np.cos(np.radians((p[..., 0] + q[..., 0]) / 2))
    return np.hypot(dx, q[..., 0] - p[..., 0]) * _DEGREE


def tour_cost(order: list[int], corners: np.ndarray, home: np.ndarray) -> tuple[float, list[int]]:
    """The least transit of a given order from home and back, and the way round each fragment that gives it: a shortest path over four
    states a fragment."""
    if not order:
        return 0.0, []
    cost, back = metres(home, corners[order[0]][list(STARTS)]), []
    for i, j in zip(order, order[1:], strict=False):
        step = cost[:, None] + metres(corners[i][list(ENDS)][:, None], corners[j][list(STARTS)][None, :])
        back.append(step.argmin(axis=0))
        cost = step.min(axis=0)
    cost = cost + metres(corners[order[-1]][list(ENDS)], home)
    at = int(cost.argmin())
    total, choice = float(cost[at]), [at]
    for came in reversed(back):
        at = int(came[at])
        choice.append(at)
    return total, choice[::-1]


def service_cost(order: list[int], spray: np.ndarray, centres: np.ndarray, stations: np.ndarray, dry_at: tuple[float, ...]) -> float:
    """Twice the way from where each load runs out to the nearest station."""
    total, cost = float(spray[order].sum()), 0.0
    if not len(stations) or total <= 0:
        return 0.0
    ends = np.cumsum(spray[order])
    for f in dry_at:
        if 0 < f < 1:
            at = order[min(len(order) - 1, int(np.searchsorted(ends, total * f)))]
            cost += 2 * float(metres(centres[at], stations).min())
    return cost


class _Trials:
    """Costs of reversing a run of an order, each in constant time.

    A path over the four ways round each fragment is a min-plus product of 4 x 4 steps. The products before and after a run are kept as vectors; for runs that begin
    at one place the product of the reversed run grows by one step with each place that the run goes on.
    """

    def __init__(self, order: list[int], corners: np.ndarray, spray: np.ndarray, centres: np.ndarray, home: np.ndarray, stations: np.ndarray, dry_at: tuple[float, ...]):
        self.begin, self.end, self.home = corners[:, list(STARTS)], corners[:, list(ENDS)], home
        self.spray, total = spray, float(spray.sum())
        some = len(stations) and total > 0
        self.dry = np.array([f for f in dry_at if 0 < f < 1], float) * total if some else np.zeros(0)
        self.trip = 2 * metres(centres[:, None, :], stations[None, :, :]).min(axis=1) if some else np.zeros(len(spray))
        self.set(order)

    def set(self, order: list[int]) -> None:
        self.order = np.array(order)
        o, n = self.order, len(order)
        leave, enter = self.end[o], self.begin[o]
        self.forth = metres(leave[:-1, :, None, :], enter[1:, None, :, :])  # from place j to j + 1
        self.back = metres(leave[1:, :, None, :], enter[:-1, None, :, :])  # from place j + 1 to j
        self.before, self.after = np.zeros((n, 4)), np.zeros((n, 4))
        self.before[0], self.after[-1] = metres(self.home, enter[0]), metres(leave[-1], self.home)
        for k in range(1, n):
            self.before[k] = (self.before[k - 1][:, None] + self.forth[k - 1]).min(axis=0)
            self.after[n - 1 - k] = (self.forth[n - 1 - k] + self.after[n - k][None, :]).min(axis=1)
        self.sums = np.concatenate([[0.0], np.cumsum(self.spray[o])])

    def cost(self) -> float:
        return float((self.before[-1] + self.after[-1]).min()) + self.service(0, np.zeros(1, int))[0]

    def service(self, i: int, js: np.ndarray) -> np.ndarray:
        """Trips to the stations if the run from i to each j is reversed: a dry point in the run is where its mirror image was."""
        out, n = np.zeros(len(js)), len(self.order)
        for at in self.dry:
            own = np.minimum(n - 1, np.searchsorted(self.sums[1:], at))
            place = np.full(len(js), own)
            within = (own >= i) & (own <= js)
            mirror = self.sums[i] + self.sums[js + 1] - at
            place[within] = np.clip(np.searchsorted(self.sums, mirror[within], side="right") - 1, i, js[within])
            out += self.trip[self.order[place]]
        return out

    def reversals(self, i: int) -> np.ndarray:
        """The costs for runs from i to each place behind it."""
        o, n = self.order, len(self.order)
        js = np.arange(i + 1, n)
        run, product = np.zeros((len(js), 4, 4)), np.where(np.eye(4) > 0, 0.0, np.inf)
        for k, j in enumerate(js.tolist()):
            product = (self.back[j - 1][:, :, None] + product[None, :, :]).min(axis=1)
            run[k] = product
        into = self.begin[o[js]]
        if i:
            head = (self.before[i - 1][None, :, None] + metres(self.end[o[i - 1]][None, :, None, :], into[:, None, :, :])).min(axis=1)
        else:
            head = metres(self.home, into)
        tail = np.zeros((len(js), 4))
        tail[:-1] = (metres(self.end[o[i]][None, :, None, :], self.begin[o[js[1:]]][:, None, :, :]) + self.after[js[1:]][:, None, :]).min(axis=2)
        tail[-1] = metres(self.end[o[i]], self.home)
        return (head[:, :, None] + run + tail[:, None, :]).min(axis=(1, 2)) + self.service(i, js)


def order_fragments(corners: np.ndarray, spray: np.ndarray, centres: np.ndarray, home: np.ndarray, stations: np.ndarray, dry_at: tuple[float, ...] = (), sweeps: int = 12) -> tuple[list[int], list[int], float]:
    """(order, ways round, cost): nearest neighbour from home, then reversals of runs while they gain, the cost being that of the best ways
    round, the way home and the trips to the stations."""
    left, order, here = list(range(len(corners))), [], home
    while left:
        reach = metres(here, corners[left][:, list(STARTS)])
        k, o = divmod(int(reach.argmin()), 4)
        here = corners[left[k]][ENDS[o]]
        order.append(left.pop(k))
    if not order:
        return [], [], 0.0
    trials = _Trials(order, corners, spray, centres, home, stations, dry_at)
    cost = trials.cost()
    for _ in range(sweeps):
        better = False
        for i in range(len(order) - 1):
            done = i  # runs up to here were tried
            while done < len(order) - 1:
                costs = trials.reversals(i)[done - i :]
                gain = np.flatnonzero(costs < cost - 1e-6)
                if not len(gain):
                    break
                done += int(gain[0]) + 1
                order[i : done + 1] = order[i : done + 1][::-1]
                trials.set(order)
                cost, better = trials.cost(), True
        if not better:
            break
    return order, tour_cost(order, corners, home)[1], cost
