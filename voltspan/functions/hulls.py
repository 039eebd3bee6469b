"""Hulls that follow their points, and round buffers, on points in a plane (metres)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from voltspan.functions.shapes import outline

#: Points of a quarter of a circle.
QUARTER = 16


def triangles(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles of distinct points (places of three points each), by inserting one point after the other; none if all are on a line."""
    n = len(points)
    middle, size = (points.min(axis=0) + points.max(axis=0)) / 2, max(float(np.ptp(points, axis=0).max()), 1e-9)
    scaled = (points - middle) / size
    p = np.concatenate((scaled, [(-3e3, -2e3), (3e3, -2e3), (0.0, 4e3)]))
    tri = np.array([(n, n + 1, n + 2)])

    def circles(t: np.ndarray) -> np.ndarray:
        a, b, c = p[t[:, 0]], p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]]
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        bb, cc = (b**2).sum(axis=1), (c**2).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y = (c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d
        return np.stack((a[:, 0] + x, a[:, 1] + y, x * x + y * y), 1)

    around = circles(tri)
    for i in np.lexsort((scaled[:, 1], scaled[:, 0])):
        hit = ~((p[i, 0] - around[:, 0]) ** 2 + (p[i, 1] - around[:, 1]) ** 2 > around[:, 2] * (1 + 1e-12))
        bad = tri[hit]
        edges = np.concatenate((bad[:, [0, 1]], bad[:, [1, 2]], bad[:, [2, 0]]))
        _, first, counts = np.unique(np.sort(edges, axis=1), axis=0, return_index=True, return_counts=True)
        rim = edges[first[counts == 1]]
        new = np.concatenate((rim, np.full((len(rim), 1), i)), axis=1)
        tri, around = np.concatenate((tri[~hit], new)), np.concatenate((around[~hit], circles(new)))
    tri = tri[(tri < n).all(axis=1)]
    a, b, c = (scaled[tri[:, k]] for k in range(3))
    return tri[np.abs((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) > 1e-13]


def concave(points: np.ndarray, ratio: float, solid: Sequence[np.ndarray] = ()) -> np.ndarray:
    """A ring around all points, closed and counter-clockwise, whose sides are no longer than need be.

    The triangles at the rim whose outer side is longer than `ratio` of the way from the shortest to the longest side are taken away, longest
    first, as long as what is left hangs together and has all points. A ratio of one leaves the convex hull. solid: closed convex
    rings that stay covered. Points on a line, or fewer than three, give their ends.
    """
    distinct = np.unique(points, axis=0)
    hull = outline(distinct)
    tri = triangles(distinct) if len(hull) > 3 else np.zeros((0, 3), int)
    corners = {tuple(x) for x in hull}
    if not len(tri):
        return hull
    sides = np.concatenate((tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]))
    length = np.hypot(*(distinct[sides[:, 0]] - distinct[sides[:, 1]]).T)
    most = length.min() + ratio * (length.max() - length.min())
    of: dict[tuple[int, int], set[int]] = {}
    for k, (a, b, c) in enumerate(tri.tolist()):
        for side in ((a, b), (b, c), (c, a)):
            of.setdefault((min(side), max(side)), set()).add(k)
    rim = {s for s, t in of.items() if len(t) == 1}
    at_rim = {v for s in rim for v in s}
    if not corners <= {tuple(distinct[v]) for v in at_rim}:
        return hull  # the triangles don't reach all corners: numbers too close
    lows, highs = (np.array([f(r, axis=0) for r in solid]).reshape(-1, 2) for f in (np.min, np.max))
    far = lambda s: math.dist(distinct[s[0]], distinct[s[1]])
    queue = sorted((s for s in rim if far(s) > most), key=far)
    while queue:
        side = queue.pop()
        if side not in rim:
            continue
        (k,) = of[side]
        (apex,) = set(tri[k].tolist()) - set(side)
        if apex in at_rim:
            continue
        corner = distinct[tri[k]]
        near = np.flatnonzero((lows < corner.max(axis=0)).all(axis=1) & (highs > corner.min(axis=0)).all(axis=1))
        if any(overlap(corner[[0, 1, 2, 0]], solid[i]) for i in near.tolist()):
            continue
        rim.remove(side)
        at_rim.add(apex)
        for v in side:
            inner = (min(v, apex), max(v, apex))
            of[inner].discard(k)
            rim.add(inner)
            if far(inner) > most:
                queue.append(inner)
        queue.sort(key=far)
    return walked(rim, distinct) if len(rim) == len(at_rim) else hull


def overlap(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two closed convex rings have more than their rims in common: no side of either parts them."""
    for ring in (one, other):
        across = np.diff(ring, axis=0)[:, ::-1] * (1.0, -1.0)
        a, b = one @ across.T, other @ across.T
        gap = np.maximum(b.min(axis=0) - a.max(axis=0), a.min(axis=0) - b.max(axis=0))
        if (gap >= -1e-9 * np.abs(a).max(axis=0)).any():
            return False
    return True


def walked(rim: set[tuple[int, int]], points: np.ndarray) -> np.ndarray:
    """The ring that sides make, counter-clockwise."""
    beside: dict[int, list[int]] = {}
    for a, b in rim:
        beside.setdefault(a, []).append(b)
        beside.setdefault(b, []).append(a)
    first = min(beside)
    ring, before = [first, min(beside[first])], first
    while ring[-1] != first:
        after = next(v for v in beside[ring[-1]] if v != before)
        before = ring[-1]
        ring.append(after)
    out = points[ring]
    return out if area(out) > 0 else out[::-1]


def area(ring: np.ndarray) -> float:
    """The signed area of a closed ring: above zero if counter-clockwise."""
    base = ring - ring[0]
    return float((base[:-1, 0] * base[1:, 1] - base[1:, 0] * base[:-1, 1]).sum() / 2)


def arc(centre: np.ndarray, radius: float, start: float, turn: float) -> list[tuple[float, float]]:
    """Points around a centre from an angle, over a turn, at least as many as QUARTER asks for."""
    steps = max(1, math.ceil(round(turn / (math.pi / 2 / QUARTER), 9)))
    return [(centre[0] + radius * math.cos(start + turn * k / steps), centre[1] + radius * math.sin(start + turn * k / steps)) for k in range(steps + 1)]


def buffered(ring: np.ndarray, radius: float) -> np.ndarray:
    """A closed ring about `radius` around one point, a line's two ends, or a closed ring: arcs at corners, and at corners that turn inwards
    the point where the moved sides meet. An inward corner with a side shorter than twice the radius is filled before."""
    distinct = [tuple(p) for p in ring]
    if len(set(distinct)) == 1:
        out = arc(ring[0], radius, 0.0, 2 * math.pi)[:-1]
        return np.array([*out, out[0]])
    points = distinct[:-1] if len(distinct) > 3 and distinct[0] == distinct[-1] else list(dict.fromkeys(distinct))
    if len(points) == 2 or len(points) == 3 and abs(area(np.array([*points, points[0]]))) < 1e-9:
        ends = sorted(points)
        points = [ends[0], ends[-1]]
    turn_at = lambda i: _turn(points[i - 1], points[i], points[(i + 1) % len(points)])
    near = lambda i: min(math.dist(points[i - 1], points[i]), math.dist(points[i], points[(i + 1) % len(points)])) < 2 * radius
    while len(points) > 3 and (short := [i for i in range(len(points)) if turn_at(i) < 0 and near(i)]):
        del points[short[0]]
    out: list[tuple[float, float]] = []
    for i, p in enumerate(points):
        before, turn = points[i - 1], turn_at(i)
        heading = math.atan2(p[1] - before[1], p[0] - before[0])
        if turn >= 0 or len(points) == 2:
            out += arc(np.array(p), radius, heading - math.pi / 2, turn if len(points) > 2 else math.pi)
        else:
            middle, reach = heading - math.pi / 2 + turn / 2, radius / max(math.cos(turn / 2), 0.25)
            out.append((p[0] + reach * math.cos(middle), p[1] + reach * math.sin(middle)))
    return np.array([*out, out[0]])


def _turn(a: tuple, b: tuple, c: tuple) -> float:
    """The angle by which a way from a over b to c turns left, between minus pi and pi."""
    turn = math.atan2(c[1] - b[1], c[0] - b[0]) - math.atan2(b[1] - a[1], b[0] - a[0])
    return (turn + math.pi) % (2 * math.pi) - math.pi
