"""Geometry that columns can't express, as Arrow functions on one line or point set at a time: simplified lines, convex hulls."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

POINTS = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))


def _each(shapes: pa.Array, work: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    out = []
    for shape in shapes.to_pylist():
        points = None if shape is None else work(np.array([(p["lon"], p["lat"]) for p in shape], float).reshape(-1, 2))
        out.append(None if points is None else [{"lon": float(x), "lat": float(y)} for x, y in points])
    return pa.array(out, _ARROW)


def thinned(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The points without which some part of the line would be farther than the tolerance from the line that is left."""
    n = len(points)
    if n < 3:
        return points
    keep = np.zeros(n, bool)
    keep[[0, n - 1]] = True
    spans = [(0, n - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        base, between = points[b] - points[a], points[a + 1 : b] - points[a]
        square = base @ base
        share = np.clip(between @ base / square, 0, 1) if square else np.zeros(len(between))
        far = np.hypot(*(between - share[:, None] * base).T)
        most = int(far.argmax())
        if far[most] > tolerance:
            keep[a + 1 + most] = True
            spans += [(a, a + 1 + most), (a + 1 + most, b)]
    return points[keep]


def outline(points: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise, closed; fewer than three distinct points give those points."""
    distinct = np.unique(points, axis=0)
    if len(distinct) < 3:
        return distinct
    halves = []
    for ordered in (distinct, distinct[::-1]):
        half: list[np.ndarray] = []
        for p in ordered:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) <= (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0]):
                half.pop()
            half.append(p)
        halves.append(half)
    return np.array([*halves[0][:-1], *halves[1]])


def simplify(tolerance: float) -> Callable[[Column], Column]:
    """A function of lines (lon, lat), to a tolerance in degrees; the first and last points stay."""

    @arrow_udf(POINTS)
    def simplified(shapes: pa.Array) -> pa.Array:
        return _each(shapes, lambda p: thinned(p, tolerance))

    return simplified


@arrow_udf(POINTS)
def hull(shapes: pa.Array) -> pa.Array:
    """The ring around each set of points."""
    return _each(shapes, outline)
