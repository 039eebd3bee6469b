"""Geometry on columns: lines and rings are arrays of structs (lon, lat) in degrees."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radii in metres of distances on a line, of chords, and of areas; half the width of the Mercator square.
R_LINE, R_CHORD, R_AREA = 6371008.8, 6371000.0, 6378137.0
MERCATOR = math.pi * R_AREA


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points on a sphere."""
    rad = math.pi / 180
    a = F.pow(F.sin((lat2 - lat1) * F.lit(rad / 2)), F.lit(2.0)) + F.cos(lat1 * F.lit(rad)) * F.cos(lat2 * F.lit(rad)) * F.pow(F.sin((lon2 - lon1) * F.lit(rad / 2)), F.lit(2.0))
    return F.lit(2 * R_LINE) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    rad = F.lit(math.pi / 180)
    return F.cos(lat * rad) * F.cos(lon * rad), F.cos(lat * rad) * F.sin(lon * rad), F.sin(lat * rad)


def chord_of(metres: float) -> float:
    """The chord on the unit sphere of an arc of so many metres."""
    return 2 * math.sin(metres / (2 * R_CHORD))


def line_length(line: Column) -> Column:
    """Metres along a line; 0 for fewer than two points."""
    steps = F.zip_with(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: haversine(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)


def ring_area(ring: Column) -> Column:
    """Square metres inside a ring on a sphere; the last point joins the first."""
    rad = F.lit(math.pi / 180)
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    terms = F.zip_with(ring, after, lambda a, b: (b["lon"] - a["lon"]) * rad * (F.lit(2.0) + F.sin(a["lat"] * rad) + F.sin(b["lat"] * rad)))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)) * F.lit(R_AREA * R_AREA / 2)


def polygon_area(rings: Column) -> Column:
    """The first ring's area less the holes'."""
    areas = F.transform(rings, ring_area)
    return F.greatest(F.lit(0.0), F.lit(2.0) * F.get(areas, F.lit(0)) - F.aggregate(areas, F.lit(0.0), lambda total, x: total + x))


def bounds(points: Column) -> Column:
    """A struct (west, south, east, north)."""
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))


def vertex_mean(points: Column) -> Column:
    """A struct (lon, lat): the mean of the points, a closing one included."""
    mean = lambda name: F.aggregate(points, F.lit(0.0), lambda total, p: total + p[name]) / F.size(points)
    return F.struct(mean("lon").alias("lon"), mean("lat").alias("lat"))


def middle_vertex(line: Column) -> Column:
    return F.get(line, F.floor(F.size(line) / 2).cast("int"))


def rounded(points: Column, places: int) -> Column:
    """Coordinates rounded half to even."""
    return F.transform(points, lambda p: F.struct(F.bround(p["lon"], places).alias("lon"), F.bround(p["lat"], places).alias("lat")))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres in the spherical Mercator projection."""
    return lon * F.lit(MERCATOR / 180), F.log(F.tan(F.lit(math.pi / 4) + lat * F.lit(math.pi / 360))) * F.lit(R_AREA)


def pixel(lon: Column, lat: Column, zoom: int, tile: int = 512) -> tuple[Column, Column]:
    """World pixels at a zoom, from the north-west corner."""
    x, y = mercator(lon, lat)
    world = tile * 2**zoom
    return (x + F.lit(MERCATOR)) * F.lit(world / (2 * MERCATOR)), (F.lit(MERCATOR) - y) * F.lit(world / (2 * MERCATOR))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point is inside a ring: an odd number of its sides cross the ray to the east."""
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    crosses = F.zip_with(ring, after, lambda a, b: ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]))
    return F.pmod(F.size(F.filter(crosses, lambda c: c)), F.lit(2)) == 1


def wkt_line(line: Column, places: int = 6) -> Column:
    """`LINESTRING (lon lat, ...)`."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", F.bround(p["lon"], places).cast("string"), F.bround(p["lat"], places).cast("string"))), ", "), F.lit(")"))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of a place in the spherical Mercator projection."""
    return x / F.lit(MERCATOR / 180), (F.lit(2.0) * F.atan(F.exp(y / F.lit(R_AREA))) - F.lit(math.pi / 2)) * F.lit(180 / math.pi)


def segments(line: Column) -> Column:
    """The sides of a line, as structs (from_lon, from_lat, to_lon, to_lat)."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    side = lambda a, b: F.struct(a["lon"].alias("from_lon"), a["lat"].alias("from_lat"), b["lon"].alias("to_lon"), b["lat"].alias("to_lat"))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), side)


def projected_centroid(line: Column) -> Column:
    """A struct (lon, lat): the centroid of a line by length in the Mercator projection; null for a line without length."""

    def weighed(s: Column) -> Column:
        (x0, y0), (x1, y1) = mercator(s["from_lon"], s["from_lat"]), mercator(s["to_lon"], s["to_lat"])
        length = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
        return F.struct(length.alias("w"), (length * (x0 + x1) / 2).alias("x"), (length * (y0 + y1) / 2).alias("y"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(F.transform(segments(line), weighed), zero, lambda a, s: F.struct((a["w"] + s["w"]).alias("w"), (a["x"] + s["x"]).alias("x"), (a["y"] + s["y"]).alias("y")))
    length = F.nullif(total["w"], F.lit(0.0))
    lon, lat = from_mercator(total["x"] / length, total["y"] / length)
    return F.when(total["w"] > 0, F.struct(lon.alias("lon"), lat.alias("lat")))


#: The ellipsoid's flattening, and the parallels and origin of the equal-area projection of the conterminous states.
FLATTENING, ALBERS_PARALLELS, ALBERS_LAT, ALBERS_LON = 1 / 298.257222101, (29.5, 45.5), 23.0, -96.0
ALBERS_E = math.sqrt(2 * FLATTENING - FLATTENING**2)


def _authalic(sine: float) -> float:
    e = ALBERS_E
    return (1 - e * e) * (sine / (1 - e * e * sine * sine) - math.log((1 - e * sine) / (1 + e * sine)) / (2 * e))


def _parallel(lat: float) -> tuple[float, float]:
    """Squared radius of a parallel (the semi-axis as unit), and its authalic value."""
    s = math.sin(math.radians(lat))
    return (1 - s * s) / (1 - (ALBERS_E * s) ** 2), _authalic(s)


(_M1, _Q1), (_M2, _Q2) = map(_parallel, ALBERS_PARALLELS)
ALBERS_N = (_M1 - _M2) / (_Q2 - _Q1)
ALBERS_C = _M1 + ALBERS_N * _Q1
ALBERS_RHO0 = R_AREA * math.sqrt(ALBERS_C - ALBERS_N * _parallel(ALBERS_LAT)[1]) / ALBERS_N


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres in the equal-area conic projection."""
    e, s = ALBERS_E, F.sin(lat * F.lit(math.pi / 180))
    q = F.lit(1 - e * e) * (s / (F.lit(1.0) - F.lit(e * e) * s * s) - F.log((F.lit(1.0) - F.lit(e) * s) / (F.lit(1.0) + F.lit(e) * s)) / F.lit(2 * e))
    rho = F.lit(R_AREA / ALBERS_N) * F.sqrt(F.lit(ALBERS_C) - F.lit(ALBERS_N) * q)
    theta = F.lit(ALBERS_N * math.pi / 180) * (lon - F.lit(ALBERS_LON))
    return rho * F.sin(theta), F.lit(ALBERS_RHO0) - rho * F.cos(theta)


def albers_length(line: Column) -> Column:
    """Metres along a line in the equal-area projection."""

    def length(s: Column) -> Column:
        (x0, y0), (x1, y1) = albers(s["from_lon"], s["from_lat"]), albers(s["to_lon"], s["to_lat"])
        return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))

    return F.aggregate(F.transform(segments(line), length), F.lit(0.0), lambda total, x: total + x)


def clipped_segment(side: Column, box: tuple) -> Column:
    """The part of a side inside a box (west, south, east, north; numbers or columns), by the share of it at which it enters and leaves; else null."""
    west, south, east, north = (b if isinstance(b, Column) else float(b) for b in box)
    x, y = side["from_lon"], side["from_lat"]
    dx, dy = side["to_lon"] - x, side["to_lat"] - y

    def share(edge: float | Column, start: Column, step: Column) -> Column:
        return (F.lit(edge) - start) / F.nullif(step, F.lit(0.0))

    def enters(start: Column, step: Column, low: float | Column, high: float | Column) -> Column:
        beside = F.when(start.between(low, high), 0.0).otherwise(2.0)
        return F.when(step > 0, share(low, start, step)).when(step < 0, share(high, start, step)).otherwise(beside)

    def leaves(start: Column, step: Column, low: float | Column, high: float | Column) -> Column:
        return F.when(step > 0, share(high, start, step)).when(step < 0, share(low, start, step)).otherwise(1.0)

    first = F.greatest(F.lit(0.0), enters(x, dx, west, east), enters(y, dy, south, north))
    last = F.least(F.lit(1.0), leaves(x, dx, west, east), leaves(y, dy, south, north))
    inside = F.struct((x + first * dx).alias("from_lon"), (y + first * dy).alias("from_lat"), (x + last * dx).alias("to_lon"), (y + last * dy).alias("to_lat"))
    return F.when(first < last, inside)


def ring_problem(ring: Column) -> Column:
    """`short` for fewer than four points, `open` if the last isn't the first, else null."""
    return F.when(F.size(ring) < 4, "short").when(F.get(ring, F.lit(0)) != F.element_at(ring, -1), "open")


def as_polygons(rings: Column) -> Column:
    """A struct (kind, polygons): each ring becomes a polygon of its own, several a MultiPolygon."""
    return F.struct(F.when(F.size(rings) == 1, "Polygon").otherwise("MultiPolygon").alias("kind"), F.transform(rings, lambda r: F.array(r)).alias("polygons"))


def near_click(lon: Column, lat: Column, at_lon: float, at_lat: float, zoom: int, pixels: int) -> Column:
    """Whether a point is in the square of so many pixels to each side of a click at a zoom."""
    (x, y), (cx, cy) = pixel(lon, lat, zoom), pixel(F.lit(at_lon), F.lit(at_lat), zoom)
    return (F.abs(x - cx) <= pixels) & (F.abs(y - cy) <= pixels)


def rounded_nested(coordinates: Column, depth: int, places: int) -> Column:
    """Coordinates in nested arrays, `depth` deep, each number rounded: 1 for a point, 4 for several polygons."""
    return F.transform(coordinates, lambda c: rounded_nested(c, depth - 1, places)) if depth else F.round(coordinates, places)


#: How deep the coordinates of each kind of geometry lie in arrays.
DEPTHS = {"Point": 1, "LineString": 2, "MultiPoint": 2, "Polygon": 3, "MultiLineString": 3, "MultiPolygon": 4}


def collected(geometry: Column, nested: int = 3) -> Column:
    """All coordinates of a GeoJSON geometry (a variant) as one array of arrays of numbers, in order; those of collections too, as deep as `nested` of them.

    A missing geometry, one of another kind or without coordinates has none.
    """
    kind, out = F.try_variant_get(geometry, "$.type", "string"), F.array().cast("array<array<double>>")
    for name, depth in DEPTHS.items():
        points = F.try_variant_get(geometry, "$.coordinates", "array<" * depth + "double" + ">" * depth)
        for _ in range(depth - 2):
            points = F.flatten(points)
        out = F.when(kind == name, F.array(points) if depth == 1 else points).otherwise(out)
    if nested:
        parts = F.try_variant_get(geometry, "$.geometries", "array<variant>")
        out = F.when(kind == "GeometryCollection", F.flatten(F.transform(parts, lambda g: collected(g, nested - 1)))).otherwise(out)
    return F.coalesce(out, F.array().cast("array<array<double>>"))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once for a row, however often `then` names it: a column named several times in functions of arrays is computed anew for each, and each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def inside_point(rings: Column) -> Column:
    """A struct (lon, lat) inside a polygon given by its closed rings, holes included: the middle of the widest stretch inside it on a level line.

    The line lies halfway between the vertices next above and below the middle of its height, so it meets none; of stretches equally wide the
    westernmost counts. A polygon without height has none.
    """
    lats = F.transform(F.flatten(rings), lambda p: p["lat"])

    def halfway(y: Column) -> Column:
        return bound((F.array_max(y) + F.array_min(y)) / 2, lambda middle: (F.array_max(F.filter(y, lambda v: v <= middle)) + F.array_min(F.filter(y, lambda v: v > middle))) / 2)

    def widest(level: Column) -> Column:
        sides = F.filter(F.flatten(F.transform(rings, segments)), lambda s: (s["from_lat"] > level) != (s["to_lat"] > level))
        met = F.array_sort(F.transform(sides, lambda s: s["from_lon"] + (level - s["from_lat"]) * (s["to_lon"] - s["from_lon"]) / (s["to_lat"] - s["from_lat"])))
        return bound(met, lambda m: bound(stretches(m), lambda pairs: F.when(level.isNotNull() & (F.size(pairs) > 0), F.struct(F.array_min(pairs)["lon"].alias("lon"), level.alias("lat")))))

    def stretches(met: Column) -> Column:
        return F.filter(F.transform(met, lambda x, i: F.struct((x - F.get(met, i + 1)).alias("w"), ((x + F.get(met, i + 1)) / 2).alias("lon"), i.alias("i"))), lambda s: s["i"] % 2 == 0)

    return bound(bound(lats, halfway), widest)


def representative_point(kind: Column, points: Column, rings: Column) -> Column:
    """A struct (lon, lat) on a geometry: a point itself, a line's middle vertex, a place inside a polygon; null for other kinds."""
    polygon = F.when(kind == "Polygon", inside_point(rings))
    return F.when(kind == "Point", F.get(points, F.lit(0))).when(kind == "LineString", middle_vertex(points)).otherwise(polygon)
