"""Queries of tile pyramids: budgets, lines cut by tiles, viewports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voltspan.functions import geo
from voltspan.operators import tiles
from voltspan.plans.fixtures import view, with_views
from voltspan.plans.places import lines
from voltspan.plans.registry import register
from voltspan.tables import scratch

LOW, HIGH, BUDGET = 4, 10, 2500
_X = lambda lon: f"(({lon}) * {geo.MERCATOR / 180!r} + {geo.MERCATOR!r}) * {1 / (2 * geo.MERCATOR)!r}"
_Y = lambda lat: f"({geo.MERCATOR!r} - ln(tan({math.pi / 4!r} + ({lat}) * {math.pi / 360!r})) * {geo.R_AREA!r}) * {1 / (2 * geo.MERCATOR)!r}"
_STEP = lambda world: f"floor({world} * power(2e0, zoom) * {tiles.EXTENT})"
_POINTS = f"""pieces AS (SELECT id, sqft, id % 16 AS tie, zoom::INT AS zoom, CAST(floor({_STEP(_X('lon'))} / {tiles.EXTENT}) AS BIGINT) AS x, CAST(floor({_STEP(_Y('lat'))} / {tiles.EXTENT}) AS BIGINT) AS y, 40 + id % 50 AS bytes
    FROM points_a, range({LOW}, {HIGH + 1}) z(zoom)),
    kept AS (SELECT id, zoom, x, y, bytes FROM pieces QUALIFY sum(bytes) OVER (PARTITION BY zoom, x, y ORDER BY sqft DESC, tie) <= {BUDGET})"""


def kept_points(spark, sf_dir):
    points = view(spark, sf_dir, "points_a").withColumns({"tie": F.col("id") % 16, "lon": F.col("lon").cast("double"), "lat": F.col("lat").cast("double")})
    return tiles.within_budget(tiles.point_pieces(points, LOW, HIGH, 40 + F.col("id") % 50), "sqft", "tie", BUDGET)


@register("tile_budget", with_views(f"WITH {_POINTS} SELECT id, zoom, x, y FROM kept", "points_a"))
def tile_budget(spark, sf_dir):
    """The points that stay in each tile of seven zooms, none over its budget of bytes."""
    return kept_points(spark, sf_dir).select("id", "zoom", "x", "y")


_SIDES = " + ".join(f"sqrt(power({_STEP(_X(f'lon + {b[0]}e0'))} - {_STEP(_X(f'lon + {a[0]}e0'))}, 2) + power({_STEP(_Y(f'lat + {b[1]}e0'))} - {_STEP(_Y(f'lat + {a[1]}e0'))}, 2))" for a, b in (((0.0, 0.0), (0.01, 0.02)), ((0.01, 0.02), (0.03, -0.01))))


@register("tile_lines", with_views(f"SELECT zoom::INT AS zoom, count(*) AS lines, round(sum({_SIDES}), 1) AS steps FROM points_a, range(6, 13) z(zoom) GROUP BY zoom", "points_a"))
def tile_lines(spark, sf_dir):
    """Lines clipped to the tiles of seven zooms: how many there are, and how long they are in all their tiles together."""
    pieces = tiles.line_pieces(lines(spark, sf_dir), "id", "line", 6, 12)
    length = F.aggregate("sides", F.lit(0.0), lambda total, s: total + F.sqrt((s["x1"] - s["x0"]) * (s["x1"] - s["x0"]) + (s["y1"] - s["y0"]) * (s["y1"] - s["y0"])))
    by_line = pieces.groupBy("zoom", "id").agg(F.sum(length).alias("steps"))
    return by_line.groupBy("zoom").agg(F.count("*").alias("lines"), F.round(F.sum("steps"), 1).alias("steps"))


VIEW = (-99.2, 40.1, -98.7, 40.45)
_RANGE = lambda c, a, b, f: f"{c} BETWEEN CAST(floor({f(a)} * 512) AS BIGINT) AND CAST(floor({f(b)} * 512) AS BIGINT)"


@register("tile_viewport", with_views(f"WITH {_POINTS} SELECT id, x, y FROM kept WHERE zoom = 9 AND {_RANGE('x', f'{VIEW[0]}e0', f'{VIEW[2]}e0', _X)} AND {_RANGE('y', f'{VIEW[3]}e0', f'{VIEW[1]}e0', _Y)}", "points_a"))
def tile_viewport(spark, sf_dir):
    """The pyramid is written; a viewport reads its own part of one zoom."""
    tiles.write_pyramid(kept_points(spark, sf_dir).select("id", "zoom", "x", "y", "px", "py"), path := scratch(spark))
    return tiles.viewport(spark, path, 9, *VIEW).select("id", "x", "y")
