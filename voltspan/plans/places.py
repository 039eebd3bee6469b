"""Queries of spatial joins, geometry, clusters and grids."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voltspan.functions import geo
from voltspan.operators import raster, spatial
from voltspan.plans.fixtures import view, with_views
from voltspan.plans.registry import register

RAD = f"{math.pi / 180!r}"
HALF = f"{math.pi / 360!r}"


def metres(a: str, b: str) -> str:
    return f"{2 * geo.R_LINE!r} * asin(sqrt(least(1e0, pow(sin(({b}.lat - {a}.lat) * {HALF}), 2e0) + cos({a}.lat * {RAD}) * cos({b}.lat * {RAD}) * pow(sin(({b}.lon - {a}.lon) * {HALF}), 2e0))))"


PAIRS = "FROM points_a AS a JOIN points_b AS b ON abs(a.lat - b.lat) < 0.02 AND abs(a.lon - b.lon) < 0.02"


@register("haversine_pairs", with_views(f"SELECT id_a, id_b, round(m, 3) AS metres FROM (SELECT a.id AS id_a, b.id AS id_b, {metres('a', 'b')} AS m {PAIRS}) WHERE m < 750", "points_a", "points_b"))
def haversine_pairs(spark, sf_dir):
    a, b = view(spark, sf_dir, "points_a").withColumnRenamed("id", "id_a"), view(spark, sf_dir, "points_b").withColumnRenamed("id", "id_b")
    return spatial.within_radius(a, b, 750.0, "id_a", "id_b").select("id_a", "id_b", F.round("metres", 3).alias("metres"))


@register("radius_dedup", with_views(f"SELECT id, kind FROM points_a WHERE id NOT IN (SELECT id_a FROM (SELECT a.id AS id_a, {metres('a', 'b')} AS m {PAIRS}) WHERE m < 300)", "points_a", "points_b"))
def radius_dedup(spark, sf_dir):
    return spatial.without_neighbours(view(spark, sf_dir, "points_a"), view(spark, sf_dir, "points_b"), 300.0).select("id", "kind")


@register("nearest_within", with_views(f"SELECT id_a, id_b FROM (SELECT a.id AS id_a, b.id AS id_b, {metres('a', 'b')} AS m {PAIRS}) WHERE m < 750 QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY m, id_b) = 1", "points_a", "points_b"))
def nearest_within(spark, sf_dir):
    a, b = view(spark, sf_dir, "points_a").withColumnRenamed("id", "id_a"), view(spark, sf_dir, "points_b").withColumnRenamed("id", "id_b")
    return spatial.nearest_within(a, b, 750.0, "id_a", "id_b").select("id_a", "id_b")


@register(
    "nearest_enrich",
    with_views(
        f"""WITH own AS (SELECT a.id, a.lon, a.lat, CASE WHEN a.id % 10 = 0 THEN b.sqft END AS sqft FROM points_a AS a LEFT JOIN points_b AS b ON a.id = b.id),
        near AS (SELECT id, sqft FROM (SELECT a.id, b.sqft, b.id AS bid, {metres('a', 'b')} AS m FROM own AS a JOIN points_b AS b ON abs(a.lat - b.lat) < 0.02 AND abs(a.lon - b.lon) < 0.02 WHERE a.sqft IS NULL AND b.sqft IS NOT NULL) WHERE m < 750 QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, bid) = 1)
        SELECT own.id, coalesce(own.sqft, near.sqft) AS sqft FROM own LEFT JOIN near USING (id)""",
        "points_a",
        "points_b",
    ),
)
def nearest_enrich(spark, sf_dir):
    a, b = view(spark, sf_dir, "points_a").drop("sqft"), view(spark, sf_dir, "points_b").select("id", "lon", "lat", "sqft")
    # a tenth has a row of its own key; the rest take the nearest
    keyed = b.withColumn("key", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-F.col("id") - 1))
    return spatial.enrich_nearest(a, keyed.drop("id"), "id", "key", "sqft", 750.0).select("id", "sqft")


LINE = "[{'lon': lon, 'lat': lat}, {'lon': lon + 0.01, 'lat': lat + 0.02}, {'lon': lon + 0.03, 'lat': lat - 0.01}]"
RING = "[{'lon': lon, 'lat': lat}, {'lon': lon + 0.01, 'lat': lat}, {'lon': lon + 0.01, 'lat': lat + 0.02}, {'lon': lon, 'lat': lat + 0.02}, {'lon': lon, 'lat': lat}]"


def shifted(*steps):
    return F.array(*(F.struct((F.col("lon") + F.lit(x)).alias("lon"), (F.col("lat") + F.lit(y)).alias("lat")) for x, y in steps))


def lines(spark, sf_dir):
    return view(spark, sf_dir, "points_a").withColumn("line", shifted((0.0, 0.0), (0.01, 0.02), (0.03, -0.01)))


def rings(spark, sf_dir):
    return view(spark, sf_dir, "points_a").withColumn("ring", shifted((0.0, 0.0), (0.01, 0.0), (0.01, 0.02), (0.0, 0.02), (0.0, 0.0)))


@register("line_length", with_views(f"SELECT id, round({metres('p0', 'p1')} + {metres('p1', 'p2')}, 3) AS metres FROM (SELECT id, {{'lon': lon + 0e0, 'lat': lat + 0e0}} AS p0, {{'lon': lon + 0.01e0, 'lat': lat + 0.02e0}} AS p1, {{'lon': lon + 0.03e0, 'lat': lat + -0.01e0}} AS p2 FROM points_a)", "points_a"))
def line_length(spark, sf_dir):
    return lines(spark, sf_dir).select("id", F.round(geo.line_length(F.col("line")), 3).alias("metres"))


@register("ring_area", with_views(f"SELECT id, round(abs((((lon + 0.01e0) - lon) * {RAD}) * (2e0 + sin(lat * {RAD}) + sin(lat * {RAD})) + ((lon - (lon + 0.01e0)) * {RAD}) * (2e0 + sin((lat + 0.02e0) * {RAD}) + sin((lat + 0.02e0) * {RAD}))) * {geo.R_AREA**2 / 2!r}, 0) AS square_metres FROM points_a", "points_a"))
def ring_area(spark, sf_dir):
    return rings(spark, sf_dir).select("id", F.round(geo.ring_area(F.col("ring")), 0).alias("square_metres"))


@register("bounds", with_views("SELECT id, lon + 0e0 AS west, lat + -0.01e0 AS south, lon + 0.03e0 AS east, lat + 0.02e0 AS north FROM points_a", "points_a"))
def bounds(spark, sf_dir):
    return lines(spark, sf_dir).select("id", geo.bounds(F.col("line")).alias("b")).select("id", "b.*")


@register("centroid_vertices", with_views("SELECT id, round((lon + (lon + 0.01e0) + (lon + 0.01e0) + lon + lon) / 5, 9) AS lon, round((lat + lat + (lat + 0.02e0) + (lat + 0.02e0) + lat) / 5, 9) AS lat FROM points_a", "points_a"))
def centroid_vertices(spark, sf_dir):
    return rings(spark, sf_dir).select("id", geo.vertex_mean(F.col("ring")).alias("c")).select("id", F.round("c.lon", 9).alias("lon"), F.round("c.lat", 9).alias("lat"))


@register("middle_vertex", with_views("SELECT id, round_even(lon + 0.01e0, 6) AS lon, round_even(lat + 0.02e0, 6) AS lat FROM points_a", "points_a"))
def middle_vertex(spark, sf_dir):
    return lines(spark, sf_dir).select("id", geo.middle_vertex(geo.rounded(F.col("line"), 6)).alias("m")).select("id", "m.*")


@register("in_polygon", with_views("SELECT id, lon >= -99.5 AND lon < -98.5 AND lat > 40.2 AND lat <= 40.7 AS inside FROM (SELECT id, lon + 0.0003e0 AS lon, lat + 0.0003e0 AS lat FROM points_a)", "points_a"))
def in_polygon(spark, sf_dir):
    box = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((-99.5, 40.2), (-98.5, 40.2), (-98.5, 40.7), (-99.5, 40.7))))
    return view(spark, sf_dir, "points_a").select("id", geo.in_ring(F.col("lon") + F.lit(0.0003), F.col("lat") + F.lit(0.0003), box).alias("inside"))


@register("explode_multi", with_views("SELECT id, i AS part, round_even(lon + i * 0.01e0, 6) AS lon FROM points_a, range(0, 3) AS r(i)", "points_a").replace("i AS part", "i::INT AS part"))
def explode_multi(spark, sf_dir):
    multi = view(spark, sf_dir, "points_a").select("id", F.posexplode(shifted((0.0, 0.0), (0.01, 0.0), (0.02, 0.0))).alias("part", "p"))
    return multi.select("id", "part", F.bround("p.lon", 6).alias("lon"))


@register("dissolve_first", with_views("SELECT kind, count(*) AS parts, arg_min(sqft, id) AS first_sqft, min(id) AS first FROM points_a GROUP BY kind", "points_a"))
def dissolve_first(spark, sf_dir):
    grouped = view(spark, sf_dir, "points_a").groupBy("kind").agg(F.count("*").alias("parts"), F.min_by("sqft", "id").alias("first_sqft"), F.min("id").alias("first"))
    return grouped.select("kind", "parts", "first_sqft", "first")


WORLD = f"{512 * 2**9 / (2 * geo.MERCATOR)!r}"


@register("cluster_cells", with_views(f"SELECT CAST(floor((lon * {geo.MERCATOR / 180!r} + {geo.MERCATOR!r}) * {WORLD} / 40) AS BIGINT) AS cell_x, CAST(floor(({geo.MERCATOR!r} - ln(tan({math.pi / 4!r} + lat * {HALF})) * {geo.R_AREA!r}) * {WORLD} / 40) AS BIGINT) AS cell_y, count(*) AS point_count, CAST(sum(sqft) AS BIGINT) AS amount_sum FROM points_a GROUP BY ALL", "points_a"))
def cluster_cells(spark, sf_dir):
    return spatial.clusters(view(spark, sf_dir, "points_a"), 9, 40, "sqft").select("cell_x", "cell_y", "point_count", "amount_sum")


GRID = raster.Grid(-100.0, 41.0, 0.05, 0.05, 50, 40)


@register("raster_probe", with_views("SELECT id, value FROM (SELECT id, CAST(floor((41e0 - lat) / 0.05e0) AS BIGINT) AS row, CAST(floor((lon - -100e0) / 0.05e0) AS BIGINT) AS col FROM points_a) LEFT JOIN cells USING (row, col)", "points_a", "cells"))
def raster_probe(spark, sf_dir):
    return raster.probe(view(spark, sf_dir, "points_a"), view(spark, sf_dir, "cells"), GRID).select("id", "value")


@register(
    "raster_bilinear",
    with_views(
        """WITH p AS (SELECT id, (lon - -100e0) / 0.05e0 - 0.5e0 AS x, (41e0 - lat) / 0.05e0 - 0.5e0 AS y FROM points_a), q AS (SELECT *, CAST(floor(x) AS BIGINT) AS c0, CAST(floor(y) AS BIGINT) AS r0 FROM p),
        e AS (SELECT id, i, j, x - c0 AS fx, y - r0 AS fy, r0 + i AS row, c0 + j AS col FROM q, range(0, 2) AS a(i), range(0, 2) AS b(j))
        SELECT id, round(CASE WHEN count(value) = 4 THEN sum((CASE j WHEN 1 THEN fx ELSE 1 - fx END) * (CASE i WHEN 1 THEN fy ELSE 1 - fy END) * value) END, 6) AS value FROM e LEFT JOIN cells USING (row, col) GROUP BY id""",
        "points_a",
        "cells",
    ),
)
def raster_bilinear(spark, sf_dir):
    return raster.bilinear(view(spark, sf_dir, "points_a"), view(spark, sf_dir, "cells"), GRID, "id").withColumn("value", F.round("value", 6))


@register("raster_average", with_views("SELECT CAST(floor(row / 4e0) AS BIGINT) AS row, CAST(floor(col / 4e0) AS BIGINT) AS col, round(avg(value), 6) AS value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY 1, 2", "cells"))
def raster_average(spark, sf_dir):
    return raster.averaged(view(spark, sf_dir, "cells"), 4).withColumn("value", F.round("value", 6))


@register("raster_crop", with_views("SELECT row, (col + 25) % 50 AS col, value FROM cells WHERE row BETWEEN 2 AND 9 AND col BETWEEN 10 AND 20", "cells"))
def raster_crop(spark, sf_dir):
    return raster.rolled(raster.cropped(view(spark, sf_dir, "cells"), (2, 9), (10, 20)), 50)


@register("mosaic", with_views("SELECT row, col, coalesce(b.value, a.value) AS value FROM cells AS a FULL JOIN later_cells AS b USING (row, col) WHERE coalesce(b.value, a.value) IS NOT NULL", "cells", "later_cells"))
def mosaic(spark, sf_dir):
    return raster.mosaic([view(spark, sf_dir, "cells"), view(spark, sf_dir, "later_cells")])


@register("raster_combine", with_views("SELECT row, col, round(sqrt(a.value * a.value + b.value * b.value), 6) AS speed FROM cells AS a JOIN later_cells AS b USING (row, col)", "cells", "later_cells"))
def raster_combine(spark, sf_dir):
    bands = raster.combined({"u": view(spark, sf_dir, "cells"), "v": view(spark, sf_dir, "later_cells")})
    return bands.select("row", "col", F.round(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")), 6).alias("speed"))


def samples_sql(radius: str, most: int, smoothing: float) -> str:
    return f"""WITH t AS (SELECT row, col, col * 0.04e0 AS x, row * 0.04e0 AS y FROM cells), s AS (SELECT id, lon + 100e0 AS sx, lat - 40e0 AS sy, sqft * 1e0 AS v FROM points_a),
    p AS (SELECT row, col, id, v, (x - sx) * (x - sx) + (y - sy) * (y - sy) AS d2 FROM t, s WHERE abs(x - sx) <= {radius} AND abs(y - sy) <= {radius}),
    k AS (SELECT * FROM p WHERE d2 <= {radius} * {radius} QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY d2, id) <= {most})
    SELECT row, col, round(coalesce(max(CASE WHEN d2 + {smoothing} = 0 THEN v END), sum(v / (d2 + {smoothing} * {smoothing})) / sum(1e0 / (d2 + {smoothing} * {smoothing}))), 6) AS value FROM k GROUP BY row, col"""


def targets_and_samples(spark, sf_dir):
    targets = view(spark, sf_dir, "cells").selectExpr("row", "col", "col * 0.04e0 AS x", "row * 0.04e0 AS y")
    return targets, view(spark, sf_dir, "points_a").selectExpr("id", "lon + 100e0 AS x", "lat - 40e0 AS y", "sqft * 1e0 AS value")


@register("idw_grid", with_views(samples_sql("0.1e0", 7, 0.5), "cells", "points_a"))
def idw_grid(spark, sf_dir):
    return raster.interpolated(*targets_and_samples(spark, sf_dir), 0.1, 7, 0.5).withColumn("value", F.round("value", 6))


@register("nearest_grid", with_views(samples_sql("0.05e0", 1, 0.5), "cells", "points_a"))
def nearest_grid(spark, sf_dir):
    return raster.interpolated(*targets_and_samples(spark, sf_dir), 0.05, 1, 0.5).withColumn("value", F.round("value", 6))


@register("ramp_colour", with_views("SELECT row, col, CAST(coalesce(round_even(CASE WHEN value <= 900 THEN 0e0 WHEN value < 1000 THEN 0e0 + (value - 900e0) / 100e0 * 255e0 WHEN value < 1100 THEN 255e0 ELSE 255e0 END, 0), 0) AS INT) AS r, CASE WHEN value IS NULL THEN 0 ELSE 255 END AS a FROM cells", "cells"))
def ramp_colour(spark, sf_dir):
    stops = [(900, (0, 0, 255)), (1000, (255, 255, 0)), (1100, (255, 0, 0))]
    return view(spark, sf_dir, "cells").select("row", "col", raster.ramp(F.col("value"), stops).alias("c")).select("row", "col", "c.r", "c.a")


@register("tile_density", with_views("SELECT id, tile_x, tile_y FROM (SELECT id, sqft, CAST(floor((lon + 100e0) * 10) AS BIGINT) AS tile_x, CAST(floor(lat * 10) AS BIGINT) AS tile_y FROM points_a) QUALIFY row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY sqft DESC, id) <= 3", "points_a"))
def tile_density(spark, sf_dir):
    from voltspan.operators.relational import rows_per_cell

    rows = view(spark, sf_dir, "points_a").selectExpr("id", "sqft", "floor((lon + 100e0) * 10) AS tile_x", "floor(lat * 10) AS tile_y")
    return rows_per_cell(rows, ["tile_x", "tile_y"], [F.desc("sqft"), "id"], 3).drop("sqft")
