"""Queries over files of the formats that the data come in, written from the test tables and read back."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voltspan.functions import geo, wkb
from voltspan.operators import sites
from voltspan.plans.fixtures import view, with_views
from voltspan.plans.places import rings
from voltspan.plans.registry import register
from voltspan.sources.geoparquet import read_geoparquet, write_geoparquet
from voltspan.sources.kml import read_kml, write_kml
from voltspan.sources.shapefile import read_shapefiles, write_shapefiles
from voltspan.tables import scratch


@register("shapefile_points", with_views("SELECT CAST(id AS VARCHAR) AS id, kind, lon + 0e0 AS lon, lat + 0e0 AS lat FROM points_a", "points_a"))
def shapefile_points(spark, sf_dir):
    """Points through shapefiles of several parts, each read by several tasks."""
    points = view(spark, sf_dir, "points_a").withColumn("parts", F.array(F.array(F.struct(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")))))
    write_shapefiles(points.repartition(3, "id"), folder := scratch(spark), "Point", ["id", "kind"])
    back = read_shapefiles(spark, folder, records=50)
    return back.select(F.col("attributes")["id"].alias("id"), F.col("attributes")["kind"].alias("kind"), F.col("parts")[0][0]["lon"].alias("lon"), F.col("parts")[0][0]["lat"].alias("lat"))


@register("shapefile_polygons", with_views("SELECT CAST(id AS VARCHAR) AS id, 5 AS points, round(lon + 0.01e0, 6) AS east, round(lat + 0.02e0, 6) AS north FROM points_a", "points_a"))
def shapefile_polygons(spark, sf_dir):
    """Polygons through a shapefile; only one of two attributes is read."""
    write_shapefiles(rings(spark, sf_dir).withColumn("parts", F.array("ring")).repartition(2, "id"), folder := scratch(spark), "Polygon", ["kind", "id"])
    back = read_shapefiles(spark, folder, records=40, columns=["id"])
    corner = lambda axis: F.round(F.array_max(F.transform(F.col("parts")[0], lambda p: p[axis])), 6)
    return back.select(F.col("attributes")["id"].alias("id"), F.size(F.col("parts")[0]).alias("points"), corner("lon").alias("east"), corner("lat").alias("north"))


_SITE = "CASE WHEN id % 10 = 0 THEN 'one ' || CAST(id AS STRING) WHEN id % 10 < 3 THEN 'two ' || CAST(CAST(floor(id / 10e0) AS BIGINT) AS STRING) ELSE 'many ' || CAST(id % 23 AS STRING) END"
_METRE = f"{geo.MERCATOR / 180!r}"


@register(
    "site_shapes",
    with_views(
        f"""WITH sites AS (SELECT {_SITE} AS site, lon * {_METRE} AS x, ln(tan({math.pi / 4!r} + lat * {math.pi / 360!r})) * {geo.R_AREA!r} AS y FROM points_a)
        SELECT site, count(*) AS members, count(*) AS inside, CASE count(*) WHEN 1 THEN round(32 * 25e4 * sin({math.pi / 32!r}), 0) WHEN 2 THEN round(32 * 1e4 * sin({math.pi / 32!r}) + 200 * sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)), 0) END AS square_metres
        FROM sites GROUP BY site""",
        "points_a",
    ),
)
def site_shapes(spark, sf_dir):
    """Outlines of sites of one, two and many members: how many members are inside, and the area of the simple ones."""
    members = view(spark, sf_dir, "points_a").withColumn("site", F.expr(_SITE))
    shapes = sites.site_shapes(members, "site")
    inside = members.join(shapes.hint("merge"), "site").groupBy("site").agg(F.count_if(geo.in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).alias("inside"))
    flat = F.transform("ring", lambda p: F.struct(*(c.alias(n) for c, n in zip(geo.mercator(p["lon"], p["lat"]), ("x", "y"), strict=True))))
    first = F.get(F.col("flat"), F.lit(0))
    terms = F.zip_with(F.col("flat"), F.slice(F.col("flat"), F.lit(2), F.size("flat")), lambda a, b: F.coalesce((a["x"] - first["x"]) * (b["y"] - first["y"]) - (b["x"] - first["x"]) * (a["y"] - first["y"]), F.lit(0.0)))
    area = F.abs(F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)) / 2
    return shapes.withColumn("flat", flat).join(inside.hint("merge"), "site").select("site", "members", "inside", F.when(F.col("members") < 3, F.round(area, 0)).alias("square_metres"))


@register("geoparquet_box", with_views("SELECT id, kind, 'Polygon' AS shape, 5 AS points, round(lon + 0.01e0, 6) AS east FROM points_a WHERE lon <= -98.9e0 AND lon + 0.01e0 >= -99.3e0 AND lat <= 40.6e0 AND lat + 0.02e0 >= 40.2e0", "points_a"))
def geoparquet_box(spark, sf_dir):
    """Polygons through GeoParquet; a box is read."""
    shapes = rings(spark, sf_dir).select("id", "kind", wkb.geometry("Polygon", F.array("ring")).alias("geometry"), "lon")
    write_geoparquet(shapes.repartitionByRange(4, "lon").sortWithinPartitions("lon").drop("lon"), folder := scratch(spark))
    found = read_geoparquet(spark, folder, (-99.3, 40.2, -98.9, 40.6))
    points = wkb.points_of(F.col("geometry"))
    return found.select("id", "kind", F.col("geometry.kind").alias("shape"), F.size(points).alias("points"), F.round(F.array_max(F.transform(points, lambda p: p["lon"])), 6).alias("east"))


@register("kmz_polygons", with_views("SELECT CAST(id AS VARCHAR) AS id, kind AS folder, kind || ' <' || id::VARCHAR || '> & co' AS name, CASE WHEN id % 2 = 0 THEN '#ff8000' ELSE '#0080ff' END AS fill, 0.5e0 AS opacity, round(lon + 0.01e0, 6) AS east FROM points_a", "points_a"))
def kmz_polygons(spark, sf_dir):
    """Polygons in folders, with names, styles and attributes, through zipped KML."""
    fill = F.when(F.col("id") % 2 == 0, "#ff8000").otherwise("#0080ff")
    rows = rings(spark, sf_dir).select("id", "kind", F.concat("kind", F.lit(" <"), F.col("id").cast("string"), F.lit("> & co")).alias("name"), fill.alias("fill"), F.lit(0.5).alias("fill_opacity"), wkb.geometry("Polygon", F.array("ring")).alias("geometry"))
    write_kml(rows.repartition(3, "id"), folder := scratch(spark), ["id"], folder="kind", zipped=True)
    east = F.round(F.array_max(F.transform(wkb.points_of(F.col("geometry")), lambda p: p["lon"])), 6)
    return read_kml(spark, folder).select(F.col("attributes")["id"].alias("id"), F.array_join("folders", "/").alias("folder"), "name", "fill", F.col("fill_opacity").alias("opacity"), east.alias("east"))
