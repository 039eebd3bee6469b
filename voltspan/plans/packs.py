"""What extractors and release packs hold: sources and fields as data, geometries, legend filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltspan.functions import filters, geo
from voltspan.operators import extraction
from voltspan.plans.fixtures import view, with_views
from voltspan.plans.registry import register
from voltspan.tables import table

PLACES = (
    extraction.PointSource("terminal", "points_a", {"name": "'T' || id", "lon": "lon", "lat": "CASE WHEN id % 11 > 0 THEN lat END", "status": "kind"}),
    extraction.PointSource("storage", "points_b", {"name": "id", "lon": "lon", "lat": "lat"}, where="sqft <> 5000"),
    extraction.PointSource("hub", "points_b", {"name": "'H' || id", "lon": "lon + 1", "lat": "lat", "status": "'Active'"}),
)


@register(
    "point_sources",
    with_views(
        "SELECT 'terminal' AS fac_type, 'T' || id AS name, kind AS status, lon, lat FROM points_a WHERE id % 11 <> 0 UNION ALL SELECT 'storage', id::VARCHAR, NULL, lon, lat FROM points_b WHERE sqft <> 5000 UNION ALL SELECT 'hub', 'H' || id, 'Active', lon + 1, lat FROM points_b",
        "points_a",
        "points_b",
    ),
)
def point_sources(spark, sf_dir):
    tables = {n: view(spark, sf_dir, n) for n in ("points_a", "points_b")}
    return extraction.extract_points(tables, PLACES, {"name": "string", "status": "string", "lon": "double", "lat": "double"})


@register(
    "defined_fields",
    with_views("SELECT id, size::DOUBLE AS size, try_cast(split_part(voltage, ';', 1) AS BIGINT) AS volts, lower(brand) AS maker FROM tags WHERE size > 3", "tags"),
)
def defined_fields(spark, sf_dir):
    fields = [("size", F.col("size"), "double"), ("volts", F.split_part("voltage", F.lit(";"), F.lit(1)), "bigint"), ("maker", F.lower("brand"), "string")]
    return extraction.with_fields(view(spark, sf_dir, "tags"), fields, keep=["id"], hook=lambda df: df.where("size > 3"))


FAMILY = "CASE id % 7 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'MultiPolygon' WHEN 2 THEN 'MultiPolygon' WHEN 3 THEN 'LineString' WHEN 4 THEN 'MultiLineString' WHEN 5 THEN 'Point' END"


@register("dominant_family", with_views(f"SELECT id, kind FROM (SELECT id, {FAMILY} AS kind FROM tags) WHERE replace(kind, 'Multi', '') = (SELECT replace(kind, 'Multi', '') AS f FROM (SELECT {FAMILY} AS kind FROM tags) WHERE kind IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1)", "tags"))
def dominant_family(spark, sf_dir):
    return extraction.dominant_family(view(spark, sf_dir, "tags").selectExpr("id", f"{FAMILY} AS kind"), "kind")


def _around(*offsets: tuple[float, float]):
    return F.array(*(F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat")) for x, y in offsets))


#: A bowl whose right wall is thicker, and a square with a hole west of its middle; both closed.
BOWL = ((0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.5, 3.0), (2.5, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0), (0.0, 0.0))
SQUARE, HOLE = ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)), ((1.0, 1.0), (2.5, 1.0), (2.5, 2.5), (1.0, 2.5), (1.0, 1.0))


@register("representative_points", with_views("SELECT id, round(lon + CASE id % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 1e0 ELSE 3.25e0 END, 6) AS lon, round(lat + CASE id % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 2e0 WHEN 2 THEN 2e0 ELSE 1.75e0 END, 6) AS lat FROM points_a", "points_a"))
def representative_points(spark, sf_dir):
    nth = F.col("id") % 4
    kind = F.when(nth == 0, "Point").when(nth == 1, "LineString").otherwise("Polygon")
    points = F.when(nth == 0, _around((0.0, 0.0))).otherwise(_around((0.0, 0.0), (1.0, 2.0), (5.0, 5.0)))
    rings = F.when(nth == 2, F.array(_around(*BOWL))).otherwise(F.array(_around(*SQUARE), _around(*HOLE)))
    at = view(spark, sf_dir, "points_a").select("id", geo.representative_point(kind, points, rings).alias("p"))
    return at.select("id", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@register("rounded_coordinates", with_views("SELECT id, round(lon / 7e0, 5) AS x, round(lat / 7e0, 5) AS y FROM points_a", "points_a"))
def rounded_coordinates(spark, sf_dir):
    pair = F.array(F.col("lon") / 7.0, F.col("lat") / 7.0)
    ring = geo.rounded_nested(F.array(F.array(F.array(F.lit(0.0), F.lit(0.0)), pair)), 3, 5)
    return view(spark, sf_dir, "points_a").select("id", ring[0][1][0].alias("x"), ring[0][1][1].alias("y"))


@register("collected_coordinates", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE 0 END AS n, CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN event_id + 2 WHEN 2 THEN 2 * event_id + 2 WHEN 3 THEN event_id + 6 WHEN 4 THEN event_id + 3 ELSE 0 END::DOUBLE AS total FROM events")
def collected_coordinates(spark, sf_dir):
    shapes = [
        '{"type": "Point", "coordinates": [ID, 1]}',
        '{"type": "LineString", "coordinates": [[ID, 1], [2, 3]]}',
        '{"type": "Polygon", "coordinates": [[[ID, 0], [1, 0], [1, 1], [ID, 0]]]}',
        '{"type": "MultiPolygon", "coordinates": [[[[ID, 0], [1, 1]]], [[[2, 2], [3, 3]]]]}',
        '{"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [ID, 1]}, {"type": "GeometryCollection", "geometries": [{"type": "LineString", "coordinates": [[1, 1], [2, 2]]}]}]}',
        '{"type": "Circle"}',
    ]
    shape = F.replace(F.get(F.array(*map(F.lit, shapes)), (F.col("event_id") % 6).cast("int")), F.lit("ID"), F.col("event_id").cast("string"))
    points = table(spark, sf_dir, "events").select("event_id", geo.collected(F.try_parse_json(shape)).alias("c"))
    return points.select("event_id", F.size("c").alias("n"), F.aggregate("c", F.lit(0.0), lambda s, p: s + p[0]).alias("total"))


LEGENDS = (
    filters.LegendFilter("maker", "m", "brand", (("one", ("Brand#11", "Brand#12")), ("two", ("Brand#21",)), ("other", ()))),
    filters.LegendFilter("source", "s", "source", (("wind", ("WIND",)), ("water", ("water", "tidal")), ("store", ("storage",)), ("other", ())), first=("wind", "water")),
    filters.LegendFilter("sic", "k", "sic", (("gold", ("Gold Ore",)), ("other", ()))),
)


@register("legend_filters", with_views("SELECT id FROM tags WHERE coalesce(source IN ('WIND', 'water', 'tidal'), false) AND (brand = 'Brand#21' OR brand IS NULL OR brand NOT IN ('Brand#11', 'Brand#12', 'Brand#21'))", "tags"))
def legend_filters(spark, sf_dir):
    shown = filters.by_legend(LEGENDS, ("maker", "source", "sic"), {"maker": {"two", "other"}})
    return view(spark, sf_dir, "tags").where(shown).select("id")
