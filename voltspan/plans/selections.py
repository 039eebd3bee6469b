"""What is selected and shown: columns, layers and their modes, fuels, filter defaults, winners under a legend, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltspan.functions import filters, text
from voltspan.operators import layers, raster, relational
from voltspan.plans.fixtures import view, with_views
from voltspan.plans.registry import register
from voltspan.plans.relations import KEYED, RANK, keyed_alerts


@register("dropped_columns", with_views("SELECT id, lon, lat, sqft FROM points_a", "points_a"))
def dropped_columns(spark, sf_dir):
    return relational.drop_columns(view(spark, sf_dir, "points_a"), ["kind", "OBJECTID", "SQFT"])


@register("osm_links", with_views("SELECT id, CASE WHEN id % 5 = 0 THEN '' ELSE 'https://www.openstreetmap.org/way/' || replace(brand, '#', '%23') || '%20' || CAST(id AS STRING) END AS link FROM tags", "tags"))
def osm_links(spark, sf_dir):
    key = F.when(F.col("id") % 5 != 0, F.concat_ws(" ", "brand", "id"))
    return view(spark, sf_dir, "tags").select("id", text.osm_link("way", key).alias("link"))


AXIS = [0.3, 1.1, 0.7, 0.0, 1.5, 0.9]


@register(
    "nearest_index",
    with_views(f"WITH a AS (SELECT unnest({AXIS}) AS x, unnest(range({len(AXIS)})) AS i) SELECT id, arg_min(i, (abs(x - (lon + 100e0)), i))::INT AS i FROM points_a, a GROUP BY id".replace("arg_min(i, (abs(x - (lon + 100e0)), i))", "arg_min(i, {'d': abs(x - (lon + 100e0)), 'i': i})"), "points_a"),
)
def nearest_index(spark, sf_dir):
    return view(spark, sf_dir, "points_a").select("id", raster.nearest_index(F.col("lon") + 100.0, AXIS).alias("i"))


@register("filter_defaults", with_views("SELECT plant_code, generator_id FROM generators WHERE op_year <= 1995 AND (retirement_year IS NULL OR retirement_year <= 0 OR retirement_year > 1995)", "generators"))
def filter_defaults(spark, sf_dir):
    return view(spark, sf_dir, "generators").where(filters.by_defaults("nameplate_mw", "op_year", "retirement_year", year=1995, year_enabled=True)).select("plant_code", "generator_id")


ORDER = ["PROMO", "STANDARD", "ECONOMY", "SMALL"]


@register("draw_order", with_views("SELECT id, part, CASE part WHEN 'PROMO' THEN 0 WHEN 'STANDARD' THEN 1 WHEN 'ECONOMY' THEN 2 WHEN 'SMALL' THEN 3 ELSE 4 END AS z FROM (SELECT id, split_part(type, ' ', 1) AS part FROM tags) ORDER BY z, part", "tags"))
def draw_order(spark, sf_dir):
    parts = view(spark, sf_dir, "tags").select("id", F.split_part("type", F.lit(" "), F.lit(1)).alias("part"))
    return layers.drawn(parts, ORDER, "part").select("id", "part", "z")


SHOWN = (
    layers.ShownLayer("centres", ("circles", "heat", "clusters", "counts", "points", "heat-points"), "heat", (("icons", ("points",)), ("clusters", ("clusters", "counts", "circles")), ("heat", ("heat", "heat-points")))),
    layers.ShownLayer("plants", ("plants-heat", "plants-icons", "plants-labels"), "plants-heat"),
)


_MODES = """(VALUES ('centres', 'icons', 'points'), ('centres', 'clusters', 'circles,clusters,counts'), ('centres', 'heat', 'heat,heat-points'), ('centres', 'both', 'points'), ('centres', 'off', ''),
    ('plants', 'icons', 'plants-icons,plants-labels'), ('plants', 'clusters', 'plants-icons,plants-labels'), ('plants', 'heat', 'plants-heat'), ('plants', 'both', 'plants-heat,plants-icons,plants-labels'), ('plants', 'off', '')) AS t(layer, mode, parts)"""


@register("display_modes", with_views(f"SELECT id, layer, mode, parts FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'centres' WHEN id % 3 > 0 THEN 'plants' ELSE 'nowhere' END AS layer, CASE size % 5 WHEN 0 THEN 'icons' WHEN 1 THEN 'clusters' WHEN 2 THEN 'heat' WHEN 3 THEN 'both' ELSE 'off' END AS mode FROM tags) LEFT JOIN {_MODES} USING (layer, mode)", "tags"))
def display_modes(spark, sf_dir):
    """What each feature's layer draws in the mode that is chosen for it."""
    layer = F.when(F.col("id") % 2 == 0, "centres").when(F.col("id") % 3 > 0, "plants").otherwise("nowhere")
    mode = F.get(F.array(*map(F.lit, ("icons", "clusters", "heat", "both", "off"))), F.col("size") % 5)
    chosen = view(spark, sf_dir, "tags").select("id", layer.alias("layer"), mode.alias("mode"))
    return chosen.withColumn("parts", F.array_join(layers.shown(F.col("layer"), F.col("mode"), SHOWN, off="off"), ","))


@register("legend_winner", with_views(f"SELECT zone, id, severity, ends, count(*) OVER (PARTITION BY zone) > 1 AS multi FROM ({KEYED}) WHERE id % 4 IN (1, 3) QUALIFY row_number() OVER (PARTITION BY zone ORDER BY {RANK} DESC, ends ASC NULLS LAST, id) = 1", "alerts"))
def legend_winner(spark, sf_dir):
    grouped = keyed_alerts(spark, sf_dir).withColumn("group", F.concat(F.lit("g"), F.col("id") % 4))
    return relational.filtered_winners(grouped, ["g1", "g3"], "group", "zone", "severity", "ends", "id").drop("group")


@register("source_fuels", with_views("SELECT plant_code, generator_id, origin, CASE WHEN fuel IN ('wind', 'solar', 'hydro', 'gas', 'other') THEN fuel WHEN fuel IN ('storage', 'geo') THEN CASE WHEN origin = 'eia' THEN fuel WHEN fuel = 'geo' THEN 'geothermal' ELSE 'battery' END END AS bucket FROM (SELECT plant_code, generator_id, CASE part % 2 WHEN 0 THEN 'osm' ELSE 'eia' END AS origin, CASE energy_source WHEN 'WAT' THEN 'hydro' WHEN 'NG' THEN 'storage' WHEN 'SUN' THEN 'solar' WHEN 'WND' THEN 'geo' WHEN 'ZZZ' THEN 'other' ELSE 'unknown' END AS fuel FROM generators)", "generators"))
def source_fuels(spark, sf_dir):
    """Each generator's global fuel as the bucket that its source files it under; what is no fuel has none."""
    fuel = F.coalesce(F.create_map(*map(F.lit, ("WAT", "hydro", "NG", "storage", "SUN", "solar", "WND", "geo", "ZZZ", "other")))[F.col("energy_source")], F.lit("unknown"))
    origin = F.when(F.col("part") % 2 == 0, "osm").otherwise("eia")
    return view(spark, sf_dir, "generators").select("plant_code", "generator_id", origin.alias("origin"), filters.source_bucket(fuel, origin).alias("bucket"))


@register("clean_references", with_views(r"SELECT id, CASE WHEN regexp_full_match(ref, '[A-Za-z0-9-]{1,10}') THEN ref END AS ref FROM (SELECT id, CASE id % 4 WHEN 0 THEN brand WHEN 1 THEN 'IAD-' || CAST(id AS STRING) WHEN 2 THEN 'a' || chr(10) ELSE type END AS ref FROM tags)", "tags"))
def clean_references(spark, sf_dir):
    ref = F.when(F.col("id") % 4 == 0, F.col("brand")).when(F.col("id") % 4 == 1, F.concat(F.lit("IAD-"), "id")).when(F.col("id") % 4 == 2, F.lit("a\n")).otherwise(F.col("type"))
    return view(spark, sf_dir, "tags").select("id", text.clean_reference(ref).alias("ref"))


@register("no_pipelines", with_views("SELECT id FROM tags WHERE id % 4 = 0 OR id % 4 = 1 OR NOT (id % 4 = 2)", "tags"))
def no_pipelines(spark, sf_dir):
    man_made = F.when(F.col("id") % 4 == 1, F.lit("")).when(F.col("id") % 4 == 2, F.lit("pipeline")).when(F.col("id") % 4 == 3, F.lit("tower"))
    return view(spark, sf_dir, "tags").where(text.not_pipeline(man_made)).select("id")


@register("site_attributes", with_views("SELECT p.id, coalesce(a.kind, '') AS kind, coalesce(a.sector, 'unknown') AS sector FROM points_a AS p LEFT JOIN (SELECT size AS id, arg_max(brand, id) AS kind, CASE WHEN max(id) % 3 = 0 THEN NULL ELSE arg_max(type, id) END AS sector FROM tags GROUP BY size) AS a ON p.id = a.id", "points_a", "tags"))
def site_attributes(spark, sf_dir):
    attributes = view(spark, sf_dir, "tags").select(F.col("size").cast("long").alias("id"), F.col("id").alias("n"), F.col("brand").alias("kind"), F.when(F.col("id") % 3 != 0, F.col("type")).alias("sector"))
    return relational.last_attributes(view(spark, sf_dir, "points_a").select("id"), attributes, "id", "n", {"kind": "", "sector": "unknown"})


@register(
    "layers_of_facilities",
    with_views("SELECT id, 'node' AS osm_type, sqft FROM points_a WHERE id % 7 <> 0 UNION ALL SELECT id, 'way', sqft FROM points_b WHERE id % 5 <> 0", "points_a", "points_b"),
)
def layers_of_facilities(spark, sf_dir):
    a = view(spark, sf_dir, "points_a").withColumn("id", F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).otherwise("n/a"))
    b = view(spark, sf_dir, "points_b").withColumn("lon", F.when(F.col("id") % 5 != 0, F.col("lon")))
    return relational.union_layers({"node": a, "way": b}, "id", ["sqft"], "osm_type").select("id", "osm_type", "sqft")
