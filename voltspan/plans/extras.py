"""Queries of labels, zoom-dependent styles, map projections, clipping, timetables of feeds and checks of manifests."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voltspan.functions import geo, numeric, text, wkb
from voltspan.functions.shapes import hull
from voltspan.functions.style import compile_style
from voltspan.operators import feeds, layers, raster, relational, sites
from voltspan.plans.fixtures import view, with_views
from voltspan.plans.places import WORLD, lines, rings
from voltspan.plans.registry import register
from voltspan.tables import table


@register("feature_label", with_views("SELECT id, coalesce(nullif(trim(voltage), ''), nullif(trim(source), ''), brand) || CASE WHEN size > 25 THEN ' (' || size::VARCHAR || ' MW)' ELSE '' END AS label FROM tags", "tags"))
def feature_label(spark, sf_dir):
    suffix = F.when(F.col("size") > 25, F.concat(F.lit(" ("), F.col("size").cast("string"), F.lit(" MW)"))).otherwise("")
    return view(spark, sf_dir, "tags").select("id", F.concat(text.first_filled(*map(F.col, ("voltage", "source", "brand"))), suffix).alias("label"))


@register("merged_state", with_views("SELECT n_nationkey, coalesce(out, n_nationkey * 1000) AS out FROM nation LEFT JOIN (SELECT fips, CAST(sum(out) AS BIGINT) AS out FROM outages WHERE fips > '00012' GROUP BY fips) ON lpad(n_nationkey::VARCHAR, 5, '0') = fips", "outages"))
def merged_state(spark, sf_dir):
    state = view(spark, sf_dir, "outages").where("fips > '00012'").groupBy("fips").agg(F.sum("out").alias("out"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("fips"))
    return nations.join(state, "fips", "left").select("n_nationkey", F.coalesce("out", F.col("n_nationkey") * 1000).alias("out"))


@register("solar_exclusion", with_views("SELECT id FROM tags WHERE NOT (lower(trim(split_part(coalesce(source, ''), ';', 1))) = 'solar' OR size % 10 = 0)", "tags"))
def solar_exclusion(spark, sf_dir):
    solar = F.lower(F.trim(F.split_part(F.coalesce("source", F.lit("")), F.lit(";"), F.lit(1)))) == "solar"
    return view(spark, sf_dir, "tags").where(~(solar | (F.col("size") % 10 == 0))).select("id")


@register("voltage_tiers", with_views("SELECT CASE WHEN kv <= 0 THEN 'unknown' WHEN kv < 100 THEN 'low' WHEN kv < 300 THEN 'middle' ELSE 'high' END AS tier, count(*) AS n FROM (SELECT CASE WHEN id % 9 = 0 THEN -1 ELSE size * 13 END AS kv FROM tags) GROUP BY 1", "tags"))
def voltage_tiers(spark, sf_dir):
    kv = view(spark, sf_dir, "tags").selectExpr("CASE WHEN id % 9 = 0 THEN -1 ELSE size * 13 END AS kv")
    tier = ["case", ["<=", ["get", "kv"], 0], "unknown", ["step", ["get", "kv"], "low", 100, "middle", 300, "high"]]
    return kv.groupBy(compile_style(tier).alias("tier")).agg(F.count("*").alias("n"))


@register("zoom_labels", with_views("SELECT id FROM tags WHERE size * 13 >= 300", "tags"))
def zoom_labels(spark, sf_dir):
    shown = [">=", ["*", ["get", "size"], 13], ["step", ["zoom"], 500, 6, 300, 8, 100]]
    return view(spark, sf_dir, "tags").where(compile_style(shown, zoom=7.0)).select("id")


@register("zoom_radius", with_views("SELECT id, lo + (hi - lo) * 0.5e0 AS radius FROM (SELECT id, CASE WHEN size < 20 THEN 1 WHEN size < 40 THEN 2 ELSE 4 END AS lo, CASE WHEN size < 20 THEN 3 WHEN size < 40 THEN 6 ELSE 12 END AS hi FROM tags)", "tags"))
def zoom_radius(spark, sf_dir):
    by_size = lambda a, b, c: ["step", ["get", "size"], a, 20, b, 40, c]
    radius = ["interpolate", ["linear"], ["zoom"], 4, by_size(1, 2, 4), 10, by_size(3, 6, 12)]
    return view(spark, sf_dir, "tags").select("id", compile_style(radius, zoom=7.0).alias("radius"))


@register("zoom_text", with_views("SELECT id, brand || ' ' || size::VARCHAR || ' MW' AS label FROM tags", "tags"))
def zoom_text(spark, sf_dir):
    label = ["step", ["zoom"], "", 6, ["get", "brand"], 9, ["concat", ["get", "brand"], " ", ["round", ["get", "size"]], " MW"]]
    return view(spark, sf_dir, "tags").select("id", compile_style(label, zoom=9.5).alias("label"))


@register("scaled_opacity", with_views("SELECT id, CASE WHEN type = 'ECONOMY' THEN 0.2e0 WHEN type = 'PROMO' THEN 0.4e0 ELSE 0.6e0 END * 0.5e0 AS opacity FROM tags", "tags"))
def scaled_opacity(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", compile_style(["*", ["match", ["get", "type"], "ECONOMY", 0.2, "PROMO", 0.4, 0.6], 0.5]).alias("opacity"))


@register("incident_style", with_views("SELECT id, CASE WHEN size * 3 >= 100 THEN 'out' WHEN size * 3 >= 90 THEN 'nearly' ELSE 'active' END AS icon, CASE WHEN price >= 1000 THEN 3 WHEN price >= 950 THEN 2 ELSE 1 END AS step FROM tags", "tags"))
def incident_style(spark, sf_dir):
    icon = ["step", ["*", ["get", "size"], 3], "active", 90, "nearly", 100, "out"]
    return view(spark, sf_dir, "tags").select("id", compile_style(icon).alias("icon"), compile_style(["step", ["get", "price"], 1, 950, 2, 1000, 3]).alias("step"))


@register("code_classes", with_views("SELECT id, CASE WHEN type IN ('ECONOMY', 'PROMO') THEN 'State' ELSE 'Federal' END AS recognised, CASE WHEN brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'active' ELSE 'retired' END AS mine, CASE size % 3 WHEN 0 THEN 'Severe' WHEN 1 THEN 'Moderate' ELSE 'Unknown' END AS severity FROM tags", "tags"))
def code_classes(spark, sf_dir):
    kind = ["match", ["get", "type"], ["ECONOMY", "PROMO"], "State", "Federal"]
    mine = ["match", ["get", "brand"], ["Brand#1", "Brand#2", "Brand#3"], "active", "retired"]
    severity = F.when(F.col("size") % 3 == 0, "Severe").when(F.col("size") % 3 == 1, "Moderate").otherwise("Unknown")
    return view(spark, sf_dir, "tags").select("id", compile_style(kind).alias("recognised"), compile_style(mine).alias("mine"), severity.alias("severity"))


@register("mine_icons", with_views("SELECT id, CASE WHEN size * 30 >= 1000 THEN 3 WHEN size * 30 >= 300 THEN 2 ELSE 1 END AS icon_size, CASE WHEN type = 'PROMO' THEN 0 ELSE 1 END AS draw_order FROM tags ORDER BY draw_order, id", "tags"))
def mine_icons(spark, sf_dir):
    icons = view(spark, sf_dir, "tags").select("id", compile_style(["step", ["*", ["get", "size"], 30], 1, 300, 2, 1000, 3]).alias("icon_size"), compile_style(["match", ["get", "type"], "PROMO", 0, 1]).alias("draw_order"))
    return icons.orderBy("draw_order", "id")


@register("corridors", with_views("SELECT coalesce(CASE id % 3 WHEN 1 THEN true WHEN 2 THEN false END, false) AS corridor, count(*) AS n FROM tags GROUP BY 1", "tags"))
def corridors(spark, sf_dir):
    flag = F.when(F.col("id") % 3 == 1, F.lit(True)).when(F.col("id") % 3 == 2, F.lit(False))
    return view(spark, sf_dir, "tags").groupBy(F.coalesce(flag, F.lit(False)).alias("corridor")).agg(F.count("*").alias("n"))


@register("drawn_colour", with_views("SELECT id, coalesce(nullif(trim(voltage), ''), nullif(trim(source), ''), '#3388ff') AS colour FROM tags", "tags"))
def drawn_colour(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", F.coalesce(text.first_filled(F.col("voltage"), F.col("source")), F.lit("#3388ff")).alias("colour"))


@register("hazard_class", with_views("SELECT row, col, CASE CAST(floor(value / 100) AS INT) WHEN 9 THEN 'low' WHEN 10 THEN 'moderate' WHEN 11 THEN 'high' ELSE 'none' END AS class FROM cells", "cells"))
def hazard_class(spark, sf_dir):
    kinds = ["match", ["floor", ["/", ["get", "value"], 100]], 9, "low", 10, "moderate", 11, "high", "none"]
    return view(spark, sf_dir, "cells").select("row", "col", compile_style(kinds).alias("class"))


@register("raster_pyramid", with_views(" UNION ALL ".join(f"SELECT {k} AS level, CAST(floor(row / {k}e0) AS BIGINT) AS row, CAST(floor(col / {k}e0) AS BIGINT) AS col, round(avg(value), 6) AS value FROM cells WHERE value IS NOT NULL GROUP BY 1, 2, 3" for k in (2, 4, 8)), "cells"))
def raster_pyramid(spark, sf_dir):
    levels = {k: raster.averaged(view(spark, sf_dir, "cells"), k).select(F.lit(k).alias("level"), "row", "col", F.round("value", 6).alias("value")) for k in (2, 4, 8)}
    return levels[2].unionByName(levels[4]).unionByName(levels[8])


@register("rescaled_bytes", with_views("SELECT id, CAST(round_even(least(255e0, greatest(0e0, (price - 900e0) / 200e0 * 255e0)), 0) AS INT) AS byte FROM tags", "tags"))
def rescaled_bytes(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", numeric.rescaled(F.col("price"), 900, 1100, 255).cast("int").alias("byte"))


@register("rated_capacity", with_views("SELECT id, greatest(coalesce(out, 0), coalesce(CASE WHEN id % 5 > 0 THEN id % 700 END, 0)) AS mw FROM outages", "outages"))
def rated_capacity(spark, sf_dir):
    back = F.when(F.col("id") % 5 > 0, F.col("id") % 700)
    return view(spark, sf_dir, "outages").select("id", F.greatest(F.coalesce("out", F.lit(0)), F.coalesce(back, F.lit(0))).alias("mw"))


@register("acquired_at", "SELECT event_id, CASE WHEN event_id % 11 > 0 THEN date_trunc('minute', ts) END AS at FROM events")
def acquired_at(spark, sf_dir):
    hhmm = F.when(F.col("event_id") % 11 == 0, "noon").otherwise((F.hour("ts") * 100 + F.minute("ts")).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", numeric.date_and_hhmm(F.date_format("ts", "yyyy-MM-dd"), hhmm).cast("timestamp_ntz").alias("at"))


@register("junk_dates", "SELECT event_id, make_timestamp((1700000000000 + event_id * 60000) * 1000) AS validated, NULL::TIMESTAMP AS junk FROM events")
def junk_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.lit(1700000000000) + F.col("event_id") * 60000).alias("validated"), F.col("event_id").alias("junk"))
    return relational.real_dates(rows, ["validated", "junk"]).select("event_id", F.col("validated").cast("timestamp_ntz").alias("validated"), F.col("junk").cast("timestamp_ntz").alias("junk"))


@register("feed_issues", "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'down ' || (event_id % 50)::VARCHAR || 'h' WHEN 2 THEN 'data ' || (event_id % 9)::VARCHAR || 'd old' WHEN 3 THEN 'degraded' END AS issue FROM events")
def feed_issues(spark, sf_dir):
    days = F.concat(F.lit("fallback-"), (F.col("event_id") % 9).cast("string"), F.lit("d"))
    status = F.when(F.col("event_id") % 4 == 0, "ok").when(F.col("event_id") % 4 == 1, "failed").when(F.col("event_id") % 4 == 2, days).otherwise("degraded")
    return table(spark, sf_dir, "events").select("event_id", feeds.issue(status, F.col("event_id") % 50).alias("issue"))


@register("card_times", "SELECT event_id, CASE WHEN m < 0 THEN '(' || floor(-m / 60e0 + 0.5e0)::BIGINT::VARCHAR || 'h ago)' ELSE '(in ' || floor(m / 60e0 + 0.5e0)::BIGINT::VARCHAR || 'h)' END AS said FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 10 - 300 AS m FROM events)")
def card_times(spark, sf_dir):
    m = F.get_json_object("props", "$.k").cast("long") * 10 - 300
    hours = F.floor(F.abs(m) / 60 + F.lit(0.5)).cast("string")
    return table(spark, sf_dir, "events").select("event_id", F.when(m < 0, F.concat(F.lit("("), hours, F.lit("h ago)"))).otherwise(F.concat(F.lit("(in "), hours, F.lit("h)"))).alias("said"))


@register("model_cycles", "SELECT event_id, to_timestamp(floor(epoch(ts) / 21600) * 21600 - 21600 * i)::TIMESTAMP AS cycle FROM events, range(0, 4) AS r(i)")
def model_cycles(spark, sf_dir):
    """The cycle that each event falls in, and the three before it."""
    found = table(spark, sf_dir, "events").select("event_id", F.explode(numeric.cycles(F.col("ts").cast("timestamp"), 3)).alias("cycle"))
    return found.select("event_id", F.col("cycle").cast("timestamp_ntz").alias("cycle"))


@register("path_elements", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS n FROM events")
def path_elements(spark, sf_dir):
    listed = F.when(F.col("event_id") % 3 == 0, '["a", "b", "c"]').when(F.col("event_id") % 3 == 1, "[7]").otherwise("not a list")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.size(F.try_variant_get(F.try_parse_json(listed), "$", "array<variant>")), F.lit(0)).alias("n"))


@register("sorted_map", with_views("SELECT fips, string_agg(utility || '=' || out::VARCHAR, ';' ORDER BY utility) AS parts FROM (SELECT fips, utility, CAST(sum(coalesce(out, 0)) AS BIGINT) AS out FROM outages GROUP BY ALL) GROUP BY fips", "outages"))
def sorted_map(spark, sf_dir):
    each = view(spark, sf_dir, "outages").groupBy("fips", "utility").agg(F.sum(F.coalesce("out", F.lit(0))).alias("out"))
    entries = F.array_sort(F.map_entries(F.map_from_entries(F.collect_list(F.struct("utility", "out")))))
    return each.groupBy("fips").agg(F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("parts"))


@register("same_bucket_sets", with_views("SELECT id, list_sort(list_distinct(string_split(CASE id % 3 WHEN 0 THEN 'PROMO;ECONOMY;PROMO' WHEN 1 THEN 'ECONOMY' ELSE '' END, ';'))) = ['ECONOMY', 'PROMO'] AS same FROM tags", "tags"))
def same_bucket_sets(spark, sf_dir):
    active = F.split(F.when(F.col("id") % 3 == 0, "PROMO;ECONOMY;PROMO").when(F.col("id") % 3 == 1, "ECONOMY").otherwise(""), ";")
    return view(spark, sf_dir, "tags").select("id", (F.array_sort(F.array_distinct(active)) == F.array(F.lit("ECONOMY"), F.lit("PROMO"))).alias("same"))


@register("safe_links", r"SELECT page_id, CASE WHEN NOT starts_with(lower(u), 'javascript:') THEN replace(replace(replace(replace(u, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '""', '&quot;') END AS link FROM (SELECT page_id, regexp_replace(CASE WHEN page_id % 4 = 0 THEN 'java' || chr(9) || 'Script:x' ELSE url || '?a=1&b=2' END, '[\x00-\x20]', '', 'g') AS u FROM pages)".replace('""', '"'))
def safe_links(spark, sf_dir):
    url = F.when(F.col("page_id") % 4 == 0, "java\tScript:x").otherwise(F.concat("url", F.lit("?a=1&b=2")))
    return table(spark, sf_dir, "pages").select("page_id", text.safe_link(url).alias("link"))


@register("kml_colours", with_views("SELECT id, '80' || h[5:6] || h[3:4] || h[1:2] AS colour FROM (SELECT id, lower(lpad(to_hex(id * 7919 % 16777216), 6, '0')) AS h FROM tags)", "tags"))
def kml_colours(spark, sf_dir):
    rgb = F.concat(F.lit("#"), F.lpad(F.hex(F.col("id") * 7919 % 16777216), 6, "0"))
    return view(spark, sf_dir, "tags").select("id", text.kml_colour(rgb, 0.5).alias("colour"))


@register("revised_status", with_views(r"SELECT id, trim(regexp_replace(s, '\s*\(revised [0-9-]+\)', '')) AS status, nullif(regexp_extract(s, '\(revised ([0-9-]+)\)', 1), '') AS revised FROM (SELECT id, type || CASE WHEN id % 2 = 0 THEN ' (revised 2024-0' || (size % 9 + 1)::VARCHAR || '-15)' ELSE '' END AS s FROM tags)", "tags"))
def revised_status(spark, sf_dir):
    s = F.concat("type", F.when(F.col("id") % 2 == 0, F.concat(F.lit(" (revised 2024-0"), (F.col("size") % 9 + 1).cast("string"), F.lit("-15)"))).otherwise(""))
    return view(spark, sf_dir, "tags").select("id", F.trim(F.regexp_replace(s, r"\s*\(revised [0-9-]+\)", "")).alias("status"), F.nullif(F.regexp_extract(s, r"\(revised ([0-9-]+)\)", 1), F.lit("")).alias("revised"))


@register("geometry_counts", with_views("SELECT count(b.id) AS kept, count(*) - count(b.id) AS skipped FROM points_a AS a LEFT JOIN (SELECT id FROM points_b WHERE id % 4 > 0) AS b ON a.id = b.id", "points_a", "points_b"))
def geometry_counts(spark, sf_dir):
    shapes = view(spark, sf_dir, "points_b").where("id % 4 > 0").select("id", F.lit(1).alias("there"))
    return view(spark, sf_dir, "points_a").join(shapes, "id", "left").agg(F.count("there").alias("kept"), F.count_if(F.col("there").isNull()).alias("skipped"))


@register("path_lines", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 12 = 7)")
def path_lines(spark, sf_dir):
    chosen = table(spark, sf_dir, "nation").where("n_nationkey % 12 = 7").selectExpr("n_nationkey AS c_nationkey")
    return table(spark, sf_dir, "customer").join(chosen, "c_nationkey", "left_semi").select("c_custkey")


@register("manifest_check", "SELECT coalesce(e.name, p.name) AS name, CASE WHEN p.name IS NULL THEN 'WARN' WHEN e.name IS NULL THEN 'FAIL' ELSE 'PASS' END AS level FROM (VALUES ('click'), ('error'), ('refund')) AS e(name) FULL JOIN (SELECT DISTINCT event_type AS name FROM events) AS p ON e.name = p.name")
def manifest_check(spark, sf_dir):
    expected = spark.createDataFrame([("click",), ("error",), ("refund",)], "name string")
    return relational.cross_check(expected, table(spark, sf_dir, "events").selectExpr("event_type AS name"), "name")


def half_even(thousandths: str) -> str:
    """Whole thousandths to hundredths, ties to even, in whole numbers: a double has no exact tie."""
    t = f"({thousandths} + 1000000)"  # above zero
    return f"(({t} // 10 + CASE WHEN {t} % 10 > 5 OR ({t} % 10 = 5 AND {t} // 10 % 2 = 1) THEN 1 ELSE 0 END - 100000) / 1e2)"


@register("layer_build", f"SELECT c_custkey AS id, c_mktsegment AS kind, {half_even('(c_custkey * 7919) % 2000 - 100000')} AS lon, {half_even('(c_custkey * 104729) % 1000 + 40000')} AS lat FROM customer WHERE c_custkey % 300 > 100")
def layer_build(spark, sf_dir):
    spec = layers.LayerSpec("places", select=("id", "kind", "not_there"), where="sqft > 100", precision=2)
    return layers.build(view(spark, sf_dir, "points_a"), spec)


MX = f"{geo.MERCATOR / 180!r}"


def merc_y(lat: str) -> str:
    return f"(ln(tan({math.pi / 4!r} + ({lat}) * {math.pi / 360!r})) * {geo.R_AREA!r})"


def back_lat(y: str) -> str:
    return f"((2e0 * atan(exp(({y}) / {geo.R_AREA!r})) - {math.pi / 2!r}) * {180 / math.pi!r})"


@register("mercator_metres", with_views(f"SELECT id, round(lon * {MX}, 3) AS x, round({merc_y('lat')}, 3) AS y, round({back_lat(merc_y('lat'))}, 8) AS back FROM points_a", "points_a"))
def mercator_metres(spark, sf_dir):
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    return view(spark, sf_dir, "points_a").select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(geo.from_mercator(x, y)[1], 8).alias("back"))


@register(
    "projected_centroid",
    with_views(
        f"""WITH p AS (SELECT id, lon * {MX} AS x0, {merc_y('lat')} AS y0, (lon + 0.01e0) * {MX} AS x1, {merc_y('lat + 0.02e0')} AS y1, (lon + 0.03e0) * {MX} AS x2, {merc_y('lat - 0.01e0')} AS y2 FROM points_a),
        q AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS l0, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS l1 FROM p)
        SELECT id, round((l0 * (x0 + x1) / 2 + l1 * (x1 + x2) / 2) / (l0 + l1) / {MX}, 6) AS lon, round({back_lat('(l0 * (y0 + y1) / 2 + l1 * (y1 + y2) / 2) / (l0 + l1)')}, 6) AS lat FROM q""",
        "points_a",
    ),
)
def projected_centroid(spark, sf_dir):
    return lines(spark, sf_dir).select("id", geo.projected_centroid(F.col("line")).alias("c")).select("id", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


def albers_q(lat: str) -> str:
    s, e = f"sin(({lat}) * {math.pi / 180!r})", geo.ALBERS_E
    return f"({1 - e * e!r} * ({s} / (1 - {e * e!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r}))"


@register(
    "albers_miles",
    with_views(
        f"""WITH p AS (SELECT id, i, lon + [0e0, 0.01e0, 0.03e0][i] AS lon, lat + [0e0, 0.02e0, -0.01e0][i] AS lat FROM points_a, (VALUES (1), (2), (3)) AS v(i)),
        r AS (SELECT id, i, {geo.R_AREA!r} * sqrt({geo.ALBERS_C!r} - {geo.ALBERS_N!r} * {albers_q('lat')}) / {geo.ALBERS_N!r} AS rho, {geo.ALBERS_N!r} * (lon - {geo.ALBERS_LON!r}) * {math.pi / 180!r} AS theta FROM p),
        c AS (SELECT id, i, rho * sin(theta) AS x, {geo.ALBERS_RHO0!r} - rho * cos(theta) AS y FROM r)
        SELECT a.id, round(sum(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))) / 1609.34e0, 4) AS miles FROM c AS a JOIN c AS b ON a.id = b.id AND b.i = a.i + 1 GROUP BY a.id""",
        "points_a",
    ),
)
def albers_miles(spark, sf_dir):
    return lines(spark, sf_dir).select("id", F.round(geo.albers_length(F.col("line")) / F.lit(1609.34), 4).alias("miles"))


BOX = (-99.5, 40.2, -98.9, 40.6)


@register(
    "clipped_lines",
    with_views(
        f"""WITH s AS (SELECT id, 0 AS part, lon AS x0, lat AS y0, lon + 0.01e0 AS x1, lat + 0.02e0 AS y1 FROM points_a UNION ALL SELECT id, 1, lon + 0.01e0, lat + 0.02e0, lon + 0.03e0, lat - 0.01e0 FROM points_a),
        d AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM s),
        t AS (SELECT *, greatest(0e0, ({BOX[0]}e0 - x0) / dx, CASE WHEN dy > 0 THEN ({BOX[1]}e0 - y0) / dy ELSE ({BOX[3]}e0 - y0) / dy END) AS t0, least(1e0, ({BOX[2]}e0 - x0) / dx, CASE WHEN dy > 0 THEN ({BOX[3]}e0 - y0) / dy ELSE ({BOX[1]}e0 - y0) / dy END) AS t1 FROM d)
        SELECT id, part, round(x0 + t0 * dx, 7) AS from_lon, round(y0 + t0 * dy, 7) AS from_lat, round(x0 + t1 * dx, 7) AS to_lon, round(y0 + t1 * dy, 7) AS to_lat FROM t WHERE t0 < t1""",
        "points_a",
    ),
)
def clipped_lines(spark, sf_dir):
    sides = lines(spark, sf_dir).select("id", F.posexplode(geo.segments(F.col("line"))).alias("part", "s"))
    clipped = sides.select("id", "part", geo.clipped_segment(F.col("s"), BOX).alias("c")).where("c IS NOT NULL")
    return clipped.select("id", "part", *(F.round(f"c.{n}", 7).alias(n) for n in ("from_lon", "from_lat", "to_lon", "to_lat")))


@register("ring_problems", with_views("SELECT id, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'open' ELSE 'short' END AS problem FROM points_a", "points_a"))
def ring_problems(spark, sf_dir):
    ring = F.col("ring")
    some = F.when(F.col("id") % 3 == 0, ring).when(F.col("id") % 3 == 1, F.slice(ring, 1, 4)).otherwise(F.slice(ring, 1, 3))
    return rings(spark, sf_dir).select("id", geo.ring_problem(some).alias("problem"))


@register("smoke_shapes", with_views("SELECT id, CASE WHEN id % 2 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS polygons FROM points_a", "points_a"))
def smoke_shapes(spark, sf_dir):
    listed = F.when(F.col("id") % 2 == 0, F.array("ring", "ring")).otherwise(F.array("ring"))
    return rings(spark, sf_dir).select("id", geo.as_polygons(listed).alias("g")).select("id", "g.kind", F.size("g.polygons").alias("polygons"))


@register(
    "click_hits",
    with_views(
        f"""WITH p AS (SELECT id, (lon * {MX} + {geo.MERCATOR!r}) * {WORLD} AS x, ({geo.MERCATOR!r} - {merc_y('lat')}) * {WORLD} AS y FROM points_a),
        c AS (SELECT (-99e0 * {MX} + {geo.MERCATOR!r}) * {WORLD} AS cx, ({geo.MERCATOR!r} - {merc_y('40.5e0')}) * {WORLD} AS cy) SELECT id FROM p, c WHERE abs(x - cx) <= 80 AND abs(y - cy) <= 80""",
        "points_a",
    ),
)
def click_hits(spark, sf_dir):
    return view(spark, sf_dir, "points_a").where(geo.near_click(F.col("lon"), F.col("lat"), -99.0, 40.5, 9, 80)).select("id")


@register("wkt_lines", with_views("SELECT id, 'LINESTRING (' || round_even(lon + 0e0, 3)::VARCHAR || ' ' || round_even(lat + 0e0, 3)::VARCHAR || ', ' || round_even(lon + 0.01e0, 3)::VARCHAR || ' ' || round_even(lat + 0.02e0, 3)::VARCHAR || ', ' || round_even(lon + 0.03e0, 3)::VARCHAR || ' ' || round_even(lat - 0.01e0, 3)::VARCHAR || ')' AS wkt FROM points_a", "points_a"))
def wkt_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("id", geo.wkt_line(F.col("line"), 3).alias("wkt"))


@register("simplified_lines")
def simplified_lines(spark, sf_dir):
    from voltspan.functions.shapes import simplify

    return lines(spark, sf_dir).select("id", simplify(0.005)(F.col("line")).alias("line"))


@register("hulls")
def hulls(spark, sf_dir):
    """Rings around the points of a kind in strips of a fifth of a degree."""
    points = view(spark, sf_dir, "points_a").select("kind", F.floor(F.col("lon") * 5).alias("cell"), F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y"))
    found = sites.convex_corners(points, ["kind", "cell"], [F.floor(F.col("y") * 50)])
    return found.select("kind", "cell", hull(F.transform("points", lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat")))).alias("ring"))


@register(
    "hull_corners",
    """WITH p AS (SELECT DISTINCT c_mktsegment AS kind, CAST(floor((c_custkey * 7919) % 2000 / 200e0) AS BIGINT) AS cell, (c_custkey * 7919) % 2000 AS x, (c_custkey * 104729) % 1000 AS y FROM customer),
    turns AS (SELECT a.kind, a.cell, a.x, a.y, atan2(b.y - a.y, b.x - a.x) AS t FROM p a JOIN p b ON a.kind = b.kind AND a.cell = b.cell AND (a.x <> b.x OR a.y <> b.y)),
    gaps AS (SELECT kind, cell, x, y, coalesce(lead(t) OVER w, min(t) OVER (PARTITION BY kind, cell, x, y) + 2 * pi()) - t AS gap FROM turns WINDOW w AS (PARTITION BY kind, cell, x, y ORDER BY t))
    SELECT kind, cell, x * 1e0 AS x, y * 1e0 AS y FROM gaps GROUP BY ALL HAVING max(gap) > pi() + 1e-9
    UNION ALL SELECT kind, cell, x * 1e0, y * 1e0 FROM p QUALIFY count(*) OVER (PARTITION BY kind, cell) = 1""",
)
def hull_corners(spark, sf_dir):
    """The corners of the hulls of a kind's points in strips, merged from those of squares."""
    points = table(spark, sf_dir, "customer").selectExpr("c_mktsegment AS kind", "CAST(floor((c_custkey * 7919) % 2000 / 200e0) AS BIGINT) AS cell", "(c_custkey * 7919) % 2000 * 1e0 AS x", "(c_custkey * 104729) % 1000 * 1e0 AS y")
    found = sites.convex_corners(points, ["kind", "cell"], [F.floor(F.col("y") / 100)])
    return found.select("kind", "cell", F.inline("points"))


@register("dissolved", with_views("SELECT kind, count(*) OVER (PARTITION BY kind) AS parts, (SELECT arg_min(sqft, id) FROM points_a b WHERE b.kind = a.kind) AS first_sqft, west, south FROM (SELECT DISTINCT kind, round(lon + 0e0, 6) AS west, round(lat + 0e0, 6) AS south FROM points_a) a", "points_a"))
def dissolved(spark, sf_dir):
    """The polygons of each kind united, each once, in shares of at most some hundred; where each part lies."""
    shapes = rings(spark, sf_dir).select("id", "kind", "sqft", wkb.geometry("Polygon", F.array("ring")).alias("geometry"))
    united = sites.dissolve(shapes, "kind", "geometry", "id", ["sqft"], most=100)
    whole = united.groupBy("kind").agg(F.sum("members").alias("parts"))
    low = lambda axis: F.round(F.array_min(F.transform(F.col("m.parts")[0], lambda p: p[axis])), 6)
    return united.select("kind", "sqft", F.explode("geometry.members").alias("m")).join(whole, "kind").select("kind", "parts", F.col("sqft").alias("first_sqft"), low("lon").alias("west"), low("lat").alias("south"))
