"""Queries of the smaller operators: tag filters, backfills, flags, lookups in time, members, colours, labels, JSON, statuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltspan.functions import numeric, text
from voltspan.functions.style import compile_style
from voltspan.operators import feeds, relational
from voltspan.plans.fixtures import view, with_views
from voltspan.plans.registry import register
from voltspan.tables import table


@register("bbox_extract", with_views("SELECT id FROM points_a WHERE lon BETWEEN -99.5 AND -98.9 AND lat BETWEEN 40.2 AND 40.6", "points_a"))
def bbox_extract(spark, sf_dir):
    return view(spark, sf_dir, "points_a").where(F.col("lon").between(-99.5, -98.9) & F.col("lat").between(40.2, 40.6)).select("id")


@register("tag_filter", with_views("SELECT id FROM tags WHERE trim(regexp_extract(other_tags, '\"location\"=>\"([^\"]*)\"', 1)) IN ('economy', 'promo') AND (source IS NULL OR source = '' OR source <> 'WIND')", "tags"))
def tag_filter(spark, sf_dir):
    located = text.hstore(F.col("other_tags"), "location").isin("economy", "promo")
    return view(spark, sf_dir, "tags").where(located & ~F.col("source").eqNullSafe("WIND")).select("id")


@register("fuel_allow_list", with_views("SELECT id FROM tags WHERE trim(coalesce(source, '')) = '' OR len(list_filter(list_transform(regexp_split_to_array(source, '[;,]'), lambda x: lower(trim(x))), lambda x: x IN ('solar', 'gas', 'oil'))) > 0", "tags"))
def fuel_allow_list(spark, sf_dir):
    named = F.exists(F.transform(F.split("source", "[;,]"), lambda x: F.lower(F.trim(x))), lambda x: x.isin("solar", "gas", "oil"))
    return view(spark, sf_dir, "tags").where((F.trim(F.coalesce("source", F.lit(""))) == "") | named).select("id")


@register("protected_areas", with_views("SELECT id, size FROM tags WHERE size IN (1, 2, 3, 7, 9) AND NOT (brand LIKE '%3%' OR price > 1050) AND price > -1", "tags"))
def protected_areas(spark, sf_dir):
    return view(spark, sf_dir, "tags").where(F.col("size").isin(1, 2, 3, 7, 9) & ~(F.col("brand").like("%3%") | (F.col("price") > 1050)) & (F.col("price") > -1)).select("id", "size")


@register("recent_confident", "SELECT event_id FROM events WHERE lower(coalesce(event_type, '')) <> 'click' AND round_even((epoch_us(TIMESTAMP '2024-01-16') - epoch_us(ts)) / 3.6e9, 1) BETWEEN 0 AND 24")
def recent_confident(spark, sf_dir):
    age = numeric.age_hours(F.col("ts").cast("timestamp"), F.lit("2024-01-16").cast("timestamp"))
    return table(spark, sf_dir, "events").where((F.lower(F.coalesce("event_type", F.lit(""))) != "click") & (age.isNull() | age.between(0, 24))).select("event_id")


@register("junk_causes", with_views("SELECT id, CASE WHEN NOT regexp_matches(coalesce(source, 'null'), '^(?i:null|not available|wind)$') THEN source END AS cause FROM tags", "tags"))
def junk_causes(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", F.when(~F.coalesce("source", F.lit("null")).rlike("^(?i:null|not available|wind)$"), F.col("source")).alias("cause"))


@register("best_name", with_views("SELECT id, coalesce(nullif(trim(voltage), ''), nullif(trim(output), ''), nullif(trim(source), ''), brand) AS name FROM tags", "tags"))
def best_name(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", text.first_filled(*map(F.col, ("voltage", "output", "source", "brand"))).alias("name"))


@register("kv_backfill", with_views(r"SELECT id, CASE WHEN kv <= 0 AND k BETWEEN 1 AND 2000 THEN k ELSE kv END AS kv FROM (SELECT id, coalesce(list_max(list_transform(regexp_extract_all(voltage, '[0-9]{1,15}'), lambda x: x::BIGINT)) // 1000, -1) AS kv, try_cast(regexp_extract(name, '\b(\d{2,4})\s*[Kk][Vv]\b', 1) AS BIGINT) AS k FROM tags)", "tags"))
def kv_backfill(spark, sf_dir):
    kv, named = text.top_kv_or_unknown(F.col("voltage")), text.kv_in_name(F.col("name"))
    return view(spark, sf_dir, "tags").select("id", F.when((kv <= 0) & named.isNotNull(), named.cast("long")).otherwise(kv).alias("kv"))


@register("direct_current", with_views("SELECT id, CAST(list_contains(string_split(CASE id % 4 WHEN 0 THEN '0' WHEN 1 THEN '50;0' WHEN 2 THEN '60' ELSE '' END, ';'), '0') OR (id % 4 = 3 AND regexp_matches(name, '(?i)ring')) AS INT) AS is_dc FROM tags", "tags"))
def direct_current(spark, sf_dir):
    frequency = F.when(F.col("id") % 4 == 0, "0").when(F.col("id") % 4 == 1, "50;0").when(F.col("id") % 4 == 2, "60").otherwise("")
    listed = F.split(frequency, ";")
    positive = F.exists(listed, lambda f: F.coalesce(f.try_cast("double") > 0, F.lit(False)))
    return view(spark, sf_dir, "tags").select("id", (F.array_contains(listed, "0") | (~positive & F.col("name").rlike("(?i)ring"))).cast("int").alias("is_dc"))


@register("display_rows", with_views("SELECT id, array_to_string(list_filter([coalesce(voltage, ''), coalesce(source, ''), (size % 3)::VARCHAR], lambda v: v NOT IN ('', '0')), '|') AS shown FROM tags", "tags"))
def display_rows(spark, sf_dir):
    values = F.array(F.coalesce("voltage", F.lit("")), F.coalesce("source", F.lit("")), (F.col("size") % 3).cast("string"))
    return view(spark, sf_dir, "tags").select("id", F.array_join(F.filter(values, lambda v: ~v.isin("", "0")), "|").alias("shown"))


@register("stable_uid", with_views("SELECT id, CASE WHEN id % 5 = 0 THEN 'f-' || sha256(brand || '/' || id::VARCHAR)[1:12] ELSE id::VARCHAR END AS uid FROM tags", "tags"))
def stable_uid(spark, sf_dir):
    made = F.concat(F.lit("f-"), F.left(F.sha2(F.concat_ws("/", "brand", F.col("id").cast("string")), 256), F.lit(12)))
    return view(spark, sf_dir, "tags").select("id", F.coalesce(F.when(F.col("id") % 5 != 0, F.col("id").cast("string")), made).alias("uid"))


@register("relation_members", with_views("SELECT r, count(*) AS members, round(avg(lon), 9) AS lon, round(avg(lat), 9) AS lat FROM (SELECT o_custkey AS r, o_orderkey % (SELECT count(*) FROM points_a) + 1 AS ref FROM orders) JOIN points_a ON ref = id GROUP BY r", "points_a"))
def relation_members(spark, sf_dir):
    nodes = view(spark, sf_dir, "points_a").withColumnRenamed("id", "ref")
    members = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("r"), (F.col("o_orderkey") % nodes.count() + 1).alias("ref"))
    joined = members.join(nodes, "ref")
    return joined.groupBy("r").agg(F.count("*").alias("members"), F.round(F.avg("lon"), 9).alias("lon"), F.round(F.avg("lat"), 9).alias("lat"))


@register("nearest_step", "SELECT event_id, least(120, greatest(0, round_even((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-02')) / 3.6e9, 0)))::INT AS step FROM events")
def nearest_step(spark, sf_dir):
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-02").cast("timestamp"))) / F.lit(3.6e9)
    return table(spark, sf_dir, "events").select("event_id", F.least(F.lit(120.0), F.greatest(F.lit(0.0), F.bround(hours, 0))).cast("int").alias("step"))


@register("bracket_in_time", "SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) WHERE ts <= TIMESTAMP '2024-01-10' AND (after > TIMESTAMP '2024-01-10' OR after IS NULL)")
def bracket_in_time(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("after", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.where("ts <= timestamp_ntz '2024-01-10' AND (after > timestamp_ntz '2024-01-10' OR after IS NULL)").select("user_id", "event_id")


@register("zone_key_drift", with_views("SELECT zone, count(*) AS alerts, NOT bool_or(n_nationkey IS NOT NULL) AS unknown FROM alerts LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey % 6 > 0) ON zone = n_nationkey GROUP BY zone", "alerts"))
def zone_key_drift(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_nationkey % 6 > 0").selectExpr("n_nationkey AS zone", "true AS known")
    return view(spark, sf_dir, "alerts").groupBy("zone").agg(F.count("*").alias("alerts")).join(known, "zone", "left").select("zone", "alerts", F.col("known").isNull().alias("unknown"))


@register("same_name_lines", "SELECT p_partkey FROM part WHERE (p_name, p_brand) IN (SELECT p_name, p_brand FROM part WHERE p_partkey = 7)")
def same_name_lines(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.join(part.where("p_partkey = 7").select("p_name", "p_brand"), ["p_name", "p_brand"], "left_semi").select("p_partkey")


@register("records_by_county", with_views(r"SELECT fips, id, utility, out, since FROM outages WHERE regexp_matches(fips, '^\d{5}$') ORDER BY fips, coalesce(out, 0) DESC, id", "outages"))
def records_by_county(spark, sf_dir):
    rows = view(spark, sf_dir, "outages").where(F.col("fips").rlike(r"^\d{5}$"))
    return rows.select("fips", "id", "utility", "out", "since").orderBy("fips", F.desc(F.coalesce("out", F.lit(0))), "id")


@register("dominant_kind", with_views("SELECT size, type AS kind FROM (SELECT size, type, count(*) AS n FROM tags GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY size ORDER BY n DESC, type) = 1", "tags"))
def dominant_kind(spark, sf_dir):
    counted = view(spark, sf_dir, "tags").groupBy("size", F.col("type").alias("kind")).agg(F.count("*").alias("n"))
    return counted.groupBy("size").agg(F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("kind"))


@register("outage_steps", with_views("SELECT id, CASE WHEN out IS NULL THEN 'none' WHEN out < 100 THEN 'low' WHEN out < 500 THEN 'mid' WHEN out < 900 THEN 'high' ELSE 'extreme' END AS colour FROM outages", "outages"))
def outage_steps(spark, sf_dir):
    paint = ["case", ["!", ["has", "out"]], "none", ["step", ["get", "out"], "low", 100, "mid", 500, "high", 900, "extreme"]]
    return view(spark, sf_dir, "outages").select("id", compile_style(paint).alias("colour"))


BUCKETS = [("eco", "ECONOMY"), ("promo", "PROMO"), ("small", "SMALL"), ("any", None)]


@register("first_bucket_colour", with_views("SELECT id, CASE WHEN contains(type || ', ' || brand, 'ECONOMY') THEN 'eco' WHEN contains(type || ', ' || brand, 'PROMO') THEN 'promo' WHEN contains(type || ', ' || brand, 'SMALL') THEN 'small' ELSE 'other' END AS bucket FROM tags", "tags"))
def first_bucket_colour(spark, sf_dir):
    members = F.concat_ws(", ", "type", "brand")
    bucket = reduce(lambda out, b: F.when(members.contains(b[1]), b[0]).otherwise(out), reversed([b for b in BUCKETS if b[1]]), F.lit("other"))
    return view(spark, sf_dir, "tags").select("id", bucket.alias("bucket"))


@register("fuel_icon", with_views("SELECT plant_code, generator_id, part, CASE WHEN prime_mover = 'PS' THEN 'pumped' ELSE CASE energy_source WHEN 'WAT' THEN 'hydro' WHEN 'NG' THEN 'gas' WHEN 'SUN' THEN 'solar' WHEN 'WND' THEN 'wind' ELSE 'other' END END AS icon FROM generators", "generators"))
def fuel_icon(spark, sf_dir):
    icon = ["case", ["==", ["get", "prime_mover"], "PS"], "pumped", ["match", ["get", "energy_source"], "WAT", "hydro", "NG", "gas", "SUN", "solar", "WND", "wind", "other"]]
    return view(spark, sf_dir, "generators").select("plant_code", "generator_id", "part", compile_style(icon).alias("icon"))


@register("population_log", with_views("SELECT id, round(CASE WHEN size > 2 THEN log10(size - 2 + 1) ELSE 0 END, 9) AS v FROM tags", "tags"))
def population_log(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", F.round(numeric.log_population(F.col("size") - 2), 9).alias("v"))


@register("slider", with_views("SELECT id, CASE WHEN p <= 0 THEN 0 ELSE CAST(floor(pow(10e0, least(p, 4000) / 1000e0) + 0.5e0) AS BIGINT) END AS mw FROM (SELECT id, size * 100 - 300 AS p FROM tags)", "tags"))
def slider(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", numeric.slider_to_mw(F.col("size") * 100 - 300).alias("mw"))


@register("slider_back", with_views("SELECT id, CASE WHEN mw <= 0 THEN 0 ELSE CAST(floor(least(greatest(1000e0 * log10(mw), 0e0), 4000e0) + 0.5e0) AS BIGINT) END AS position FROM (SELECT id, (id * 37 % 20000 - 50) / 4e0 AS mw FROM tags)", "tags"))
def slider_back(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", numeric.mw_to_slider((F.col("id") * 37 % 20000 - 50) / 4.0).alias("position"))


@register("size_factor", with_views("SELECT id, round(least(3e0, greatest(0.6e0, sqrt(sqft / 135e0))), 9) AS factor FROM points_a", "points_a"))
def size_factor(spark, sf_dir):
    factor = ["min", 3.0, ["max", 0.6, ["sqrt", ["/", ["get", "sqft"], 135.0]]]]
    return view(spark, sf_dir, "points_a").select("id", F.round(compile_style(factor), 9).alias("factor"))


@register("json_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, coalesce(json_extract_string(props, '$.name'), 'unnamed') AS name FROM events")
def json_properties(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.coalesce(F.try_variant_get(v, "$.name", "string"), F.lit("unnamed")).alias("name"))


@register("truncated_details", with_views("SELECT id, left(region, 20) AS region, size::VARCHAR || ' MMcfd capacity' AS detail, format('{:,}', CAST(size * 1000 AS BIGINT)) || ' bbl' AS stock FROM tags", "tags"))
def truncated_details(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", F.left("region", F.lit(20)).alias("region"), F.concat(F.col("size").cast("string"), F.lit(" MMcfd capacity")).alias("detail"), F.concat(F.format_number(F.col("size") * 1000, 0), F.lit(" bbl")).alias("stock"))


@register("status_spelling", with_views("SELECT id, CASE type WHEN 'ECONOMY' THEN 'On hold' WHEN 'PROMO' THEN 'On hold' ELSE type END AS status, CASE WHEN upper(trim(brand)) = 'BRAND#3' THEN '' ELSE brand END AS brand FROM tags", "tags"))
def status_spelling(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", text.mapped(F.col("type"), {"ECONOMY": "On hold", "PROMO": "On hold"}).alias("status"), F.when(F.upper(F.trim("brand")) == "BRAND#3", "").otherwise(F.col("brand")).alias("brand"))


@register("address_split", with_views("SELECT id, split_part(a, ', ', 1) AS name, array_to_string(string_split(a, ', ')[2:], ', ') AS place FROM (SELECT id, region || ', ' || brand || ', ' || type AS a FROM tags)", "tags"))
def address_split(spark, sf_dir):
    parts = F.split(F.concat_ws(", ", "region", "brand", "type"), ", ")
    return view(spark, sf_dir, "tags").select("id", F.get(parts, F.lit(0)).alias("name"), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ", ").alias("place"))


@register("ordered_distinct", with_views("SELECT zone, string_agg(severity, ',' ORDER BY first) AS severities FROM (SELECT zone, severity, min(id) AS first FROM alerts GROUP BY zone, severity) GROUP BY zone", "alerts"))
def ordered_distinct(spark, sf_dir):
    firsts = view(spark, sf_dir, "alerts").groupBy("zone", "severity").agg(F.min("id").alias("first"))  # each value once, in the order of its first row
    listed = F.transform(F.sort_array(F.collect_list(F.struct("first", "severity"))), lambda x: x["severity"])
    return firsts.groupBy("zone").agg(F.array_join(listed, ",").alias("severities"))


@register("subset_of_tags", with_views("SELECT id, list_has_all(['economy', 'promo', 'small'], [lower(type)]) AS covered FROM tags", "tags"))
def subset_of_tags(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", (F.size(F.array_except(F.array(F.lower("type")), F.array(*map(F.lit, ("economy", "promo", "small"))))) == 0).alias("covered"))


@register("tile_duplicates", "SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 10 > 0 UNION ALL SELECT NULL, l_linenumber FROM lineitem WHERE l_orderkey % 10 = 0)")
def tile_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 10 > 0, F.col("l_orderkey")).alias("l_orderkey"), "l_linenumber")
    known = F.col("l_orderkey").isNotNull()
    return rows.where(known).dropDuplicates().unionByName(rows.where(~known))


@register("day_fallback", "SELECT min(d) AS delta FROM (SELECT datediff('day', CAST(ts AS DATE), DATE '2024-02-05') AS d FROM events) WHERE d BETWEEN 0 AND 30".replace("datediff('day', CAST(ts AS DATE), DATE '2024-02-05')", "CAST(DATE '2024-02-05' - CAST(ts AS DATE) AS INT)"))
def day_fallback(spark, sf_dir):
    delta = F.datediff(F.lit("2024-02-05").cast("date"), F.col("ts").cast("date"))
    return table(spark, sf_dir, "events").select(delta.alias("delta")).where(F.col("delta").between(0, 30)).agg(F.min("delta").alias("delta"))


@register("degraded_variables", "SELECT b AS variable, CASE WHEN n = 2 THEN 'ok' WHEN n = 1 THEN 'degraded' ELSE 'failed' END AS status FROM (VALUES ('rh', 2), ('wind', 1), ('gust', 0)) AS v(b, n)")
def degraded_variables(spark, sf_dir):
    needed = spark.createDataFrame([("rh", "click"), ("rh", "error"), ("wind", "purchase"), ("wind", "nothing"), ("gust", "none"), ("gust", "nil")], "variable string, band string")
    have = table(spark, sf_dir, "events").select(F.col("event_type").alias("band")).distinct().withColumn("there", F.lit(1))
    joined = needed.join(have, "band", "left").groupBy("variable").agg(F.count("there").alias("n"), F.count("*").alias("all"))
    return joined.select("variable", F.when(F.col("n") == F.col("all"), "ok").when(F.col("n") > 0, "degraded").otherwise("failed").alias("status"))


@register("feed_freshness", with_views("SELECT zone, CASE WHEN zone % 7 = 0 THEN 'skip' WHEN zone > 12 THEN 'fail' WHEN zone > 6 THEN 'warn' ELSE 'ok' END AS state FROM (SELECT DISTINCT zone FROM alerts)", "alerts"))
def feed_freshness(spark, sf_dir):
    age = F.when(F.col("zone") % 7 != 0, F.col("zone") * F.lit(1.0))
    return view(spark, sf_dir, "alerts").select("zone").distinct().select("zone", feeds.freshness(age, F.lit(12.0)).alias("state"))


@register("recent_events", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 50")
def recent_events(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id")


@register("zone_keys", with_views("SELECT DISTINCT CASE WHEN zone % 2 = 0 THEN 'f' ELSE 'c' END || lpad(zone::VARCHAR, 3, '0') AS key FROM alerts", "alerts"))
def zone_keys(spark, sf_dir):
    key = F.concat(F.when(F.col("zone") % 2 == 0, "f").otherwise("c"), F.lpad(F.col("zone").cast("string"), 3, "0"))
    return view(spark, sf_dir, "alerts").select(key.alias("key")).distinct()


@register("sort_keys", with_views("SELECT id, 100000 - size AS mw_key, CASE type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END AS type_key FROM tags", "tags"))
def sort_keys(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", compile_style(["-", 100000, ["get", "size"]]).alias("mw_key"), compile_style(["match", ["get", "type"], "PROMO", 0, "ECONOMY", 1, 2]).alias("type_key"))


@register("cyclic_colours", "SELECT n_nationkey, (['red', 'green', 'blue', 'grey', 'pink'])[n_nationkey % 5 + 1] AS colour FROM nation")
def cyclic_colours(spark, sf_dir):
    colours = F.array(*map(F.lit, ("red", "green", "blue", "grey", "pink")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.get(colours, F.pmod(F.col("n_nationkey"), F.lit(5))).alias("colour"))


@register("kept_columns", "SELECT p_partkey AS P_PARTKEY, p_name FROM part")
def kept_columns(spark, sf_dir):
    return relational.keep_columns(table(spark, sf_dir, "part"), ["P_PARTKEY", "p_name", "not_there"])


@register("sparse_properties", with_views("SELECT id, '{' || array_to_string(list_filter([CASE WHEN nullif(voltage, '') IS NOT NULL THEN '\"voltage\":\"' || voltage || '\"' END, CASE WHEN size % 3 <> 0 THEN '\"depth\":' || (size % 3)::VARCHAR END], lambda x: x IS NOT NULL), ',') || '}' AS properties FROM tags", "tags"))
def sparse_properties(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", F.to_json(F.struct(F.nullif("voltage", F.lit("")).alias("voltage"), F.nullif(F.col("size") % 3, F.lit(0)).alias("depth"))).alias("properties"))
