"""Queries of the scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltspan.functions import filters, numeric, text
from voltspan.functions.style import compile_style
from voltspan.plans.fixtures import view, with_views
from voltspan.plans.registry import register

D = "CAST(x AS DOUBLE)"


@register("parse_voltage_best", with_views("SELECT id, list_max(list_filter(list_transform(regexp_extract_all(voltage, '[0-9]{1,15}'), lambda x: x::BIGINT // 1000), lambda k: k > 0)) AS kv FROM tags", "tags"))
def parse_voltage_best(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", text.best_kv(F.col("voltage")).alias("kv"))


@register("parse_voltage_raw", with_views("SELECT id, coalesce(list_max(list_transform(regexp_extract_all(voltage, '[0-9]{1,15}'), lambda x: x::BIGINT)) // 1000, -1) AS kv FROM tags", "tags"))
def parse_voltage_raw(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", text.top_kv_or_unknown(F.col("voltage")).alias("kv"))


@register(
    "parse_voltage_levels",
    with_views(
        """WITH p AS (SELECT id, list_reverse_sort(list_distinct(list_filter(list_transform(list_filter(list_transform(string_split(voltage, ';'), lambda t: trim(t)), lambda t: regexp_full_match(t, '[0-9]{1,15}')),
        lambda t: CASE WHEN t::BIGINT >= 1000 THEN t::BIGINT // 1000 ELSE t::BIGINT END), lambda v: v > 0))) AS v FROM tags)
        SELECT id, v[1] AS nominal_kv, nullif(array_to_string(list_transform(v, lambda x: x::VARCHAR), ';'), '') AS levels FROM p""",
        "tags",
    ),
)
def parse_voltage_levels(spark, sf_dir):
    levels = view(spark, sf_dir, "tags").select("id", text.voltage_levels(F.col("voltage")).alias("v"))
    return levels.select("id", F.get("v", F.lit(0)).alias("nominal_kv"), F.nullif(F.array_join("v", ";"), F.lit("")).alias("levels"))


@register(
    "parse_output_mw",
    with_views(
        """WITH p AS (SELECT id, trim(output) AS o FROM tags), q AS (SELECT id, o, try_cast(replace(regexp_extract(o, '^([0-9,.]+)', 1), ',', '') AS DOUBLE) AS n, upper(regexp_extract(o, '(?i)^[0-9,.]+\\s*(MW|kW|GW|W)?', 1)) AS u FROM p)
        SELECT id, CASE WHEN lower(o) IN ('', 'yes', 'no') THEN NULL ELSE CASE u WHEN 'GW' THEN n * 1e3 WHEN 'KW' THEN n / 1e3 WHEN 'W' THEN n / 1e6 ELSE n END END AS mw FROM q""".replace("\\\\", "\\"),
        "tags",
    ),
)
def parse_output_mw(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", text.output_mw(F.col("output")).alias("mw"))


@register(
    "normalise_source",
    with_views(
        "WITH p AS (SELECT id, trim(split_part(lower(trim(coalesce(source, ''))), ';', 1)) AS s FROM tags), m(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in text.SOURCES.items()) + ") SELECT id, coalesce(b, s) AS source FROM p LEFT JOIN m ON s = a",
        "tags",
    ),
)
def normalise_source(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", text.canonical_source(F.col("source")).alias("source"))


@register(
    "classify_keywords",
    with_views("SELECT id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(coalesce(sic, {chr(39) * 2})), {chr(39)}{k}{chr(39)})' for k in own)} THEN '{name}'" for name, own in text.COMMODITIES) + " ELSE 'other' END AS category FROM tags", "tags"),
)
def classify_keywords(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", text.keyword_category(F.col("sic")).alias("category"))


@register(
    "hstore_tags",
    with_views("SELECT id, trim(regexp_extract(other_tags, '\"name\"=>\"([^\"]*)\"', 1)) AS name, trim(regexp_extract(other_tags, '\"operator\"=>\"([^\"]*)\"', 1)) AS operator, NULL::VARCHAR AS wires, 3::INT AS n_tags FROM tags", "tags"),
)
def hstore_tags(spark, sf_dir):
    tags = F.col("other_tags")
    return view(spark, sf_dir, "tags").select("id", *(text.hstore(tags, k).alias(k) for k in ("name", "operator", "wires")), F.size(text.hstore_map(tags)).alias("n_tags"))


@register(
    "title_case",
    with_views("SELECT id, array_to_string(list_transform(regexp_extract_all(name, '([A-Za-z]+|[^A-Za-z]+)'), lambda r: upper(r[1:1]) || lower(r[2:])), '') AS title FROM tags", "tags"),
)
def title_case(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", text.title_case(F.col("name")).alias("title"))


@register("placeholder_names", with_views(r"SELECT id, CASE WHEN name LIKE 'UNKNOWN%' THEN NULL ELSE name END AS name FROM tags WHERE NOT regexp_matches(name, '^(TAP\d+|DEADEND\d*|RISER\d+|\d+)$')", "tags"))
def placeholder_names(spark, sf_dir):
    named = view(spark, sf_dir, "tags").where(~F.col("name").rlike(text.PLACEHOLDER))
    return named.select("id", F.when(~F.col("name").startswith("UNKNOWN"), F.col("name")).alias("name"))


@register("kv_from_name", with_views(r"SELECT id, CASE WHEN k BETWEEN 1 AND 2000 THEN k END AS kv FROM (SELECT id, try_cast(regexp_extract(name, '\b(\d{2,4})\s*[Kk][Vv]\b', 1) AS INT) AS k FROM tags)", "tags"))
def kv_from_name(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", text.kv_in_name(F.col("name")).alias("kv"))


@register(
    "bracket_codes",
    with_views(
        r"""SELECT id, CASE WHEN m <> '' THEN trim(replace(replace(m, ',', ''), ' RE', '')) ELSE left(region, 10) END AS code, trim(regexp_replace(region, '\s*\([^)]*\)\s*$', '')) AS region
        FROM (SELECT id, region, regexp_extract(region, '\(([A-Z]+(,\s*RE)?)\)', 1) AS m FROM tags)""",
        "tags",
    ),
)
def bracket_codes(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", text.bracket_code(F.col("region")).alias("code"), text.without_bracket(F.col("region")).alias("region"))


#: CRC-32 of ASCII text, a byte and a bit at a time.
CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(brand, ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"


@register("crc_colour", with_views(f"SELECT id, CAST({CRC} % 6 AS INT) AS colour FROM tags", "tags"))
def crc_colour(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", text.hash_bucket(F.col("brand"), 6).alias("colour"))


@register("names_concat", with_views("SELECT plant_code, array_to_string(list_filter([trim(plant_name), trim(authority), CASE WHEN sector = '5-LOW' THEN '' ELSE trim(sector) END], lambda x: x <> ''), '; ') AS names FROM plants", "plants"))
def names_concat(spark, sf_dir):
    return view(spark, sf_dir, "plants").select("plant_code", text.joined("; ", F.col("plant_name"), F.col("authority"), F.when(F.col("sector") != "5-LOW", F.col("sector"))).alias("names"))


ZONES = ("events", ("event_id AS id", "'https://api.weather.example/zones/' || CASE event_id % 5 WHEN 0 THEN 'forecast' WHEN 1 THEN 'fire' WHEN 2 THEN 'county' WHEN 3 THEN 'marine' ELSE 'office' END || '/' || CASE user_id % 4 WHEN 0 THEN 'TXC' WHEN 1 THEN 'AMZ' WHEN 2 THEN 'CAC' ELSE 'QQC' END || lpad(CAST(user_id % 1000 AS STRING), 3, '0') AS url"))


@register(
    "zone_url",
    f"""WITH z AS (SELECT {', '.join(ZONES[1])} FROM events), p AS (SELECT id, split_part(url, '/', 5) AS t, split_part(url, '/', 6) AS u FROM z)
    SELECT id, CASE WHEN t IN ('forecast', 'fire', 'county', 'marine') THEN CASE WHEN t <> 'county' AND left(u, 2) IN ({', '.join(f"'{m}'" for m in text.MARINE)}) THEN 'marine' ELSE t END END AS type,
    CASE WHEN t IN ('forecast', 'fire', 'county', 'marine') THEN u END AS ugc, CASE WHEN t IN ('forecast', 'fire', 'county', 'marine') AND u[3] = 'C' THEN CASE left(u, 2) WHEN 'TX' THEN '48' WHEN 'CA' THEN '06' END || u[4:] END AS fips FROM p""",
)
def zone_url(spark, sf_dir):
    from voltspan.tables import table

    zones = table(spark, sf_dir, ZONES[0]).selectExpr(*ZONES[1]).select("id", text.zone_of_url(F.col("url")).alias("z"))
    return zones.select("id", "z.type", "z.ugc", text.county_fips(F.col("z.ugc")).alias("fips"))


@register("same_to_fips", "SELECT event_id AS id, CASE WHEN event_id % 7 > 0 AND user_id % 1000 > 0 THEN lpad(CAST(user_id % 1000 AS VARCHAR), 5, '0') END AS fips FROM events")
def same_to_fips(spark, sf_dir):
    from voltspan.tables import table

    codes = table(spark, sf_dir, "events").selectExpr("event_id AS id", "CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE lpad(CAST(user_id % 1000 AS STRING), 6, '0') END AS code")
    return codes.select("id", text.same_fips(F.col("code")).alias("fips"))


@register("unit_conversions", with_views("SELECT id, round_even(price * 2.471e0, 1) AS acres, price / 1609.344e0 AS miles, (price - 273.15e0) AS celsius, price * 1.8e0 + 32e0 AS fahrenheit, price / 100e0 AS millibar FROM tags WHERE price > 0", "tags"))
def unit_conversions(spark, sf_dir):
    x = F.col("price")
    return view(spark, sf_dir, "tags").where(x > 0).select("id", F.bround(x * F.lit(2.471), 1).alias("acres"), (x / F.lit(1609.344)).alias("miles"), (x - F.lit(273.15)).alias("celsius"), (x * F.lit(1.8) + F.lit(32.0)).alias("fahrenheit"), (x / F.lit(100.0)).alias("millibar"))


@register("sentinels", with_views("SELECT id, CASE WHEN price > -999999 THEN price END AS price FROM tags", "tags"))
def sentinels(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", numeric.sentinel_to_null(F.col("price")).alias("price"))


@register("relative_humidity", "SELECT event_id AS id, round(greatest(0e0, least(100e0, 100e0 * exp(17.625e0 * d / (243.04e0 + d)) / exp(17.625e0 * t / (243.04e0 + t)))), 6) AS rh FROM (SELECT event_id, (event_id % 45) * 1e0 AS t, (user_id % 40) * 1e0 AS d FROM events)")
def relative_humidity(spark, sf_dir):
    from voltspan.tables import table

    weather = table(spark, sf_dir, "events").selectExpr("event_id AS id", "(event_id % 45) * 1e0 AS t", "(user_id % 40) * 1e0 AS d")
    return weather.select("id", F.round(numeric.relative_humidity(F.col("t"), F.col("d")), 6).alias("rh"))


@register("wind_speed", "SELECT event_id AS id, round(sqrt(value * value + (user_id * 1e0) * (user_id * 1e0)), 6) AS speed, CASE WHEN value > 50 THEN 1 ELSE 0 END AS strong FROM events")
def wind_speed(spark, sf_dir):
    from voltspan.tables import table

    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.round(numeric.wind_speed(F.col("value"), F.col("user_id") * F.lit(1.0)), 6).alias("speed"), (F.col("value") > 50).cast("int").alias("strong"))


@register("int16_codec", "SELECT event_id AS id, CAST(round_even(value * 10e0, 0) AS SMALLINT) AS encoded, CASE WHEN round_even(value * 10e0, 0) > -9999 THEN CAST(CAST(round_even(value * 10e0, 0) AS SMALLINT) AS DOUBLE) / 10e0 END AS decoded FROM events")
def int16_codec(spark, sf_dir):
    from voltspan.tables import table

    coded = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), numeric.encode_int16(F.col("value"), 10, -9999).alias("encoded"))
    return coded.withColumn("decoded", numeric.decode_int16(F.col("encoded").cast("double"), 10, -9999))


@register("epoch_iso", "SELECT event_id AS id, strftime(make_timestamp((1700000000000 + event_id * 61000) * 1000), '%Y-%m-%dT%H:%MZ') AS iso FROM events")
def epoch_iso(spark, sf_dir):
    from voltspan.tables import table

    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), numeric.epoch_ms_text(F.lit(1700000000000) + F.col("event_id") * 61000).alias("iso"))


@register("julian_time", "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_days(CAST(event_id % 366 AS INT)) + to_minutes(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 24 * 60 + event_id % 60 END) END AS t FROM events")
def julian_time(spark, sf_dir):
    from voltspan.tables import table

    raw = "CASE WHEN event_id % 5 = 0 THEN 'garbage' ELSE '2024' || lpad(CAST(event_id % 366 + 1 AS STRING), 3, '0') || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' ' || lpad(CAST(event_id % 24 AS STRING), 2, '0') || lpad(CAST(event_id % 60 AS STRING), 2, '0') END END AS raw"
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", raw).select("id", numeric.julian_time(F.col("raw")).cast("timestamp_ntz").alias("t"))


@register("age_hours", "SELECT event_id AS id, round_even(epoch_us(TIMESTAMP '2024-03-01' - ts) / 3.6e9, 1) AS age FROM (SELECT event_id, ts FROM events)".replace("epoch_us(TIMESTAMP '2024-03-01' - ts)", "(epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts))"))
def age_hours(spark, sf_dir):
    from voltspan.tables import table

    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), numeric.age_hours(F.col("ts").cast("timestamp"), F.lit("2024-03-01").cast("timestamp")).alias("age"))


@register(
    "age_text",
    """SELECT event_id AS id, CASE WHEN m >= 1440 THEN (m // 1440)::VARCHAR || 'd ' || (m // 60 % 24)::VARCHAR || 'h' WHEN m >= 60 THEN (m // 60)::VARCHAR || 'h ' || (m % 60)::VARCHAR || 'm' ELSE m::VARCHAR || 'm' END AS age,
    CASE WHEN m < 60 THEN m::VARCHAR || 'm' WHEN floor(m / 60e0 + 0.5e0) < 24 THEN floor(m / 60e0 + 0.5e0)::BIGINT::VARCHAR || 'h' ELSE floor(floor(m / 60e0 + 0.5e0) / 24e0 + 0.5e0)::BIGINT::VARCHAR || 'd' END AS short FROM (SELECT event_id, event_id % 5000 AS m FROM events)""",
)
def age_text(spark, sf_dir):
    from voltspan.tables import table

    m = F.col("event_id") % 5000
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), numeric.age_text(m).alias("age"), numeric.age_text_short(m).alias("short"))


@register("redact_tokens", "SELECT page_id, regexp_replace(url || '?token=' || page_id::VARCHAR || '&x=1', '(?i)([?&]token=)[^&\\s]*', '\\1REDACTED', 'g') AS url FROM pages".replace("\\\\", "\\"))
def redact_tokens(spark, sf_dir):
    from voltspan.tables import table

    return table(spark, sf_dir, "pages").select("page_id", text.redacted_tokens(F.concat("url", F.lit("?token="), F.col("page_id").cast("string"), F.lit("&x=1"))).alias("url"))


def kv_case(kv: str) -> str:
    return f"CASE WHEN {kv} >= 550 THEN '550+' WHEN {kv} >= 500 THEN '500-549' WHEN {kv} >= 300 THEN '300-499' WHEN {kv} >= 200 THEN '200-299' WHEN {kv} >= 100 THEN '100-199' WHEN {kv} > 0 THEN '<100' ELSE 'unknown' END"


@register("kv_bucket_counts", with_views(f"SELECT {kv_case('kv')} AS bucket, count(*) AS n FROM (SELECT coalesce(try_cast(voltage AS DOUBLE), -1) / 1e0 AS kv FROM tags) GROUP BY 1", "tags"))
def kv_bucket_counts(spark, sf_dir):
    return view(spark, sf_dir, "tags").groupBy(filters.kv_bucket(F.col("voltage")).alias("bucket")).agg(F.count("*").alias("n"))


@register("filter_kv_buckets", with_views(f"SELECT id FROM (SELECT id, coalesce(try_cast(voltage AS DOUBLE), -1) AS kv FROM tags) WHERE {kv_case('kv')} IN ('100-199', 'unknown')", "tags"))
def filter_kv_buckets(spark, sf_dir):
    return view(spark, sf_dir, "tags").where(filters.combined(filters.kv_buckets("voltage", {"100-199", "unknown"}))).select("id")


FUELS = {"gas": ["NG"], "solar": ["SUN"], "wind": ["WND"], "hydro": ["WAT"]}


@register("filter_value_other", with_views("SELECT plant_code, generator_id, part FROM generators WHERE energy_source IN ('NG') OR energy_source IS NULL OR energy_source NOT IN ('NG', 'SUN', 'WND', 'WAT')", "generators"))
def filter_value_other(spark, sf_dir):
    keep = filters.value_buckets("energy_source", {"gas", "other"}, FUELS, [*FUELS, "other"])
    return view(spark, sf_dir, "generators").where(keep).select("plant_code", "generator_id", "part")


@register("filter_mw_range", with_views("SELECT plant_code, generator_id, part FROM generators WHERE nameplate_mw >= 200", "generators"))
def filter_mw_range(spark, sf_dir):
    return view(spark, sf_dir, "generators").where(filters.combined(filters.mw_between("nameplate_mw", 200, 10_000))).select("plant_code", "generator_id", "part")


@register("filter_alive_year", with_views("SELECT plant_code, generator_id, part FROM generators WHERE coalesce(op_year, 0) <= 1998 AND 1998 < CASE WHEN coalesce(retirement_year, 0) <= 0 THEN 9999 ELSE retirement_year END", "generators"))
def filter_alive_year(spark, sf_dir):
    return view(spark, sf_dir, "generators").where(filters.alive_in(1998, "op_year", "retirement_year")).select("plant_code", "generator_id", "part")


@register("filter_fuel_pumped", with_views("SELECT plant_code, generator_id, part FROM generators WHERE energy_source = 'SUN' OR (energy_source = 'WAT' AND prime_mover <> 'PS')", "generators"))
def filter_fuel_pumped(spark, sf_dir):
    return view(spark, sf_dir, "generators").where(filters.fuel("energy_source", "prime_mover", {"solar", "hydro"}, FUELS)).select("plant_code", "generator_id", "part")


@register("filter_combined", with_views("SELECT plant_code, generator_id, part FROM generators WHERE energy_source = 'WND' AND nameplate_mw >= 100 AND nameplate_mw <= 500 AND op_year <= 1999 AND 1999 < CASE WHEN coalesce(retirement_year, 0) <= 0 THEN 9999 ELSE retirement_year END", "generators"))
def filter_combined(spark, sf_dir):
    keep = filters.combined(filters.fuel("energy_source", "prime_mover", {"wind"}, FUELS), filters.mw_between("nameplate_mw", 100, 500), filters.alive_in(1999, "op_year", "retirement_year"), None)
    return view(spark, sf_dir, "generators").where(keep).select("plant_code", "generator_id", "part")


@register("filter_placement", with_views("SELECT id FROM tags WHERE contains(type, 'ECONOMY')", "tags"))
def filter_placement(spark, sf_dir):
    return view(spark, sf_dir, "tags").where(compile_style([">=", ["index-of", "ECONOMY", ["get", "type"]], 0])).select("id")


STYLE_RADIUS = ["interpolate", ["linear"], ["get", "size"], 5, 1.0, 20, 4.0, 40, 12.0]
STYLE_COLOUR = ["step", ["to-number", ["get", "size"]], "none", 10, "low", 30, "mid", 45, "high"]
STYLE_LABEL = ["case", ["in", ["get", "type"], ["literal", ["ECONOMY", "PROMO"]]], ["concat", ["get", "brand"], "/", ["get", "size"]], ["!", ["has", "voltage"]], "no voltage", ""]


@register("style_interpolate", with_views("SELECT id, CASE WHEN size <= 5 THEN 1e0 WHEN size < 20 THEN 1e0 + 3e0 * (size - 5e0) / 15e0 WHEN size < 40 THEN 4e0 + 8e0 * (size - 20e0) / 20e0 ELSE 12e0 END AS radius FROM tags", "tags"))
def style_interpolate(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", compile_style(STYLE_RADIUS).alias("radius"))


@register("style_step", with_views("SELECT id, CASE WHEN size < 10 THEN 'none' WHEN size < 30 THEN 'low' WHEN size < 45 THEN 'mid' ELSE 'high' END AS colour, CASE WHEN type IN ('ECONOMY', 'PROMO') THEN brand || '/' || size::VARCHAR WHEN voltage IS NULL THEN 'no voltage' ELSE '' END AS label FROM tags", "tags"))
def style_step(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", compile_style(STYLE_COLOUR).alias("colour"), compile_style(STYLE_LABEL).alias("label"))
