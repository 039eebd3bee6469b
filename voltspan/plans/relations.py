"""Queries of joins, unions, deduplication, rollups, winners, search and live feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltspan.functions import filters, numeric
from voltspan.operators import feeds, relational
from voltspan.plans.fixtures import view, with_views
from voltspan.plans.registry import register
from voltspan.tables import table

CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
CUT_MW = "CASE WHEN {0} >= 1000 THEN '1000+' WHEN {0} >= 500 THEN '500-1000' WHEN {0} >= 100 THEN '100-500' WHEN {0} >= 20 THEN '20-100' WHEN {0} >= 10 THEN '10-20' WHEN {0} >= 5 THEN '5-10' WHEN {0} >= 0 THEN '0-5' END"
CUT_KV = "CASE WHEN {0} >= 600 THEN '600+' WHEN {0} >= 500 THEN '500-600' WHEN {0} >= 400 THEN '400-500' WHEN {0} >= 300 THEN '300-400' WHEN {0} >= 200 THEN '200-300' WHEN {0} >= 100 THEN '100-200' WHEN {0} >= 50 THEN '50-100' WHEN {0} > 0 THEN '0-50' ELSE 'unknown' END"
STATUS = "CASE WHEN status = 'RE' THEN 'retired' WHEN retirement_year > 0 THEN 'retirement' WHEN status = 'SB' THEN 'proposed' ELSE 'existing' END"


@register("pricing_summary", f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum({CENTS}) AS BIGINT) AS price_cents, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.expr(CENTS)).alias("price_cents"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@register("flagship_generator_mix", with_views(f"SELECT sector, {CUT_MW.format('nameplate_mw')} AS mw_range, {STATUS} AS gen_status, count(*) AS n, CAST(sum(CAST(round(nameplate_mw * 10000) AS BIGINT)) AS BIGINT) AS mw_e4 FROM generators LEFT JOIN plants USING (plant_code) GROUP BY ALL", "generators", "plants"))
def flagship_generator_mix(spark, sf_dir):
    joined = view(spark, sf_dir, "generators").join(view(spark, sf_dir, "plants"), "plant_code", "left")
    return joined.groupBy("sector", numeric.mw_range(F.col("nameplate_mw")).alias("mw_range"), F.expr(STATUS).alias("gen_status")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("nameplate_mw") * 10000).cast("long")).alias("mw_e4"))


@register("generators_left_plants", with_views("SELECT g.plant_code, generator_id, part, plant_name FROM generators AS g LEFT JOIN (SELECT * FROM plants WHERE plant_code % 3 > 0) AS p USING (plant_code)", "generators", "plants"))
def generators_left_plants(spark, sf_dir):
    plants = view(spark, sf_dir, "plants").where("plant_code % 3 > 0")
    return view(spark, sf_dir, "generators").join(plants, "plant_code", "left").select("plant_code", "generator_id", "part", "plant_name")


@register("kv_range", with_views(f"SELECT id, {CUT_KV.format('size * 13')} AS kv_range FROM tags", "tags"))
def kv_range(spark, sf_dir):
    return view(spark, sf_dir, "tags").select("id", numeric.kv_range(F.col("size") * 13).alias("kv_range"))


@register("peak_threshold", "SELECT p_partkey, CAST(peak AS INT) AS peak FROM part JOIN (SELECT l_partkey, max(CAST(l_quantity AS INT)) AS peak FROM lineitem WHERE l_quantity > 0 GROUP BY 1) ON p_partkey = l_partkey WHERE peak >= 48")
def peak_threshold(spark, sf_dir):
    peaks = table(spark, sf_dir, "lineitem").where("l_quantity > 0").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.col("l_quantity").cast("int")).alias("peak"))
    return table(spark, sf_dir, "part").select("p_partkey").join(peaks.where("peak >= 48"), "p_partkey")


@register("decode_domains", "SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 > 0) ON c_nationkey = n_nationkey")
def decode_domains(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 5 > 0")
    return relational.decode(table(spark, sf_dir, "customer"), "c_nationkey", nations, "n_nationkey", "n_name").select("c_custkey", F.col("c_nationkey").alias("nation"))


@register("union_sources", "SELECT dataset, count(*) AS n, count(brand) AS with_brand FROM (SELECT 'customers' AS dataset, NULL AS brand FROM customer UNION ALL SELECT 'suppliers', NULL FROM supplier UNION ALL SELECT 'parts', p_brand FROM part) GROUP BY dataset")
def union_sources(spark, sf_dir):
    sources = {"customers": table(spark, sf_dir, "customer").selectExpr("c_name AS name"), "suppliers": table(spark, sf_dir, "supplier").selectExpr("s_name AS name"), "parts": table(spark, sf_dir, "part").selectExpr("p_name AS name", "p_brand AS brand")}
    return relational.union_sources(sources).groupBy("dataset").agg(F.count("*").alias("n"), F.count("brand").alias("with_brand"))


@register("dedup_first", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) = 1")
def dedup_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return relational.keep_first(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("dedup_text_key", "SELECT split_part(c_name, '#', 1) || ',' || c_mktsegment || ',' || (c_nationkey)::VARCHAR AS key, min(c_custkey) AS first FROM customer GROUP BY 1")
def dedup_text_key(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat_ws(",", F.split_part("c_name", F.lit("#"), F.lit(1)), "c_mktsegment", F.col("c_nationkey").cast("string")).alias("key"), "c_custkey")
    return relational.keep_first(rows, ["key"], ["c_custkey"]).withColumnRenamed("c_custkey", "first")


@register("anti_orphans", "SELECT p_partkey AS key, 'missing' AS what FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT DISTINCT l_partkey, 'orphan' FROM lineitem WHERE l_quantity > 45 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def anti_orphans(spark, sf_dir):
    part, used = table(spark, sf_dir, "part").selectExpr("p_partkey AS key", "p_size"), table(spark, sf_dir, "lineitem").where("l_quantity > 45").selectExpr("l_partkey AS key")
    missing = part.select("key").join(used, "key", "left_anti").withColumn("what", F.lit("missing"))
    return missing.unionByName(used.distinct().join(part.where("p_size < 40"), "key", "left_anti").withColumn("what", F.lit("orphan")))


@register("multi_sort", with_views("SELECT id, name, kv FROM (SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE brand END AS name, CASE WHEN id % 3 = 0 THEN NULL ELSE size END AS kv FROM tags) ORDER BY name ASC NULLS LAST, kv DESC NULLS LAST, id", "tags"))
def multi_sort(spark, sf_dir):
    rows = view(spark, sf_dir, "tags").selectExpr("id", "CASE WHEN id % 4 = 0 THEN NULL ELSE brand END AS name", "CASE WHEN id % 3 = 0 THEN NULL ELSE size END AS kv")
    return rows.orderBy(F.asc_nulls_last("name"), F.desc_nulls_last("kv"), "id")


@register("topn_counts", with_views("SELECT energy_source, count(*) AS n FROM generators WHERE energy_source IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3", "generators"))
def topn_counts(spark, sf_dir):
    return relational.top_counts(view(spark, sf_dir, "generators"), "energy_source", 3)


@register("fill_rates", with_views("SELECT field, filled, round_even(100e0 * filled / n, 1) AS percent FROM (SELECT count(*) AS n, count(voltage) AS voltage, count(output) AS output, count(source) AS source FROM tags) UNPIVOT (filled FOR field IN (voltage, output, source))", "tags"))
def fill_rates(spark, sf_dir):
    return relational.fill_rates(view(spark, sf_dir, "tags"), ["voltage", "output", "source"])


@register("conditional_counts", with_views("SELECT count(*) FILTER (WHERE nameplate_mw >= 100) AS large, count(*) FILTER (WHERE status = 'RE') AS retired, min(op_year) AS first_year, max(op_year) AS last_year, count(*) FILTER (WHERE energy_source IS NULL) AS unknown FROM generators", "generators"))
def conditional_counts(spark, sf_dir):
    rows = view(spark, sf_dir, "generators")
    return rows.agg(F.count_if(F.col("nameplate_mw") >= 100).alias("large"), F.count_if(F.col("status") == "RE").alias("retired"), F.min("op_year").alias("first_year"), F.max("op_year").alias("last_year"), F.count_if(F.col("energy_source").isNull()).alias("unknown"))


FIPS = r"regexp_matches(fips, '^\d{5}$')"
UTIL = r"regexp_replace(utility, ',\d+$', '')"


def outage_rows(spark, sf_dir):
    rows = view(spark, sf_dir, "outages").where(F.col("fips").rlike(r"^\d{5}$"))
    return rows.withColumn("utility", F.regexp_replace("utility", r",\d+$", ""))


@register("outage_county", with_views(f"SELECT fips, CAST(sum(coalesce(out, 0)) AS BIGINT) AS out, count(*) AS n FROM outages WHERE {FIPS} GROUP BY fips", "outages"))
def outage_county(spark, sf_dir):
    return relational.nested_rollup(outage_rows(spark, sf_dir), "fips", "utility", "out", "since").select("fips", "out", "n")


@register("outage_county_utility", with_views(f"SELECT fips, {UTIL} AS utility, CAST(sum(coalesce(out, 0)) AS BIGINT) AS out, count(*) AS n, min(since) AS since, row_number() OVER (PARTITION BY fips ORDER BY sum(coalesce(out, 0)) DESC, {UTIL}) AS place FROM outages WHERE {FIPS} GROUP BY ALL", "outages").replace("GROUP BY ALL", f"GROUP BY fips, {UTIL}"))
def outage_county_utility(spark, sf_dir):
    nested = relational.nested_rollup(outage_rows(spark, sf_dir), "fips", "utility", "out", "since")
    each = nested.select("fips", F.posexplode("parts").alias("i", "u"))
    return each.select("fips", F.col("u.name").alias("utility"), "u.out", "u.n", "u.since", (F.col("i") + 1).cast("long").alias("place"))


@register("outage_quality", with_views(f"SELECT count(DISTINCT fips) FILTER (WHERE {FIPS}) AS counties, CAST(sum(coalesce(out, 0)) FILTER (WHERE {FIPS}) AS BIGINT) AS total, count(*) FILTER (WHERE NOT {FIPS}) AS dropped, count(*) FILTER (WHERE fips IN ('00009', '00013')) AS legacy FROM outages", "outages"))
def outage_quality(spark, sf_dir):
    rows, good = view(spark, sf_dir, "outages"), F.col("fips").rlike(r"^\d{5}$")
    return rows.agg(F.count_distinct(F.when(good, F.col("fips"))).alias("counties"), F.sum(F.when(good, F.coalesce("out", F.lit(0)))).alias("total"), F.count_if(~good).alias("dropped"), F.count_if(F.col("fips").isin("00009", "00013")).alias("legacy"))


@register("county_left_join", with_views(f"SELECT n_name, lpad(n_nationkey::VARCHAR, 5, '0') AS geoid, out FROM nation LEFT JOIN (SELECT fips, CAST(sum(coalesce(out, 0)) AS BIGINT) AS out FROM outages WHERE {FIPS} AND fips > '00004' GROUP BY fips) ON lpad(n_nationkey::VARCHAR, 5, '0') = fips", "outages"))
def county_left_join(spark, sf_dir):
    out = outage_rows(spark, sf_dir).where("fips > '00004'").groupBy(F.col("fips").alias("geoid")).agg(F.sum(F.coalesce("out", F.lit(0))).alias("out"))
    return table(spark, sf_dir, "nation").select("n_name", F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("geoid")).join(out, "geoid", "left")


ALLOWED = ("click", "error", "purchase")


@register("alert_curate", with_views("SELECT event, count(*) AS kept FROM alerts WHERE event IN ('click', 'error', 'purchase') GROUP BY event", "alerts"))
def alert_curate(spark, sf_dir):
    return view(spark, sf_dir, "alerts").where(F.col("event").isin(*ALLOWED)).groupBy("event").agg(F.count("*").alias("kept"))


@register("alert_excluded", with_views("SELECT event, count(*) AS n FROM alerts WHERE event NOT IN ('click', 'error', 'purchase') GROUP BY event", "alerts"))
def alert_excluded(spark, sf_dir):
    return view(spark, sf_dir, "alerts").where(~F.col("event").isin(*ALLOWED)).groupBy("event").agg(F.count("*").alias("n"))


RANK = "CASE severity WHEN 'Extreme' THEN 4 WHEN 'Severe' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Minor' THEN 1 ELSE 0 END"
KEYED = "SELECT * FROM (SELECT id, severity, ends, zone FROM alerts UNION ALL SELECT id, severity, ends, (zone + 1) % 25 FROM alerts WHERE id % 3 = 0)"


def keyed_alerts(spark, sf_dir):
    alerts = view(spark, sf_dir, "alerts").select("id", "severity", "ends", "zone")
    zones = F.when(F.col("id") % 3 == 0, F.array("zone", (F.col("zone") + 1) % 25)).otherwise(F.array("zone"))
    return alerts.select("id", "severity", "ends", F.explode(zones).alias("zone"))


@register("zone_winner", with_views(f"SELECT zone, id, severity, ends, count(*) OVER (PARTITION BY zone) > 1 AS multi FROM ({KEYED}) QUALIFY row_number() OVER (PARTITION BY zone ORDER BY {RANK} DESC, ends ASC NULLS LAST, id) = 1", "alerts"))
def zone_winner(spark, sf_dir):
    return relational.winners(keyed_alerts(spark, sf_dir), "zone", "severity", "ends", "id")


@register("zone_list", with_views(f"SELECT zone, id, severity, ends FROM ({KEYED}) ORDER BY zone, {RANK} DESC, ends ASC NULLS LAST, id", "alerts"))
def zone_list(spark, sf_dir):
    return relational.in_alert_order(keyed_alerts(spark, sf_dir), "zone", "severity", "ends", "id").select("zone", "id", "severity", "ends")


@register("expiry_prune", with_views("SELECT id FROM alerts WHERE coalesce(coalesce(ends, expires) >= 50000, true)", "alerts"))
def expiry_prune(spark, sf_dir):
    return view(spark, sf_dir, "alerts").where(feeds.not_expired(F.col("ends"), F.col("expires"), F.lit(50000))).select("id")


FEED = "CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'alerts' WHEN 1 THEN 'wildfire' WHEN 2 THEN 'outages' ELSE 'radar' END"


@register("monotonic_latest", f"SELECT {FEED} AS feed, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1".replace("arg_max(event_id, (ts, event_id))", "arg_max(event_id, ts)"))
def monotonic_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(f"{FEED} AS feed", "ts", "event_id")
    return feeds.newest(rows, "feed", "ts")


@register("staleness_gate", f"SELECT feed, t AS ts, CASE feed WHEN 'alerts' THEN epoch_us(TIMESTAMP '2024-01-20') - epoch_us(t) > 3 * 3600000000 WHEN 'wildfire' THEN epoch_us(TIMESTAMP '2024-01-20') - epoch_us(t) > 6 * 3600000000 WHEN 'outages' THEN epoch_us(TIMESTAMP '2024-01-20') - epoch_us(t) > 6 * 3600000000 ELSE false END AS stale FROM (SELECT {FEED} AS feed, max(ts) AS t FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)")
def staleness_gate(spark, sf_dir):
    newest = table(spark, sf_dir, "events").where("ts < timestamp_ntz '2024-01-20'").groupBy(F.expr(f"{FEED} AS feed")).agg(F.max("ts").alias("ts"))
    return newest.withColumn("stale", feeds.stale(F.col("feed"), F.col("ts").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")))


STATUS_ROWS = [("alerts", "ok"), ("wildfire", "failed"), ("outages", "fallback-1d"), ("radar", "degraded")]
STATUS_SQL = "(VALUES ('alerts', 'ok'), ('wildfire', 'failed'), ('outages', 'fallback-1d'), ('radar', 'degraded')) AS s(feed, status)"


@register("carry_forward", f"WITH e AS (SELECT {FEED} AS feed, event_id FROM events) SELECT e.feed, e.event_id FROM e JOIN {STATUS_SQL} USING (feed) WHERE (event_id % 2 = 1 AND (status = 'ok' OR status LIKE 'fallback%')) OR (event_id % 2 = 0 AND NOT (status = 'ok' OR status LIKE 'fallback%'))")
def carry_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(f"{FEED} AS feed", "event_id")
    return feeds.carry_forward(rows.where("event_id % 2 = 1"), rows.where("event_id % 2 = 0"), spark.createDataFrame(STATUS_ROWS, "feed string, status string"), "feed")


@register("feed_last_ok", f"SELECT feed, CASE WHEN status = 'ok' OR status LIKE 'fallback%' THEN 999999 ELSE was END AS last_ok FROM {STATUS_SQL} LEFT JOIN (SELECT {FEED} AS feed, max(event_id) AS was FROM events WHERE event_id % 7 = 0 GROUP BY 1) USING (feed)")
def feed_last_ok(spark, sf_dir):
    before = table(spark, sf_dir, "events").where("event_id % 7 = 0").groupBy(F.expr(f"{FEED} AS feed")).agg(F.max("event_id").alias("last_ok"))
    return feeds.last_ok(spark.createDataFrame(STATUS_ROWS, "feed string, status string"), before, "feed", F.lit(999999).cast("long"))


@register("dropped_keys", "SELECT DISTINCT user_id, 'dropped' AS change FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 1) UNION ALL SELECT DISTINCT user_id, 'added' FROM events WHERE event_id % 2 = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0)")
def dropped_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id")
    return relational.keyed_difference(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id")


@register("year_playback", with_views("SELECT y AS year, count(*) AS alive FROM generators, range(1995, 2005) AS r(y) WHERE coalesce(op_year, 0) <= y AND y < CASE WHEN coalesce(retirement_year, 0) <= 0 THEN 9999 ELSE retirement_year END GROUP BY y".replace("y AS year", "CAST(y AS INT) AS year"), "generators"))
def year_playback(spark, sf_dir):
    rows = view(spark, sf_dir, "generators").groupBy("op_year", "retirement_year").agg(F.count("*").alias("n"))
    years = rows.withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2004))))
    return years.where(numeric.alive(F.col("year"), F.col("op_year"), F.col("retirement_year"))).groupBy("year").agg(F.sum("n").alias("alive"))


@register("search_top10", "SELECT source, priority, name FROM (SELECT DISTINCT 'customers' AS source, 1 AS priority, c_name AS name FROM customer WHERE contains(lower(c_mktsegment), 'auto') UNION ALL SELECT DISTINCT 'parts', 2, p_name FROM part WHERE contains(lower(p_name), 'auto') OR contains(lower(p_type), 'auto')) ORDER BY priority, name, source LIMIT 10")
def search_top10(spark, sf_dir):
    return relational.search([("customers", 1, table(spark, sf_dir, "customer"), "c_name", ["c_mktsegment"]), ("parts", 2, table(spark, sf_dir, "part"), "p_name", ["p_name", "p_type"])], " AUTO ")


@register("search_fields", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')")
def search_fields(spark, sf_dir):
    return table(spark, sf_dir, "part").where(filters.has_text(["p_name", "p_brand"], "Ring")).select("p_partkey")


@register("assertions", with_views("SELECT c AS check, n AS failures, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS severity FROM (SELECT count(*) FILTER (WHERE voltage IS NULL) AS has_voltage, count(*) FILTER (WHERE NOT size > 0) AS positive_size FROM tags) UNPIVOT (n FOR c IN (has_voltage, positive_size))", "tags"))
def assertions(spark, sf_dir):
    return relational.assertions(view(spark, sf_dir, "tags"), {"has_voltage": F.col("voltage").isNotNull(), "positive_size": F.col("size") > 0})


@register("cycle_select", "SELECT user_id % 12 AS cycle, count(DISTINCT event_type) = 3 AS complete FROM events WHERE event_type IN ('click', 'error', 'purchase') AND NOT (user_id % 12 = 11 AND event_type = 'error') GROUP BY 1 ORDER BY complete DESC, cycle DESC LIMIT 1")
def cycle_select(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("user_id % 12 AS cycle", "event_type").where("NOT (cycle = 11 AND event_type = 'error')")
    return relational.complete_or_newest(rows, "cycle", "event_type", ALLOWED)


@register("byte_ranges", "SELECT event_id, event_id * 17 AS first, lead(event_id * 17) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS last FROM events")
def byte_ranges(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_id * 17 AS first")
    return rows.select("event_id", "first", (F.lead("first").over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("last"))


@register("tumbling_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    from voltspan.streaming.snapshots import tumbling_counts as counts

    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return counts(rows, "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("membership_buckets", with_views("SELECT bucket, count(*) AS n FROM (SELECT unnest(string_split(CASE WHEN id % 3 = 0 THEN brand || ', ' || type ELSE type END, ', ')) AS bucket FROM tags) GROUP BY bucket", "tags"))
def membership_buckets(spark, sf_dir):
    value = F.when(F.col("id") % 3 == 0, F.concat_ws(", ", "brand", "type")).otherwise(F.col("type"))
    return view(spark, sf_dir, "tags").select(F.explode(F.split(value, ", ")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@register("links_scraped", "SELECT page_id, nullif(regexp_extract(html, 'href=\"(https?://[^\"]*)\"', 1), '') AS link FROM pages")
def links_scraped(spark, sf_dir):
    from voltspan.sources.readers import links_in

    return links_in(table(spark, sf_dir, "pages"), "html", 'https?://[^"]*').select("page_id", "link")
