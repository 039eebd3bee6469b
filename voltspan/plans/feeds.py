"""Queries of live feeds: as streams, as graphs of variables, as published versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltspan.operators import variables
from voltspan.operators.variables import Variable
from voltspan.plans.fixtures import view, with_views
from voltspan.plans.registry import register
from voltspan.sources import publication
from voltspan.streaming import live
from voltspan.tables import scratch, table

#: A feed for each type of event: a snapshot a day, of the newest event of each user; some days fail and publish no rows.
_FAILED = "(day(ts) + length(event_type)) % 5 = 0"
_ENDS = "CASE WHEN event_id % 4 = 0 THEN ts + make_interval(0, 0, 0, 0, CAST(event_id % 300 AS INT)) END"


@register(
    "live_state",
    """WITH rows AS (SELECT event_type AS feed, CAST(user_id AS VARCHAR) AS key, date_trunc('day', ts) AS generated, ts, event_id, value, (day(ts) + length(event_type)) % 5 = 0 AS failed, CASE WHEN event_id % 4 = 0 THEN ts + to_hours(CAST(event_id % 300 AS INT)) END AS ends FROM events),
    feeds AS (SELECT feed, max(CASE WHEN NOT failed THEN generated END) AS good, max(CASE WHEN failed THEN generated END) AS bad FROM rows GROUP BY feed),
    live AS (SELECT r.feed, r.key, r.generated, max(r.event_id) AS event_id FROM rows r JOIN feeds f ON r.feed = f.feed WHERE NOT r.failed AND r.generated = f.good GROUP BY ALL)
    SELECT l.feed, l.key, l.event_id, r.value, coalesce(f.bad > f.good, false) AS carried FROM live l JOIN feeds f ON l.feed = f.feed JOIN rows r ON r.event_id = l.event_id
    WHERE r.ends IS NULL OR epoch_ms(r.ends) > (SELECT epoch_ms(max(ts)) FROM events)""",
)
def live_state(spark, sf_dir):
    """Streams all events through the keyed state; a row for each key that is live at the end."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")  # a stream takes folders and patterns, not the path of a file
    events = events.withColumn("ts", F.col("ts").cast("timestamp")).selectExpr("event_type AS feed", "date_trunc('day', ts) AS generated", "ts AS pulled", f"{_FAILED} AS failed", "CAST(user_id AS STRING) AS key", f"{_ENDS} AS ends", "event_id", "value")
    polls = events.withColumns({"key": F.when(~F.col("failed"), F.col("key")), "status": F.when(F.col("failed"), live.FAILED).otherwise(live.GOOD)}).drop("failed")
    folder = scratch(spark)
    live.run_live(live.live_changes(polls, ["event_id", "value"], buckets=4), f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    return live.live_rows(spark, f"{folder}/changes").select("feed", "key", "event_id", "value", F.col("carried"))


#: Derived from the readings that types of events stand for; `view` can't be had on every seventh day.
VARIABLES = (
    Variable("feels", ("temperature", "wind"), lambda t, w: t - w / 10),
    Variable("wind", ("u", "v"), lambda u, v: F.sqrt(u * u + v * v)),
    Variable("spread", ("temperature", "dew"), lambda t, d: t - d),
    Variable("hot", ("spread", "temperature"), lambda s, t: F.when((s > 5) & (t > 20), 1.0).otherwise(0.0)),
)
RAWS = {"click": "u", "view": "v", "purchase": "temperature", "signup": "dew"}
_RAWS_SQL = ", ".join(f"max(value) FILTER (event_type = '{e}') AS {r}" for e, r in RAWS.items())


@register(
    "variable_graph",
    f"""WITH cells AS (SELECT day(ts)::INT AS step, CAST(user_id % 10 AS INT) AS cell, {_RAWS_SQL} FROM events GROUP BY ALL),
    winds AS (SELECT *, sqrt(u * u + v * v) AS wind, temperature - dew AS spread, step % 7 = 0 AS bad FROM cells)
    SELECT step, cell, 'wind' AS variable, round(CASE WHEN NOT bad THEN wind END, 6) AS value, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS status FROM winds
    UNION ALL SELECT step, cell, 'feels', round(CASE WHEN NOT bad THEN temperature - wind / 10 END, 6), CASE WHEN bad THEN 'failed' ELSE 'ok' END FROM winds
    UNION ALL SELECT step, cell, 'spread', round(spread, 6), 'ok' FROM winds
    UNION ALL SELECT step, cell, 'hot', CASE WHEN spread > 5 AND temperature > 20 THEN 1e0 ELSE 0e0 END, 'ok' FROM winds""",
)
def variable_graph(spark, sf_dir):
    """Four variables, two of them of others, over one scan of the events; one reading fails on some days."""
    events = table(spark, sf_dir, "events").selectExpr("CAST(day(ts) AS INT) AS step", "CAST(user_id % 10 AS INT) AS cell", "event_type", "value")
    named = events.withColumn("raw", F.create_map(*(F.lit(x) for pair in RAWS.items() for x in pair))[F.col("event_type")])
    cells = variables.readings(named, ["step", "cell"], "raw", "value", list(RAWS.values()))
    failed = events.where("step % 7 = 0").select("step", F.lit("v").alias("raw")).distinct()
    return variables.evaluate(cells, ["step", "cell"], VARIABLES, "step", failed).withColumn("value", F.round("value", 6))


@register("stats_envelope", with_views("SELECT count(*) AS rows, count(*) FILTER (length(fips) <> 5) AS bad_fips, count(*) FILTER (out >= 500) AS large, count(*) FILTER (out IS NULL) AS unknown, (SELECT count(*) FROM outages WHERE fips <= '00012') AS published FROM outages", "outages"))
def stats_envelope(spark, sf_dir):
    """The statistics of outages as they were written, with the rows of a second publication read back."""
    rows, folder = view(spark, sf_dir, "outages"), scratch(spark)
    stats = publication.publish(rows, folder, {"bad_fips": F.length("fips") != 5, "large": F.col("out") >= 500, "unknown": F.col("out").isNull()})
    publication.publish(rows.where("fips <= '00012'"), folder)
    return publication.read_live(spark, folder).agg(F.count("*").alias("published")).select(*(F.lit(v).cast("long").alias(k) for k, v in stats.items()), "published")
