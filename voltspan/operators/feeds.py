"""Live feeds as snapshots: staleness, expiry, carry-forward, status. A snapshot replaces the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours after which a feed's snapshot is stale.
MAX_AGE_HOURS = {"alerts": 3, "wildfire": 6, "outages": 6, "weather": 12}


def stale(feed: Column, generated: Column, now: Column) -> Column:
    """Whether a snapshot is older than its feed allows; an unknown feed never is."""
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in MAX_AGE_HOURS.items() for x in pair)), feed)
    return F.coalesce((F.unix_micros(now) - F.unix_micros(generated)) / F.lit(3.6e9) > limit, F.lit(False))


def not_expired(ends: Column, expires: Column, now: Column) -> Column:
    """Alerts still on: by their end, else their expiry; neither keeps them."""
    return F.coalesce(F.coalesce(ends, expires) >= now, F.lit(True))


def newest(snapshots: DataFrame, feed: str, generated: str) -> DataFrame:
    """The newest snapshot of each feed, whole row; an older one that comes later doesn't replace it."""
    rest = [c for c in snapshots.columns if c != feed]
    return snapshots.groupBy(feed).agg(F.max_by(F.struct(*rest), generated).alias("_s")).select(feed, "_s.*")


def carry_forward(new: DataFrame, before: DataFrame, status: DataFrame, feed: str) -> DataFrame:
    """The new rows of feeds whose status is `ok` or a fallback, the last good rows of the others."""
    good = status.where((F.col("status") == "ok") | F.col("status").startswith("fallback")).select(feed)
    return new.join(good, feed, "left_semi").unionByName(before.join(good, feed, "left_anti"))


def last_ok(status: DataFrame, before: DataFrame, feed: str, now: Column) -> DataFrame:
    """(feed, last_ok): now for feeds that are good, else what it was."""
    joined = status.join(before.select(feed, F.col("last_ok").alias("_was")), feed, "left")
    good = (F.col("status") == "ok") | F.col("status").startswith("fallback")
    return joined.select(feed, F.when(good, now).otherwise(F.col("_was")).alias("last_ok"))


def freshness(age_hours: Column, limit: Column) -> Column:
    """ok to half the limit, warn to the limit, fail beyond; skip if there is no snapshot."""
    return F.when(age_hours.isNull(), "skip").when(age_hours > limit, "fail").when(age_hours > limit / 2, "warn").otherwise("ok")


def issue(status: Column, hours: Column) -> Column:
    """What is wrong with a feed, in words: down for so many hours, or data some days old (status `fallback-Nd`); another status but ok is said as it is."""
    days = F.regexp_extract(status, "fallback-([0-9]+)d", 1)
    return F.when(status == "failed", F.concat(F.lit("down "), hours.cast("string"), F.lit("h"))).when(days != "", F.concat(F.lit("data "), days, F.lit("d old"))).when(status != "ok", status)
