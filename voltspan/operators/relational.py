"""Relational operators: unions by source, first rows, rollups, winners, keyed differences, search, data-quality checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of severities; others rank 0.
SEVERITY = {"Extreme": 4, "Severe": 3, "Moderate": 2, "Minor": 1}


def union_sources(sources: dict[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """All rows of all sources, each with the name of its source; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(tag, F.lit(name)) for name, df in sources.items()))


def keep_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that are there, found whatever the case, named as wanted."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*(F.col(have[w.lower()]).alias(w) for w in wanted if w.lower() in have))


def require_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Like keep_columns, but fails if one isn't there."""
    missing = [w for w in wanted if w.lower() not in {c.lower() for c in df.columns}]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return keep_columns(df, wanted)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in an order. One pass of partial aggregation: no window sorts the rows of a frequent key."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_first")).select(*keys, "_first.*").select(*df.columns)


def decode(df: DataFrame, code: str, domain: DataFrame, key: str, label: str) -> DataFrame:
    """Replaces codes by their labels; unknown codes stay. The domain is a small table; Spark broadcasts it if it is."""
    names = domain.select(F.col(key).alias("_code"), F.col(label).alias("_label"))
    return df.join(names, F.col(code) == F.col("_code"), "left").withColumn(code, F.coalesce("_label", F.col(code).cast("string"))).drop("_code", "_label")


def top_counts(df: DataFrame, field: str, n: int) -> DataFrame:
    """The n most frequent values that aren't null, ties by value."""
    return df.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("n")).orderBy(F.desc("n"), field).limit(n)


def fill_rates(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row for each field: how many rows have it, and the share in per cent."""
    counted = df.agg(F.count("*").alias("rows"), *(F.count(f).alias(f) for f in fields))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields))
    return counted.select("rows", F.inline(pairs)).select("field", "filled", F.bround(F.lit(100.0) * F.col("filled") / F.nullif("rows", F.lit(0)), 1).alias("percent"))


def nested_rollup(df: DataFrame, outer: str, inner: str, amount: str, start: str) -> DataFrame:
    """For each outer key its sum and count, and a list of the same for each inner key with the earliest start, greatest sum first."""
    each = df.groupBy(outer, inner).agg(F.sum(F.coalesce(F.col(amount), F.lit(0))).alias("out"), F.count("*").alias("n"), F.min(start).alias("since"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("out")).alias("o"), F.col(inner).alias("name"), "out", "n", "since"))), lambda u: F.struct(u["name"].alias("name"), u["out"].alias("out"), u["n"].alias("n"), u["since"].alias("since")))
    return each.groupBy(outer).agg(F.sum("out").alias("out"), F.sum("n").alias("n"), rows.alias("parts"))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair)), severity), F.lit(0))


def winners(alerts: DataFrame, key: str, severity: str, ends: str, tie: str) -> DataFrame:
    """The alert that a key shows: highest severity, then earliest end (none: last), then first; `multi` if it has several."""
    order = F.struct(-severity_rank(F.col(severity)), F.col(ends).isNull(), F.col(ends), F.col(tie))
    rest = [c for c in alerts.columns if c != key]
    return alerts.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_w"), (F.count("*") > 1).alias("multi")).select(key, "_w.*", "multi")


def in_alert_order(alerts: DataFrame, key: str, severity: str, ends: str, tie: str) -> DataFrame:
    """All alerts, those of a key together and in the order of `winners`; sorted by ranges, so that a frequent key isn't one task."""
    return alerts.orderBy(key, -severity_rank(F.col(severity)), F.asc_nulls_last(ends), tie)


def filtered_winners(alerts: DataFrame, active: Sequence[str] | None, group: str, key: str, severity: str, ends: str, tie: str) -> DataFrame:
    """The winners among the alerts of the active groups of a legend (None: all); a key without one isn't painted and has no row."""
    return winners(alerts if active is None else alerts.where(F.col(group).isin(list(active))), key, severity, ends, tie)


def drop_columns(df: DataFrame, unwanted: Sequence[str]) -> DataFrame:
    """Without these columns, where they are there; names by case."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in set(unwanted)))


def union_layers(layers: dict[str, DataFrame], key: str, fields: Sequence[str], tag: str) -> DataFrame:
    """The rows of several layers with the layer's name in `tag`: whole keys only, and none without a key or a place (lon, lat)."""
    rows = [df.select(F.expr(f"try_cast({key} AS BIGINT)").alias(key), F.lit(name).alias(tag), *fields, "lon", "lat") for name, df in layers.items()]
    return reduce(DataFrame.unionByName, rows).dropna(subset=[key, "lon", "lat"])


def last_attributes(shapes: DataFrame, attributes: DataFrame, key: str, order: str, defaults: dict[str, str]) -> DataFrame:
    """Shapes with the attributes of their key; of several the last in order counts, and a missing one takes its default."""
    last = attributes.groupBy(key).agg(*(F.max_by(F.struct(c), order)[c].alias(c) for c in defaults))
    return shapes.join(last, key, "left").fillna(defaults)


def keyed_difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): keys that came or went between two snapshots."""
    gone = before.select(key).distinct().join(after, key, "left_anti").select(key, F.lit("dropped").alias("change"))
    return gone.unionByName(after.select(key).distinct().join(before, key, "left_anti").select(key, F.lit("added").alias("change")))


def search(sources: list[tuple[str, int, DataFrame, str, list[str]]], query: str, limit: int = 10) -> DataFrame:
    """Up to `limit` hits of (source, priority, table, name field, fields): by priority, one for each source and name."""
    from voltspan.functions.filters import has_text

    hits = [df.where(has_text(fields, query)).select(F.lit(source).alias("source"), F.lit(priority).alias("priority"), F.col(name).alias("name")) for source, priority, df, name, fields in sources]
    return reduce(DataFrame.unionByName, hits).distinct().orderBy("priority", "name", "source").limit(limit)


def assertions(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, failures, severity) of row conditions; a condition that is null fails."""
    counted = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("failures")) for k in checks))
    return counted.select(F.inline(pairs)).withColumn("severity", F.when(F.col("failures") > 0, "FAIL").otherwise("PASS"))


def rows_per_cell(df: DataFrame, cell: Sequence[str], order: Sequence[str | Column], limit: int) -> DataFrame:
    """At most `limit` rows of each cell, by priority: the density drop of map tiles."""
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def complete_or_newest(df: DataFrame, group: str, item: str, needed: Sequence[str]) -> DataFrame:
    """The newest group that has all needed items, else the newest with any: one row (group, complete)."""
    have = df.where(F.col(item).isin(list(needed))).groupBy(group).agg((F.count_distinct(item) == len(needed)).alias("complete"))
    return have.orderBy(F.desc("complete"), F.desc(group)).limit(1)


def transform_all(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(lambda d, step: step(d), steps, df)


def real_dates(df: DataFrame, columns: Sequence[str], least: float = 1e9) -> DataFrame:
    """Columns of epoch milliseconds as times; one without any value above `least` holds something else and becomes null."""
    peak = df.agg(*(F.max(c).alias(c) for c in columns)).first()
    return df.withColumns({c: F.timestamp_millis(F.col(c).cast("long")) if (peak[c] or 0) > least else F.lit(None).cast("timestamp") for c in columns})


def cross_check(expected: DataFrame, present: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """(key, level) of names in either: PASS in both, WARN (strict: FAIL) only expected, FAIL only present."""
    a, b = expected.select(key).distinct().withColumn("_a", F.lit(True)), present.select(key).distinct().withColumn("_b", F.lit(True))
    missing = "FAIL" if strict else "WARN"
    return a.join(b, key, "full").select(key, F.when(F.col("_b").isNull(), missing).when(F.col("_a").isNull(), "FAIL").otherwise("PASS").alias("level"))
