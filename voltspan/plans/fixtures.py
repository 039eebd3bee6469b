"""Infrastructure-shaped views over the test tables, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltspan.tables import table

#: name: (table, expressions)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "points_a": ("customer", ("c_custkey AS id", "-100 + ((c_custkey * 7919) % 2000) / 1e3 AS lon", "40 + ((c_custkey * 104729) % 1000) / 1e3 AS lat", "c_mktsegment AS kind", "CAST(c_custkey % 300 AS INT) AS sqft")),
    "points_b": ("part", ("p_partkey AS id", "-100 + ((p_partkey * 6133) % 2000) / 1e3 AS lon", "40 + ((p_partkey * 92821) % 1000) / 1e3 AS lat", "p_type AS kind", "CASE WHEN p_size < 25 THEN p_size * 1000 END AS sqft")),
    "plants": ("orders", ("o_orderkey AS plant_code", "'Plant ' || CAST(o_orderkey AS STRING) AS plant_name", "o_orderpriority AS sector", "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'BA' || CAST(o_custkey % 7 AS STRING) END AS authority")),
    "generators": (
        "lineitem",
        (
            "l_orderkey AS plant_code", "l_linenumber AS generator_id", "l_extendedprice / 1e2 AS nameplate_mw", "CAST(year(l_shipdate) AS INT) AS op_year", "CAST(CASE WHEN l_returnflag = 'R' THEN year(l_shipdate) + 3 WHEN l_returnflag = 'A' THEN 0 END AS INT) AS retirement_year",
            "CASE l_suppkey % 6 WHEN 0 THEN 'WAT' WHEN 1 THEN 'NG' WHEN 2 THEN 'SUN' WHEN 3 THEN 'WND' WHEN 4 THEN 'ZZZ' END AS energy_source", "CASE WHEN l_partkey % 5 = 0 THEN 'PS' ELSE 'HY' END AS prime_mover",
            "CASE WHEN l_linestatus = 'O' THEN 'OP' WHEN l_returnflag = 'A' THEN 'SB' ELSE 'RE' END AS status", "l_partkey AS part", "l_suppkey AS supp",
        ),
    ),
    "tags": (
        "part",
        (
            "p_partkey AS id",
            "CASE p_partkey % 7 WHEN 0 THEN CAST((p_partkey % 800) * 1000 AS STRING) WHEN 1 THEN CAST(p_size * 10000 AS STRING) || ';' || CAST(p_partkey % 500 AS STRING) WHEN 2 THEN '138' WHEN 3 THEN 'high' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE '115000; 230000;abc' END AS voltage",
            "CASE p_partkey % 9 WHEN 0 THEN CAST(p_size AS STRING) || ' MW' WHEN 1 THEN CAST(p_size AS STRING) || ',500 kW' WHEN 2 THEN CAST(p_size AS STRING) || '.5 GW' WHEN 3 THEN 'yes' WHEN 4 THEN ' no ' WHEN 5 THEN NULL WHEN 6 THEN CAST(p_size * 1000 AS STRING) || 'w' WHEN 7 THEN '1.2.3 MW' ELSE CAST(p_size AS STRING) END AS output",
            "CASE p_partkey % 8 WHEN 0 THEN ' Solar;battery' WHEN 1 THEN 'WIND' WHEN 2 THEN 'petroleum; gas' WHEN 3 THEN 'water' WHEN 4 THEN 'storage' WHEN 5 THEN NULL WHEN 6 THEN 'tidal' ELSE 'Natural_Gas' END AS source",
            "CASE p_partkey % 9 WHEN 0 THEN 'Gold Ore' WHEN 1 THEN 'Construction Sand and Gravel' WHEN 2 THEN 'Coal (Bituminous)' WHEN 3 THEN 'Lead-Zinc Ore' WHEN 4 THEN 'Gemstones' WHEN 5 THEN NULL WHEN 6 THEN 'Iron Ore' WHEN 7 THEN 'Lithium' ELSE 'Alumina' END AS sic",
            "'\"name\"=>\"' || p_name || '\",\"operator\"=>\" ' || p_brand || '\",\"location\"=>\"' || lower(p_type) || '\"' AS other_tags",
            "CASE p_partkey % 5 WHEN 0 THEN 'TAP' || CAST(p_partkey AS STRING) WHEN 1 THEN 'O''NEIL ' || upper(p_name) || '-2ND' WHEN 2 THEN 'UNKNOWN' || CAST(p_partkey AS STRING) WHEN 3 THEN upper(p_name) || ' ' || CAST(p_size * 10 AS STRING) || ' kV line' ELSE CAST(p_partkey AS STRING) END AS name",
            "CASE p_partkey % 3 WHEN 0 THEN 'WESTERN ' || upper(p_name) || ' COUNCIL (WE)' WHEN 1 THEN 'RELIABILITY ' || upper(p_name) || ' (SERC, RE)' ELSE p_name || ' without code' END AS region",
            "p_size AS size", "p_brand AS brand", "p_type AS type", "CASE WHEN p_size % 9 = 0 THEN -999999 ELSE p_retailprice END AS price",
        ),
    ),
    "outages": (
        "orders",
        (
            "lpad(CAST(o_custkey % 25 AS STRING), CASE WHEN o_orderkey % 41 = 0 THEN 4 ELSE 5 END, '0') AS fips", "CASE o_custkey % 4 WHEN 0 THEN 'North Power,' || CAST(o_custkey % 3 AS STRING) WHEN 1 THEN 'City Light' WHEN 2 THEN 'Co-op' ELSE 'Grid' END AS utility",
            "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 1000 END AS out", "CAST(o_orderdate AS STRING) AS since", "o_orderkey AS id",
        ),
    ),
    "alerts": (
        "events",
        (
            "event_id AS id", "event_type AS event", "CASE event_id % 5 WHEN 0 THEN 'Extreme' WHEN 1 THEN 'Severe' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Minor' ELSE 'Unknown' END AS severity",
            "CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST((event_id * 7919) % 100000 AS BIGINT) END AS ends", "CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST((event_id * 104729) % 100000 AS BIGINT) END AS expires", "CAST(user_id % 25 AS INT) AS zone", "ts", "value", "user_id",
        ),
    ),
    "cells": ("part", ("CAST(floor(p_partkey / 50e0) AS BIGINT) AS row", "p_partkey % 50 AS col", "CASE WHEN p_size > 1 THEN p_retailprice END AS value")),
    "later_cells": ("part", ("CAST(floor(p_partkey / 50e0) AS BIGINT) AS row", "p_partkey % 50 AS col", "CASE WHEN p_size % 3 = 0 THEN p_size * 1e0 END AS value")),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, expressions = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*expressions)


def with_views(sql: str, *names: str) -> str:
    """The SQL with these views before it."""
    ctes = ", ".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names)
    return f"WITH {ctes}{',' if sql.lstrip().upper().startswith('WITH ') else ''} {sql.lstrip()[5:] if sql.lstrip().upper().startswith('WITH ') else sql}"
