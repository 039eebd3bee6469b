"""Readers of the formats that public infrastructure data come in, all through Spark's own sources."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltspan.functions.text import leading_number

#: Column names for coordinates and names, in order of preference.
LAT_NAMES, LON_NAMES, NAME_NAMES = ("lat", "latitude", "y"), ("lon", "lng", "long", "longitude", "x"), ("name", "title", "label")


def guess_column(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """The first of the names that a column has, without case and blanks."""
    have = {c.strip().lower(): c for c in reversed(columns)}
    return next((have[n] for n in names if n in have), None)


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", comment: str | None = None, header: bool = True) -> DataFrame:
    """All columns as text; quoted fields may hold separators, line ends and doubled quotes."""
    options = {"sep": sep, "encoding": encoding, "header": header, "multiLine": True, "quote": '"', "escape": '"'} | ({"comment": comment} if comment else {})
    return spark.read.options(**options).csv(path)


def points_of_csv(df: DataFrame, delimiter: str = " ") -> DataFrame:
    """(lon, lat, name and the rest) of a table of text: rows without a place, or off the globe, are left out."""
    lat, lon, name = (guess_column(df.columns, n) for n in (LAT_NAMES, LON_NAMES, NAME_NAMES))
    if lat is None or lon is None:
        raise ValueError("no columns of latitude and longitude")
    placed = df.withColumns({"_lat": leading_number(F.col(lat)), "_lon": leading_number(F.col(lon))}).where(F.col("_lat").between(-90, 90) & F.col("_lon").between(-180, 180))
    return placed.select(F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), (F.col(name) if name else F.lit(None).cast("string")).alias("name"), *(c for c in df.columns if c not in (lat, lon, name)))


def read_geojson_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Features (type, properties, geometry type and coordinates as JSON), and the lines that aren't JSON."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("v", F.try_parse_json(F.regexp_replace("value", "^\\u001e", "")))
    get = lambda p, kind="string": F.try_variant_get("v", p, kind)
    features = lines.where(F.col("v").isNotNull()).select(get("$.geometry.type").alias("geometry_type"), F.to_json(get("$.geometry.coordinates", "variant")).alias("coordinates"), get("$.properties", "map<string,string>").alias("properties"))
    return features, lines.where(F.col("v").isNull()).select("value")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """The features of a collection, gzipped or not."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    each = whole.select(F.explode(F.try_variant_get("v", "$.features", "array<variant>")).alias("f"))
    get = lambda p, kind="string": F.try_variant_get("f", p, kind)
    return each.select(get("$.geometry.type").alias("geometry_type"), F.to_json(get("$.geometry.coordinates", "variant")).alias("coordinates"), get("$.properties", "map<string,string>").alias("properties"))


def read_kml_points(spark: SparkSession, path: str) -> DataFrame:
    """(name, lon, lat) of the placemarks of a KML file that have a point."""
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema("name string, Point struct<coordinates:string>").load(path)
    parts = F.split(F.trim("Point.coordinates"), ",")
    return marks.where(F.col("Point").isNotNull()).select("name", F.get(parts, F.lit(0)).try_cast("double").alias("lon"), F.get(parts, F.lit(1)).try_cast("double").alias("lat"))


def links_in(pages: DataFrame, html: str, pattern: str) -> DataFrame:
    """The first link of each page that fits a pattern."""
    return pages.withColumn("link", F.nullif(F.regexp_extract(html, f'href="({pattern})"', 1), F.lit("")))


def safe_name(column: str) -> str:
    """A column name in small letters and underscores."""
    return re.sub(r"[^0-9a-z]+", "_", column.strip().lower()).strip("_")
