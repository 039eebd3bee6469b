"""Spatial joins by grid cells: within a radius, nearest, deduplication, clusters.

Points are put into cells at least as large as the radius: bands of latitude, each with whole columns around the globe, so that the
antimeridian and high latitudes are nothing special. One side is copied to the cells that its radius reaches, and the join is an
equi-join on the cell with an exact distance test. Nothing is collected and no cross join is made; a crowded cell is split by
Spark's skew handling.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltspan.functions.geo import R_CHORD, chord_of, haversine, pixel, unit_vector

#: Cells are this much larger than the radius, so that rounding never loses a neighbour.
MARGIN = 1.001


def _columns(row: Column, degrees: float) -> Column:
    """The columns of a latitude band: as many as are no narrower than the radius at the band's end nearer to a pole; one around a pole."""
    far = F.greatest(F.abs(row * F.lit(degrees)), F.abs((row + 1) * F.lit(degrees)))
    return F.when(far >= 89.9, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.cos(F.radians(far)) * F.lit(360 / degrees)))).cast("long")


def _east() -> Column:
    """Degrees east of the antimeridian, below 360."""
    return F.pmod(F.col("lon") + 180, F.lit(360.0))


def _degrees(metres: float) -> float:
    return metres * MARGIN / R_CHORD * 180 / math.pi


def in_cells(df: DataFrame, metres: float) -> DataFrame:
    """Adds the cell (_row, _col) of each point (lon, lat)."""
    size = _degrees(metres)
    row = F.floor(F.col("lat") / F.lit(size))
    return df.withColumn("_row", row).withColumn("_n", _columns(F.col("_row"), size)).withColumn("_col", F.least(F.floor(_east() * F.col("_n") / 360), F.col("_n") - 1)).drop("_n")


def in_reach(df: DataFrame, metres: float) -> DataFrame:
    """Copies each point to the cells (_row, _col) that hold all points nearer than `metres`."""
    size = _degrees(metres)
    share = F.lit(math.sin(math.radians(size))) / F.cos(F.radians("lat"))
    wide = F.when((F.abs("lat") + size >= 89.9) | (share >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), share))) * MARGIN)
    band = F.floor(F.col("lat") / F.lit(size))
    rows = df.withColumn("_wide", wide).withColumn("_row", F.explode(F.array(band - 1, band, band + 1))).withColumn("_n", _columns(F.col("_row"), size))
    first = F.floor((_east() - F.col("_wide")) * F.col("_n") / 360)
    last = F.least(F.floor((_east() + F.col("_wide")) * F.col("_n") / 360), first + F.col("_n") - 1)
    return rows.withColumn("_col", F.explode(F.sequence(first, last))).withColumn("_col", F.pmod("_col", "_n")).drop("_wide", "_n")


def _places(df: DataFrame, *more: Column) -> DataFrame:
    """Each place (lon, lat) once, with aggregates of its points."""
    return df.where("lon IS NOT NULL AND lat IS NOT NULL").groupBy("lon", "lat").agg(*more) if more else df.select("lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL").distinct()


def _near_places(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Pairs of places (_alon, _alat, and of the right _blon, _blat and its other columns) nearer than `metres`, and how far. Merge joins: Spark takes copies in
    reach for no more than the points, and would broadcast them."""
    a = in_cells(left, metres).withColumnsRenamed({"lon": "_alon", "lat": "_alat"})
    b = in_reach(right, metres).withColumnsRenamed({"lon": "_blon", "lat": "_blat"})
    pairs = a.join(b.hint("merge"), ["_row", "_col"]).drop("_row", "_col").withColumn("metres", haversine(F.col("_alon"), F.col("_alat"), F.col("_blon"), F.col("_blat")))
    return pairs.where(F.col("metres") < metres)


def _at(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({"lon": f"{prefix}lon", "lat": f"{prefix}lat"})


def within_radius(left: DataFrame, right: DataFrame, metres: float, left_key: str, right_key: str) -> DataFrame:
    """(left key, right key, metres) of all pairs of points (lon, lat) nearer than `metres`, by great-circle distance. Distances are of places; points of a place
    join its pairs."""
    near = _near_places(_places(left), _places(right), metres)
    a = _at(left.select(F.col(left_key).alias("_a"), "lon", "lat"), "_a")
    b = _at(right.select(F.col(right_key).alias("_b"), "lon", "lat"), "_b")
    pairs = near.join(a.hint("merge"), ["_alon", "_alat"]).join(b.hint("merge"), ["_blon", "_blat"])
    return pairs.select(F.col("_a").alias(left_key), F.col("_b").alias(right_key), "metres")


def nearest_within(left: DataFrame, right: DataFrame, metres: float, left_key: str, right_key: str) -> DataFrame:
    """(left key, right key, metres) of the nearest right point of each left point within a radius, ties by key. Of the right points of a place only that with the
    least key can be it, and left points of a place share theirs, so no pair of points is made."""
    near = _near_places(_places(left), _places(right, F.min(F.struct(F.col(right_key).alias("k")))["k"].alias("_b")), metres)
    best = near.groupBy("_alon", "_alat").agg(F.min(F.struct("metres", "_b")).alias("_n"))
    a = _at(left.select(F.col(left_key).alias("_a"), "lon", "lat"), "_a")
    found = a.join(best.hint("merge"), ["_alon", "_alat"]).select("_a", "_n.*")
    return found.groupBy("_a").agg(F.min(F.struct("metres", "_b")).alias("_n")).select(F.col("_a").alias(left_key), F.col("_n._b").alias(right_key), "_n.metres")


def without_neighbours(df: DataFrame, others: DataFrame, metres: float) -> DataFrame:
    """The points with none of the others nearer than `metres`, compared by chords; no pair of points is made, and a place is compared once."""
    near = in_reach(_places(others), metres).select(F.col("_row").alias("_r"), F.col("_col").alias("_c"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    here, there = unit_vector(F.col("lon"), F.col("lat")), unit_vector(F.col("_lon"), F.col("_lat"))
    square = sum(((a - b) * (a - b) for a, b in zip(here, there, strict=True)), F.lit(0.0))
    on = (F.col("_row") == F.col("_r")) & (F.col("_col") == F.col("_c")) & (square < chord_of(metres) ** 2)
    taken = in_cells(_places(df), metres).join(near.hint("merge"), on, "left_semi").select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    return df.join(taken.hint("merge"), (F.col("lon") == F.col("_lon")) & (F.col("lat") == F.col("_lat")), "left_anti")


def enrich_nearest(df: DataFrame, facts: DataFrame, key: str, fact_key: str, field: str, metres: float) -> DataFrame:
    """Fills a null field from the row with the same key, and where that gives nothing from the nearest point within a radius."""
    same = facts.groupBy(F.col(fact_key).alias(key)).agg(F.min(field).alias("_own"))
    first = df.drop(field).join(same, key, "left").withColumnRenamed("_own", field) if field not in df.columns else df.join(same, key, "left").withColumn(field, F.coalesce(field, "_own")).drop("_own")
    known = facts.where(F.col(field).isNotNull()).withColumnRenamed(fact_key, "_fact")
    near = nearest_within(first.where(F.col(field).isNull()).select(key, "lon", "lat"), known, metres, key, "_fact")
    found = near.join(known.select("_fact", F.col(field).alias("_near")), "_fact").select(key, "_near")
    return first.join(found, key, "left").withColumn(field, F.coalesce(field, "_near")).drop("_near")


def clusters(df: DataFrame, zoom: int, radius: int = 40, amount: str | None = None) -> DataFrame:
    """Points by square cells of `radius` pixels at a zoom: number, sum of an amount, mean place."""
    x, y = pixel(F.col("lon"), F.col("lat"), zoom)
    cells = df.groupBy(F.floor(x / radius).alias("cell_x"), F.floor(y / radius).alias("cell_y"))
    return cells.agg(F.count("*").alias("point_count"), *([F.sum(amount).alias("amount_sum")] if amount else []), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
