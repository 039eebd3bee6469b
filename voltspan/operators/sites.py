"""Outlines of sites from the places of their members, without gathering a site's members in one row.

A site's points fall into a fixed grid over its extent; of each cell's points the corners of their convex hull are kept, found for shares of
its points first. What reaches the task that draws a site is bounded by the grid, whatever the site has. Cells of which inner points were left
out stay covered when the outline follows its points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from voltspan.functions import hulls
from voltspan.functions.geo import from_mercator, mercator
from voltspan.functions.shapes import outline

#: Cells on a side of a site's grid, and points of a share of one.
GRID, SHARE = 16, 50_000
#: Metres around a single member, around two, and around the outline of more; how closely an outline follows its points.
AROUND_ONE, AROUND_TWO, AROUND_MORE, RATIO = 500.0, 100.0, 10.0, 0.95
_POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def _rows(points: list[dict]) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)


@arrow_udf(_POINTS)
def corners(sets: pa.Array) -> pa.Array:
    """The corners of each set's convex hull; all its points if these are under three."""
    return pa.array([[{"x": float(x), "y": float(y)} for x, y in np.unique(outline(_rows(s)), axis=0)] for s in sets.to_pylist()], _ARROW)


def drawn(ratio: float) -> Column:
    @arrow_udf(_POINTS)
    def draw(members: pa.Array, cells: pa.Array) -> pa.Array:
        out = []
        for n, some in zip(members.to_pylist(), cells.to_pylist(), strict=True):
            sets = [_rows(c["points"]) for c in some]
            points = np.concatenate(sets)
            solid = [outline(s) for s, c in zip(sets, some, strict=True) if c["all"] > len(s) > 2]
            ring = outline(points) if n < 3 else hulls.concave(points, ratio, solid)
            ring = hulls.buffered(ring, AROUND_ONE if n == 1 else AROUND_TWO if n == 2 else AROUND_MORE)
            out.append([{"x": float(x), "y": float(y)} for x, y in ring])
        return pa.array(out, _ARROW)

    return draw


def site_shapes(members: DataFrame, site: str, ratio: float = RATIO) -> DataFrame:
    """(site, members, ring): the outline of each site from its members (lon, lat), as a closed ring (lon, lat).

    One member: a disc of 500 m; two: 100 m around their line; more: 10 m around a hull that follows them, all in Mercator metres. Members
    without a place are left out; a site without any has no row. There may be as many sites as members, so their joins are merges, not broadcasts.
    """
    x, y = mercator(F.col("lon"), F.col("lat"))
    placed = members.select(F.col(site).alias("site"), x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    extent = placed.groupBy("site").agg(F.count("*").alias("members"), *(f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in "xy"))
    place = lambda c: F.least(F.floor((F.col(c) - F.col(f"low_{c}")) / F.greatest(F.col(f"high_{c}") - F.col(f"low_{c}"), F.lit(1e-9)) * GRID), F.lit(GRID - 1))
    dealt = placed.join(extent.hint("merge"), "site").withColumns({"cell": place("x") * GRID + place("y"), "share": F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("members") / SHARE))})
    point = F.struct("x", "y")
    shares = dealt.groupBy("site", "cell", "share").agg(F.collect_set(point).alias("points")).select("site", "cell", F.size("points").alias("all"), corners("points").alias("points"))
    cells = shares.groupBy("site", "cell").agg(F.sum("all").alias("all"), F.flatten(F.collect_list("points")).alias("points")).withColumn("points", corners("points"))
    sites = cells.groupBy("site").agg(F.collect_list(F.struct("cell", "all", "points")).alias("cells")).withColumn("cells", F.sort_array("cells")).join(extent.select("site", "members").hint("merge"), "site")
    back = lambda p: F.struct(*(c.alias(n) for c, n in zip(from_mercator(p["x"], p["y"]), ("lon", "lat"), strict=True)))
    return sites.select("site", "members", drawn(ratio)("members", "cells").alias("ring")).select(F.col("site").alias(site), "members", F.transform("ring", back).alias("ring"))


def convex_corners(points: DataFrame, keys: list[str], cell: list[Column]) -> DataFrame:
    """(keys, points): the corners of the convex hull of each group's points (x, y), of the corners of the hulls of its cells. What a task gathers
    is a cell's distinct points, then the corners of a group's cells."""
    cells = [f"_cell{i}" for i in range(len(cell))]
    parts = points.withColumns(dict(zip(cells, cell, strict=True))).groupBy(*keys, *cells).agg(F.collect_set(F.struct("x", "y")).alias("points")).withColumn("points", corners("points"))
    return parts.groupBy(*keys).agg(F.flatten(F.collect_list("points")).alias("points")).withColumn("points", corners("points"))


def dissolve(rows: DataFrame, key: str, geometry: str, order: str, first: list[str], most: int = 10_000) -> DataFrame:
    """(key, share, shares, members, geometry, first): the multipolygon of all of a key's polygons, each once, with other columns of the key's first row by `order`.

    A key with more than `most` polygons comes in several shares, dealt by a hash of the polygon, so that no row holds a frequent key whole; `members` counts the
    polygons of the share. Rows without a geometry count for the first row only; a key without polygons has one share with none.
    """
    each = rows.withColumn("_member", F.explode_outer(F.filter(F.col(geometry)["members"], lambda m: m["kind"] == "Polygon")))
    known = each.groupBy(key).agg(F.min_by(F.struct(*first), order).alias("_first"), F.greatest(F.lit(1), F.ceil(F.count("_member") / most)).cast("int").alias("shares"))
    dealt = each.select(key, "_member").join(known, key).withColumn("share", F.coalesce(F.pmod(F.xxhash64("_member"), F.col("shares")), F.lit(0)).cast("int"))
    united = dealt.groupBy(key, "share").agg(F.collect_set("_member").alias("members"), F.first("shares").alias("shares"), F.first("_first").alias("_first"))
    shape = F.struct(F.lit("MultiPolygon").alias("kind"), F.col("members"))
    return united.select(key, "share", "shares", F.size("members").alias("n"), shape.alias(geometry), "_first.*").withColumnRenamed("n", "members")
