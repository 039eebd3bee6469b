"""A pyramid of map tiles: features cut by zoom and tile, each tile within a budget of bytes, written so that a viewport reads its own files.

Coordinates in a tile are whole steps of `EXTENT` to its side, from its north-west corner. Lines lose the points that fall on the step before, so
they thin out towards low zooms, and end up in each tile that they cross, clipped. Nothing gathers a tile, least the one that has the whole
world: a histogram of bytes by rank and tie says which groups of features fit a tile, and features find their group by a join on all of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from voltspan.functions.geo import pixel

#: Steps to a tile's side; tiles to a side of a block of files; bytes of a feature in a tile besides its coordinates, and of a pair of these.
EXTENT, BLOCK, FEATURE_BYTES, POINT_BYTES = 4096, 8, 40, 8
TILE = ("zoom", "x", "y")


def point_pieces(points: DataFrame, low: int, high: int, size: Column | int = FEATURE_BYTES + POINT_BYTES) -> DataFrame:
    """A row for each point (lon, lat) and zoom: its tile (zoom, x, y), px and py in it, and bytes."""
    at_x, at_y = pixel(F.col("lon"), F.col("lat"), 0, 1)
    each = points.withColumns({"_x": at_x, "_y": at_y, "zoom": F.explode(F.sequence(F.lit(low), F.lit(high)))})
    step = lambda c: F.floor(F.col(c) * F.pow(F.lit(2.0), F.col("zoom")) * EXTENT).cast("long")
    placed = each.withColumns({"_x": step("_x"), "_y": step("_y")})
    tile = lambda c: F.floor(F.col(c) / EXTENT).cast("long")
    return placed.withColumns({"x": tile("_x"), "y": tile("_y"), "px": F.pmod("_x", F.lit(EXTENT)).cast("int"), "py": F.pmod("_y", F.lit(EXTENT)).cast("int"), "bytes": F.lit(size)}).drop("_x", "_y")


def line_pieces(lines: DataFrame, key: str, line: str, low: int, high: int) -> DataFrame:
    """A row for each line, zoom and tile that it crosses: the key, zoom, x, y, sides (x0, y0, x1, y1 in the tile, in the line's order) and bytes.

    A line whose points all fall on one step of a zoom isn't there. A row has only sides of one line in one tile.
    """
    flat = F.transform(line, lambda p: F.struct(*(c.alias(n) for c, n in zip(pixel(p["lon"], p["lat"], 0, 1), "xy", strict=True))))
    pieces = lines.select(key, F.explode(cut_by_tiles(low, high)(flat)).alias("piece")).select(key, "piece.*")
    return pieces.withColumn("bytes", FEATURE_BYTES + POINT_BYTES * (F.size("sides") + 1))


_PIECES = "array<struct<zoom:int,x:bigint,y:bigint,sides:array<struct<x0:double,y0:double,x1:double,y1:double>>>>"
#: Lines that are cut at once.
AT_ONCE = 2_000


def _counted(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _shares(start: np.ndarray, step: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shares of sides at which they enter and leave a band, as clipped_segment has them."""
    with np.errstate(divide="ignore", invalid="ignore"):
        to_low, to_high = (low - start) / step, (high - start) / step
    beside = np.where((start >= low) & (start <= high), 0.0, 2.0)
    return np.where(step > 0, to_low, np.where(step < 0, to_high, beside)), np.where(step > 0, to_high, np.where(step < 0, to_low, 1.0))


def _cut(line: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sides of lines by tile: line, tile x, tile y, and the four coordinates in the tile; by line and tile, then in the line's order. line: the number of
    each point's line; x, y: its steps."""
    again = np.concatenate(([False], (line[1:] == line[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])))[: len(line)]
    line, x, y = line[~again], x[~again], y[~again]
    side = np.flatnonzero((line[1:] == line[:-1]) & np.isfinite(x[1:] + x[:-1] + y[1:] + y[:-1]))
    line, x, y, dx, dy = line[side], x[side], y[side], x[side + 1] - x[side], y[side + 1] - y[side]
    # first the rows of tiles that a side crosses, then in each the tiles that its part there can reach
    low = np.floor(np.minimum(y, y + dy) / EXTENT)
    n = (np.floor(np.maximum(y, y + dy) / EXTENT) - low).astype(np.int64) + 1
    of = np.repeat(np.arange(len(side)), n)
    row = low[of] + _counted(n)
    first, last = _shares(y[of], dy[of], row * EXTENT, (row + 1) * EXTENT)
    ends = x[of] + np.clip(first, 0, 1) * dx[of], x[of] + np.clip(last, 0, 1) * dx[of]
    west, east = np.floor(np.minimum(x, x + dx) / EXTENT)[of], np.floor(np.maximum(x, x + dx) / EXTENT)[of]
    low = np.maximum(west, np.floor(np.minimum(*ends) / EXTENT) - 1)
    n = np.maximum(np.minimum(east, np.floor(np.maximum(*ends) / EXTENT) + 1) - low, -1).astype(np.int64) + 1
    at = np.repeat(np.arange(len(of)), n)
    column, row, of = low[at] + _counted(n), row[at], of[at]
    x, y, dx, dy = x[of], y[of], dx[of], dy[of]
    (in_x, out_x), (in_y, out_y) = _shares(x, dx, column * EXTENT, (column + 1) * EXTENT), _shares(y, dy, row * EXTENT, (row + 1) * EXTENT)
    first, last = np.maximum(0.0, np.maximum(in_x, in_y)), np.minimum(1.0, np.minimum(out_x, out_y))
    kept = np.flatnonzero(first < last)
    kept = kept[np.lexsort((of[kept], row[kept], column[kept], line[of[kept]]))]
    column, row, of, first, last = column[kept], row[kept], of[kept], first[kept], last[kept]
    x, y, dx, dy = x[kept], y[kept], dx[kept], dy[kept]
    west, north = column * EXTENT, row * EXTENT
    return line[of], column.astype(np.int64), row.astype(np.int64), x + first * dx - west, y + first * dy - north, x + last * dx - west, y + last * dy - north


def cut_by_tiles(low: int, high: int) -> Callable[[Column], Column]:
    """A function of lines (x, y in the world from 0 to 1): their pieces at each zoom, in one array. A line's tiles lie in its own row, so nothing is shuffled."""

    def one(flat: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.list_value_length(flat).fill_null(0))
        points, line = flat.flatten(), np.repeat(np.arange(len(flat)), sizes)
        world = [np.asarray(points.field(c).fill_null(np.nan), float) for c in "xy"]
        parts = []
        for zoom in range(low, high + 1):
            cut = _cut(line, *(np.floor(w * (2.0**zoom * EXTENT)) for w in world))
            parts.append((cut[0], np.full(len(cut[0]), zoom), *cut[1:]))
        all_of = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.argsort(all_of[0], kind="stable")
        own, zoom, x, y, *sides = (c[order] for c in all_of)
        new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (zoom[1:] != zoom[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(own) else np.zeros(0, np.int64)
        offsets = lambda places, end: pa.array(np.append(places, end).astype(np.int32))
        listed = pa.ListArray.from_arrays(offsets(new, len(own)), pa.StructArray.from_arrays([pa.array(c) for c in sides], ["x0", "y0", "x1", "y1"]))
        pieces = pa.StructArray.from_arrays([pa.array(zoom[new].astype(np.int32)), pa.array(x[new]), pa.array(y[new]), listed], ["zoom", "x", "y", "sides"])
        return pa.ListArray.from_arrays(offsets(np.searchsorted(own[new], np.arange(len(flat))), len(new)), pieces)

    @arrow_udf(_PIECES)
    def cut(flat: pa.Array) -> pa.Array:
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        return pa.concat_arrays([one(flat.slice(at, AT_ONCE)) for at in range(0, max(1, len(flat)), AT_ONCE)])

    return cut


def within_budget(pieces: DataFrame, rank: str, tie: str, budget: int, size: str = "bytes", tile: Sequence[str] = TILE) -> DataFrame:
    """The pieces that stay: in each tile the groups of highest rank, then lowest tie, that fit its budget together; from the first group that
    doesn't, all go. rank and tie: whole numbers of few values (some hundred), so that a tile's histogram is small; a tie is a hash of the feature's
    key, the same at each zoom. No tile has more bytes than its budget.
    """
    group = [*tile, rank, tie]
    sums = pieces.groupBy(*group).agg(F.sum(size).alias("_bytes"))
    so_far = F.sum("_bytes").over(Window.partitionBy(*tile).orderBy(F.desc(rank), tie))
    fits = sums.withColumn("_so_far", so_far).where(F.col("_so_far") <= budget).select(*group)
    return pieces.join(fits, group, "left_semi")


def write_pyramid(pieces: DataFrame, path: str) -> None:
    """Writes pieces in folders by zoom and block of tiles. A block is as large as its tiles' budgets allow, so it is a task's work. The schema is written
    beside them, as a pyramid without pieces has no file that could tell it."""
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    blocks = pieces.withColumns({"block_x": block("x"), "block_y": block("y")})
    blocks.repartition("zoom", "block_x", "block_y").sortWithinPartitions("zoom", "block_x", "block_y", "x", "y").write.mode("overwrite").partitionBy("zoom", "block_x", "block_y").parquet(path)
    pieces.sparkSession.range(1).select(F.lit(blocks.schema.json())).write.text(f"{path}/_schema")


def viewport(spark: SparkSession, path: str, zoom: int, west: float, south: float, east: float, north: float) -> DataFrame:
    """The pieces of the tiles that a viewport shows; only its blocks' folders are read, and of their files the groups of rows with its tiles."""
    corners = spark.range(1).select(*pixel(F.lit(west), F.lit(north), zoom, 1), *pixel(F.lit(east), F.lit(south), zoom, 1)).first()
    x0, y0, x1, y1 = (int(c // 1) for c in corners)
    shown = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    blocks = F.col("block_x").between(x0 // BLOCK, x1 // BLOCK) & F.col("block_y").between(y0 // BLOCK, y1 // BLOCK)
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/_schema").first()[0]))
    return spark.read.schema(schema).parquet(path).where((F.col("zoom") == zoom) & blocks & shown).drop("block_x", "block_y")
