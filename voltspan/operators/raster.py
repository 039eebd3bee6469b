"""Grids as long tables (row, col, value): probes, resampling, interpolation, mosaics. Row 0 is the north, column 0 the west."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """A regular grid: its north-west corner and the size of its cells in degrees."""

    west: float
    north: float
    dx: float
    dy: float
    width: int
    height: int

    def row(self, lat: Column) -> Column:
        return F.floor((F.lit(self.north) - lat) / F.lit(self.dy))

    def col(self, lon: Column) -> Column:
        return F.floor((lon - F.lit(self.west)) / F.lit(self.dx))


def probe(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """Adds the value of the cell that a point (lon, lat) is in; outside and where there is no data null."""
    placed = points.withColumns({"row": grid.row(F.col("lat")), "col": grid.col(F.col("lon"))})
    return placed.join(cells.select("row", "col", "value"), ["row", "col"], "left").drop("row", "col")


def nearest_index(value: Column, axis: list[float]) -> Column:
    """The place (from 0) of the axis value nearest to a value, the first of ties. axis: the fixed values of one grid axis, in any order."""
    gaps = F.transform(F.array(*map(F.lit, axis)), lambda x: F.abs(x - value))
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def bilinear(points: DataFrame, cells: DataFrame, grid: Grid, key: str) -> DataFrame:
    """(key, value): between the centres of the four cells around a point; null unless all four have data."""
    x, y = (F.col("lon") - F.lit(grid.west)) / F.lit(grid.dx) - F.lit(0.5), (F.lit(grid.north) - F.col("lat")) / F.lit(grid.dy) - F.lit(0.5)
    placed = points.select(key, x.alias("x"), y.alias("y")).withColumns({"c0": F.floor("x"), "r0": F.floor("y")})
    corners = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    each = placed.withColumn("k", corners).select(key, "x", "y", "r0", "c0", F.col("k.i").alias("i"), F.col("k.j").alias("j"), (F.col("r0") + F.col("k.i")).alias("row"), (F.col("c0") + F.col("k.j")).alias("col"))
    fx, fy = F.col("x") - F.col("c0"), F.col("y") - F.col("r0")
    weight = F.when(F.col("j") == 1, fx).otherwise(1 - fx) * F.when(F.col("i") == 1, fy).otherwise(1 - fy)
    joined = each.join(cells.select("row", "col", "value"), ["row", "col"], "left")
    total = F.sum(weight * F.col("value"))
    return joined.groupBy(key).agg(F.when(F.count("value") == 4, total).alias("value"))


def averaged(cells: DataFrame, factor: int) -> DataFrame:
    """Larger cells: the mean of those with data."""
    row, col = F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")
    return cells.where(F.col("value").isNotNull()).groupBy(row, col).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def cropped(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Cells within bounds, both included."""
    return cells.where(F.col("row").between(*rows) & F.col("col").between(*cols))


def rolled(cells: DataFrame, width: int) -> DataFrame:
    """Columns from the antimeridian on, where they began at the prime meridian."""
    return cells.withColumn("col", F.pmod(F.col("col") + width // 2, F.lit(width)))


def mosaic(layers: list[DataFrame]) -> DataFrame:
    """The last layer's value where it has data, else that of the one before."""
    stacked = [df.where(F.col("value").isNotNull()).select("row", "col", "value", F.lit(i).alias("layer")) for i, df in enumerate(layers)]
    every = stacked[0]
    for df in stacked[1:]:
        every = every.unionByName(df)
    return every.groupBy("row", "col").agg(F.max_by("value", "layer").alias("value"))


def combined(bands: dict[str, DataFrame]) -> DataFrame:
    """(row, col, band, ...): the cells that all bands have."""
    out = None
    for name, df in bands.items():
        own = df.select("row", "col", F.col("value").alias(name))
        out = own if out is None else out.join(own, ["row", "col"])
    return out


def interpolated(targets: DataFrame, samples: DataFrame, radius: float, most: int, smoothing: float = 0.0) -> DataFrame:
    """(row, col, value): inverse squared distances of up to `most` samples (x, y, value, id) within a radius of a target (row, col, x, y).

    Targets and samples meet in square cells as large as the radius; of equal distances the smaller id counts first, so of the samples of one place no more
    than `most` can count, and only these are copied to cells.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(radius))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    place = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    near = samples.withColumn("_place", place).where(F.col("_place") <= most).select("id", F.col("x").alias("sx"), F.col("y").alias("sy"), "value", around.alias("k"), cell("x").alias("_x"), cell("y").alias("_y"))
    near = near.select("id", "sx", "sy", "value", (F.col("_x") + F.col("k.i")).alias("cx"), (F.col("_y") + F.col("k.j")).alias("cy"))
    square = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
    pairs = targets.withColumns({"cx": cell("x"), "cy": cell("y")}).join(near.hint("merge"), ["cx", "cy"]).withColumn("d2", square).where(F.col("d2") <= radius * radius)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("row", "col").orderBy("d2", "id"))).where(F.col("rank") <= most)
    weight = F.lit(1.0) / (F.col("d2") + F.lit(smoothing * smoothing))
    exact = F.max(F.when(F.col("d2") + F.lit(smoothing) == 0, F.col("value")))
    return ranked.groupBy("row", "col").agg(F.coalesce(exact, F.sum(weight * F.col("value")) / F.sum(weight)).alias("value"))


def ramp(value: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """A struct (r, g, b, a) between the colours of a ramp, clipped at its ends; transparent where there is no data."""

    def channel(k: int) -> Column:
        out = F.lit(float(stops[-1][1][k]))
        for (x0, c0), (x1, c1) in reversed(list(zip(stops, stops[1:], strict=False))):
            out = F.when(value < x1, F.lit(float(c0[k])) + (value - F.lit(float(x0))) / F.lit(float(x1 - x0)) * F.lit(float(c1[k] - c0[k]))).otherwise(out)
        return F.coalesce(F.bround(F.when(value <= stops[0][0], float(stops[0][1][k])).otherwise(out), 0), F.lit(0.0)).cast("int")

    return F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"), F.when(value.isNull(), 0).otherwise(255).alias("a"))
