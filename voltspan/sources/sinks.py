"""Writers: CSV, GeoJSON features, tiles by folder, snapshots that replace the last good one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltspan.functions.geo import pixel


def write_csv(df: DataFrame, path: str) -> None:
    """Nulls as empty fields."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def feature(df: DataFrame, properties: list[str], places: int = 6) -> Column:
    """A GeoJSON point feature as JSON; null properties are left out."""
    point = F.array(F.bround("lon", places), F.bround("lat", places))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Point").alias("type"), point.alias("coordinates")).alias("geometry")))


def write_geojson_lines(df: DataFrame, properties: list[str], path: str, where: str | None = None, places: int = 6, gzip: bool = True) -> None:
    """One feature to a line."""
    rows = df.where(where) if where else df
    rows.select(feature(rows, properties, places).alias("value")).write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the map tile of a place."""
    x, y = pixel(lon, lat, zoom, 512)
    return F.floor(x / 512), F.floor(y / 512)


def write_tiles(df: DataFrame, zoom: int, path: str) -> None:
    """Rows in a folder for each tile, so that a viewport reads only its own."""
    x, y = tile_of(F.col("lon"), F.col("lat"), zoom)
    df.withColumns({"tile_x": x, "tile_y": y}).repartition("tile_x", "tile_y").write.mode("overwrite").partitionBy("tile_x", "tile_y").parquet(path)


def write_snapshot(df: DataFrame, path: str) -> bool:
    """Replaces a snapshot, unless the new one is empty: then the last good one stays, and this is false.

    The new one is written whole beside the old one, which then makes room; a job that fails leaves the old one as it is.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(beside := f"{path}.new")
    if spark.read.parquet(beside).isEmpty():
        return False
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, now, old = (hadoop.Path(x) for x in (beside, path, f"{path}.old"))
    files = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(old, True)
    if files.exists(now):
        files.rename(now, old)
    files.rename(new, now)
    files.delete(old, True)
    return True
