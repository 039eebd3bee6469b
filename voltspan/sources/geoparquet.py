"""GeoParquet: geometries as well-known binary in Parquet, with boxes that prune, and their reference system in each file's metadata."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltspan.functions.geo import bounds, from_mercator
from voltspan.functions.wkb import from_wkb, points_of, to_wkb, with_points
from voltspan.sources.files import listed, opened

#: Longitude and latitude, and spherical Mercator metres.
LONLAT, MERCATOR = "EPSG:4326", "EPSG:3857"
#: Rows of a row group, the smallest part of a file that a box leaves out.
GROUP_ROWS = 50_000


def write_geoparquet(df: DataFrame, path: str, geometry: str = "geometry", crs: str | None = LONLAT) -> int:
    """Writes a file for each partition; returns their number. Beside the geometry's bytes is its box (xmin, ymin, xmax, ymax), which the metadata
    name as its covering. Rows in the order of places prune best. Files get their last names when all tasks have ended well."""
    box = bounds(points_of(F.col(geometry)))
    cover = F.struct(*(box[a].alias(b) for a, b in (("west", "xmin"), ("south", "ymin"), ("east", "xmax"), ("north", "ymax"))))
    rows = df.withColumns({"bbox": cover, geometry: to_wkb(geometry), "_kind": F.col(geometry)["kind"]})
    authority, _, code = (crs or "").partition(":")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not held:
            return
        table = pa.concat_tables(held)
        kinds = sorted({k for k in table["_kind"].to_pylist() if k})
        column = {"encoding": "WKB", "geometry_types": kinds, "covering": {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}}
        column |= {"crs": {"id": {"authority": authority, "code": int(code)}}} if crs else {}
        meta = {"version": "1.1.0", "primary_column": geometry, "columns": {geometry: column}}
        table = table.drop_columns(["_kind"]).replace_schema_metadata({"geo": json.dumps(meta)})
        system, folder = opened(path)
        system.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        pq.write_table(table, f"{folder}/_tmp-{name}", filesystem=system, row_group_size=GROUP_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    done = [r[0] for r in rows.mapInArrow(write, "name string").collect()]  # a name for each partition
    system, folder = opened(path)
    for name in done:
        system.move(f"{folder}/_tmp-{name}", f"{folder}/{name}")
    return len(done)


def crs_of(path: str) -> tuple[str, str]:
    """The geometry column and the reference system, from the metadata of the first file; longitude and latitude where there is none."""
    first = next(p for p in listed(path, ".parquet") if not p.rsplit("/", 1)[-1].startswith(("_", ".")))
    meta = json.loads((pq.read_schema(first, filesystem=opened(path)[0]).metadata or {}).get(b"geo", b"{}"))
    name = meta.get("primary_column", "geometry")
    known = (meta.get("columns", {}).get(name, {}).get("crs") or {}).get("id") or {}
    code = f"{known['authority']}:{known['code']}" if known else LONLAT
    return name, LONLAT if code == "OGC:CRS84" else code


def read_geoparquet(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """All columns, the geometry as a struct of kind and members in longitude and latitude. box (west, south, east, north; in the file's own system):
    only geometries whose box touches it, where row groups off it aren't read. Mercator metres are projected back; other systems raise."""
    name, crs = crs_of(path)
    if crs not in (LONLAT, MERCATOR):
        raise ValueError(f"geometries are in {crs}")
    df = spark.read.parquet(path)
    if box is not None and "bbox" in df.columns:
        west, south, east, north = map(float, box)
        df = df.where((F.col("bbox.xmin") <= east) & (F.col("bbox.xmax") >= west) & (F.col("bbox.ymin") <= north) & (F.col("bbox.ymax") >= south))
    shape = from_wkb(F.col(name))
    df = df.drop("bbox").withColumn(name, shape)
    if box is not None and "bbox" not in spark.read.parquet(path).columns:
        own = bounds(points_of(F.col(name)))
        df = df.where((own["west"] <= float(box[2])) & (own["east"] >= float(box[0])) & (own["south"] <= float(box[3])) & (own["north"] >= float(box[1])))
    if crs == MERCATOR:
        back = lambda p: F.struct(*(c.alias(n) for c, n in zip(from_mercator(p["lon"], p["lat"]), ("lon", "lat"), strict=True)))
        df = df.withColumn(name, F.when(F.col(name).isNotNull(), with_points(F.col(name), back)))
    return df
