"""Extractors described as data: fields, point sources, release packs; each is a plan of columns and unions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltspan.sources import readers, shapefile, sinks

#: Name, column and type.
Field = tuple[str, Column, str]


def with_fields(df: DataFrame, fields: Sequence[Field], keep: Sequence[str] = (), hook: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The kept columns and the fields (name, column, type), then the hook's changes. A value that its type can't hold is null."""
    rows = df.select(*keep, *(c.try_cast(kind).alias(name) for name, c, kind in fields))
    return rows.transform(hook) if hook else rows


@dataclass(frozen=True)
class PointSource:
    """A source of places: its kind, the rows that count (all without a condition; those for which it is null go) and its fields by name."""

    kind: str
    table: str
    fields: Mapping[str, str] = field(default_factory=dict)
    where: str | None = None


def extract_points(tables: Mapping[str, DataFrame], sources: Sequence[PointSource], columns: Mapping[str, str], tag: str = "fac_type") -> DataFrame:
    """All sources under one another, each with its kind and all columns (name: type); fields are expressions of the source's own columns.

    Rows without a longitude or latitude go. No shuffle: each source is a scan with its filter and its columns.
    """
    parts = []
    for s in sources:
        rows = tables[s.table].where(s.where) if s.where else tables[s.table]
        parts.append(rows.select(F.lit(s.kind).alias(tag), *(F.expr(s.fields.get(c, "NULL")).cast(kind).alias(c) for c, kind in columns.items())))
    return reduce(DataFrame.unionByName, parts).where(F.col("lon").isNotNull() & F.col("lat").isNotNull())


def run_extraction(spark: SparkSession, require: str, build: Callable[[DataFrame], DataFrame], output: str, hint: str = "", summary: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """Reads the Parquet table `require`, builds the layer and writes it as Parquet and, with lon and lat first, as CSV beside it.

    Returns the summary of what was written (none without one). An input that isn't there is an error that says where to get it, before anything is written.
    """
    try:
        source = spark.read.parquet(require)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"input not found: {require}" + (f"\n{hint}" if hint else "")) from e
        raise
    build(source).write.mode("overwrite").parquet(f"{output}.parquet")
    layer = spark.read.parquet(f"{output}.parquet")
    sinks.write_csv(layer.select("lon", "lat", *(c for c in layer.columns if c not in ("lon", "lat"))), f"{output}.csv")
    return summary(layer) if summary else None


#: Keys of a release source, the first that is there counts.
PRECEDENCE = ("geojson_gz", "shp", "geojson", "csv")


def source_of(spec: Mapping[str, str]) -> tuple[str, str]:
    """The key and path of a release source by precedence."""
    for key in PRECEDENCE:
        if key in spec:
            return key, spec[key]
    raise ValueError(f"no source among the keys {sorted(spec)}")


def load_release(spark: SparkSession, spec: Mapping[str, str]) -> DataFrame:
    """The features of a release source, from that of its files that comes first. A CSV file names its own columns of places in lat_col and lon_col; they become lat and lon, as numbers."""
    key, path = source_of(spec)
    if key == "shp":
        return shapefile.read_shapefiles(spark, path)
    if key != "csv":
        return readers.read_geojson(spark, path)
    rows = readers.read_csv(spark, path)
    names = {spec.get("lon_col", "lon"): "lon", spec.get("lat_col", "lat"): "lat"}
    return rows.select(*(F.col(f"`{old}`").try_cast("double").alias(new) for old, new in names.items()), *(c for c in rows.columns if c not in names))


def family(kind: Column) -> Column:
    """Polygon, LineString or Point: the kind of a geometry without Multi."""
    return F.regexp_replace(kind, "^Multi", "")


def dominant_family(df: DataFrame, kind: str = "geometry_type") -> DataFrame:
    """The features of the commonest family of geometries (of equally common ones the first by name); those without a geometry go.

    The counts of the few families are summed before they are shuffled, and their winner is one row.
    """
    counted = df.where(F.col(kind).isNotNull()).groupBy(family(F.col(kind)).alias("_family")).agg(F.count("*").alias("_n"))
    chosen = counted.agg(F.min_by("_family", F.struct(-F.col("_n"), "_family")).alias("_family"))
    return df.join(F.broadcast(chosen), family(F.col(kind)) == F.col("_family"), "left_semi")
