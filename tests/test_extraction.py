import gzip
import json

import pytest
from pyspark.sql import functions as F

from voltspan.functions import filters, geo
from voltspan.operators import extraction


def test_run_extraction(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="get it there"):
        extraction.run_extraction(spark, str(tmp_path / "no.parquet"), lambda df: df, str(tmp_path / "out"), hint="get it there")
    assert not (tmp_path / "out.parquet").exists()
    spark.createDataFrame([(1, "a", -99.0, 40.0), (2, None, -98.0, 41.0)], "id int, name string, lon double, lat double").write.parquet(str(tmp_path / "in.parquet"))
    found = extraction.run_extraction(spark, str(tmp_path / "in.parquet"), lambda df: df.where("id > 1"), str(tmp_path / "out"), summary=lambda df: df.agg(F.count("*").alias("n")))
    assert found.first()["n"] == 1
    back = spark.read.option("header", True).csv(str(tmp_path / "out.csv"))
    assert back.columns == ["lon", "lat", "id", "name"] and back.first()["id"] == "2"


def test_release_sources(spark, tmp_path):
    assert extraction.source_of({"csv": "c", "shp": "s", "geojson": "g"}) == ("shp", "s")
    with pytest.raises(ValueError):
        extraction.source_of({"tif": "t"})
    (tmp_path / "p.csv").write_text("X,Y,name\n-99.5,40,a\nbad,41,b\n")
    rows = extraction.load_release(spark, {"csv": str(tmp_path / "p.csv"), "lon_col": "X", "lat_col": "Y"})
    assert [tuple(r) for r in rows.select("lon", "lat", "name").collect()] == [(-99.5, 40.0, "a"), (None, 41.0, "b")]
    with gzip.open(tmp_path / "g.json.gz", "wt") as out:
        json.dump({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": "1"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}, out)
    assert extraction.load_release(spark, {"csv": "x", "geojson_gz": str(tmp_path / "g.json.gz")}).first()["geometry_type"] == "Point"


def test_dominant_family_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, "MultiPoint"), (2, "Polygon"), (3, "Point"), (4, "MultiPolygon"), (5, None)], "id int, geometry_type string")
    assert sorted(r["id"] for r in extraction.dominant_family(df).collect()) == [1, 3]
    assert extraction.dominant_family(df.limit(0)).count() == 0


def test_flat_and_missing_geometries(spark):
    flat = F.array(F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(1.0).alias("lat")) for x in (0.0, 1.0, 0.0))))
    row = spark.range(1).select(geo.inside_point(flat).alias("p"), geo.collected(F.parse_json(F.lit(None).cast("string"))).alias("none"), geo.collected(F.parse_json(F.lit('{"type": "MultiPoint", "coordinates": []}'))).alias("empty")).first()
    assert row["p"] is None and row["none"] == [] and row["empty"] == []


def test_unknown_legend():
    with pytest.raises(KeyError):
        filters.by_legend((), ("kv",), {})
