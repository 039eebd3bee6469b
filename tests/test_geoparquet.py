"""Well-known binary and GeoParquet."""

import json
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voltspan.functions import geo, wkb
from voltspan.sources import geoparquet

P, Q, R = (1.5, 2.5), (-3.0, 4.25), (0.0, -1.0)


def member(kind, *parts):
    return (kind, [[tuple(p) for p in part] for part in parts])


SHAPES = [
    ("Point", [member("Point", [P])]), ("LineString", [member("LineString", [P, Q, R])]), ("Polygon", [member("Polygon", [P, Q, R, P], [Q, R, P, Q])]),
    ("MultiPoint", [member("Point", [P]), member("Point", [Q])]), ("MultiLineString", [member("LineString", [P, Q]), member("LineString", [Q, R])]),
    ("MultiPolygon", [member("Polygon", [P, Q, R, P]), member("Polygon", [R, P, Q, R], [P, Q, R, P])]), ("GeometryCollection", [member("Point", [P]), member("Polygon", [P, Q, R, P])]),
    ("Point", []), ("LineString", []), ("Polygon", []), ("MultiPolygon", []), None,
]


def frame(spark, shapes):
    return spark.createDataFrame(list(enumerate(shapes)), f"id int, geometry {wkb.GEOMETRY.simpleString()}")


def plain(shape):
    return None if shape is None else (shape["kind"], [(m["kind"], [[tuple(p) for p in part] for part in m["parts"]]) for m in shape["members"]])


def test_every_kind_comes_back(spark):
    back = frame(spark, SHAPES).select("id", wkb.from_wkb(wkb.to_wkb("geometry")).alias("geometry")).orderBy("id").collect()
    assert [plain(r["geometry"]) for r in back] == SHAPES


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize(("flag", "wide"), [(0, 2), (1000, 3), (2000, 3), (3000, 4), (0x80000000, 3), (0x40000000, 3), (0xC0000000, 4), (0x20000000, 2), (0xA0000000, 3)])
def test_other_writers(spark, order, flag, wide):
    number = lambda n: struct.pack(f"{order}I", n)
    head = lambda code: bytes([order == "<"]) + number(code + flag) + (number(4326) if flag & 0x20000000 and flag > 3000 else b"")
    points = lambda *ps: b"".join(struct.pack(f"{order}{wide}d", *p, *[9.0] * (wide - 2)) for p in ps)
    ring = number(4) + points(P, Q, R, P)
    rows = [head(1) + points(P), head(2) + number(2) + points(P, Q), head(6) + number(1) + head(3) + number(1) + ring, b"", b"\x01\x09", head(2) + number(5) + points(P), None]
    got = [plain(r[0]) for r in spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(rows)], "id int, v binary").orderBy("id").select(wkb.from_wkb("v")).collect()]
    assert got == [SHAPES[0], ("LineString", [member("LineString", [P, Q])]), ("MultiPolygon", [member("Polygon", [P, Q, R, P])]), None, None, None, None]


def test_files_have_metadata_and_boxes_prune(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g")
    df = spark.range(0, 1000, 1, 2).select("id", wkb.geometry("LineString", F.array(F.array(*(F.struct((F.col("id") * 0.1 + x).alias("lon"), F.lit(float(x)).alias("lat")) for x in (0, 1))))).alias("geometry"))
    assert geoparquet.write_geoparquet(df, path) == 2
    meta = json.loads(pq.read_schema(next((tmp_path / "g").glob("*.parquet"))).metadata[b"geo"])
    assert meta["primary_column"] == "geometry" and meta["columns"]["geometry"]["geometry_types"] == ["LineString"] and meta["columns"]["geometry"]["crs"]["id"]["code"] == 4326
    some = geoparquet.read_geoparquet(spark, path, (10.05, 0.0, 11.95, 1.0))
    assert sorted(r["id"] for r in some.collect()) == list(range(91, 120))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    assert "LessThanOrEqual(bbox.xmin,11.95)" in geoparquet.read_geoparquet(spark, path, (10.05, 0.0, 11.95, 1.0))._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert geoparquet.read_geoparquet(spark, path).where("id = 7").first()["geometry"]["members"][0]["parts"][0][1]["lon"] == pytest.approx(1.7)


def test_reference_systems(spark, tmp_path):
    x, y = geo.mercator(F.lit(P[0]), F.lit(P[1]))
    df = spark.range(1).select(wkb.geometry("Point", F.array(F.array(F.struct(x.alias("lon"), y.alias("lat"))))).alias("geometry"))
    geoparquet.write_geoparquet(df, str(tmp_path / "m"), crs=geoparquet.MERCATOR)
    (point,) = geoparquet.read_geoparquet(spark, str(tmp_path / "m")).first()["geometry"]["members"][0]["parts"][0]
    assert tuple(point) == pytest.approx(P)
    geoparquet.write_geoparquet(df, str(tmp_path / "o"), crs="EPSG:5070")
    with pytest.raises(ValueError):
        geoparquet.read_geoparquet(spark, str(tmp_path / "o"))
    (tmp_path / "b").mkdir()
    shape = struct.pack("<BI2d", 1, 1, *P)
    pq.write_table(pa.table({"geometry": pa.array([shape, None], pa.binary())}), tmp_path / "b" / "x.parquet")  # without metadata, boxes and a system
    assert [plain(r["geometry"]) for r in geoparquet.read_geoparquet(spark, str(tmp_path / "b")).collect()] == [SHAPES[0], None]
    assert geoparquet.read_geoparquet(spark, str(tmp_path / "b"), (0, 0, 2, 3)).count() == 1
