"""The shapefile data source."""

import shutil
import zipfile

import pytest

from tests.test_shapes import dbf, shp
from voltspan.sources.shapefile import ShapefileReader, read_shapefiles, write_shapefiles

POINT = "array<array<struct<lon:double,lat:double>>>"


def square(x, y):
    x = float(x)
    return [(x, y), (x, y + 1.0), (x + 1.0, y + 1.0), (x, y)]


@pytest.fixture
def written(spark, tmp_path):
    rows = [(i, f"név {i}" if i % 7 else None, [square(i, 0.0), square(i + 0.2, 0.2)] if i % 5 else None) for i in range(100)]
    df = spark.createDataFrame(rows, f"id int, name string, parts {POINT}")
    assert write_shapefiles(df.repartition(3, "id"), str(tmp_path / "made"), "Polygon", ["id", "name"]) == ["part-00000", "part-00001", "part-00002"]
    return tmp_path, rows


def plain(found):
    return sorted((int(r["attributes"]["id"]), r["attributes"]["name"] or None, [[tuple(p) for p in part] for part in r["parts"]] or None) for r in found.collect())


def test_what_is_written_is_read_by_ranges(spark, written):
    folder, rows = written
    back = read_shapefiles(spark, str(folder / "made"), records=10)
    assert back.rdd.getNumPartitions() >= 10
    assert plain(back) == [(i, n, parts and [[tuple(p) for p in part] for part in parts]) for i, n, parts in rows]
    assert {r["kind"] for r in back.collect()} == {"Polygon", None}
    assert back.select("file", "number").distinct().count() == 100


def test_a_large_file_has_no_task_for_each_few_records():
    """Small ranges made a task for each few records of a file, however large."""
    ranges = ShapefileReader({"path": "x", "records": "40"}).ranges(100 + 8 * 1_000_003)
    assert 200 < len(ranges) <= 256 and ranges[0][0] == 0 and ranges[-1][1] == 1_000_003
    assert all(a[1] == b[0] for a, b in zip(ranges[:-1], ranges[1:], strict=True))
    assert len(ShapefileReader({"path": "x", "records": "40"}).ranges(100 + 8 * 400)) == 10


def test_members_of_zips(spark, written):
    folder, rows = written
    (zips := folder / "zips").mkdir()
    for k, names in enumerate((["part-00000", "part-00001"], ["part-00002"])):
        with zipfile.ZipFile(zips / f"{k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                for ending in ("shp", "shx", "dbf"):
                    z.write(folder / "made" / f"{n}.{ending}", f"inner/{n}.{ending.upper()}")
            z.writestr("readme.txt", "x")
    assert len(plain(read_shapefiles(spark, str(zips), records=7))) == 100
    assert plain(read_shapefiles(spark, str(zips), records=7)) == plain(read_shapefiles(spark, str(folder / "made")))


def test_only_some_attributes_and_no_index(spark, written):
    folder, _ = written
    (bare := folder / "bare").mkdir()
    for ending in ("shp", "dbf"):
        shutil.copy(folder / "made" / f"part-00001.{ending}", bare)
    some = read_shapefiles(spark, str(bare), columns=["name"])
    whole = read_shapefiles(spark, str(folder / "made" / "part-00001.shp"))
    assert some.count() == ShapefileReader({"path": str(folder / "made")}).partitions()[1].last
    assert all(set(r["attributes"]) == {"name"} for r in some.collect())
    assert whole.count() == some.count()


def test_deleted_rows_missing_attributes_and_empty_folders(spark, tmp_path):
    import struct

    body = lambda x: (1, struct.pack("<2d", x, 0.0))
    (tmp_path / "a.shp").write_bytes(shp([body(1.0), body(2.0), body(3.0)]))
    data = bytearray(dbf(["id"], [["x"], ["y"]]))
    data[-11] = ord("*")
    (tmp_path / "a.dbf").write_bytes(bytes(data))
    got = {r["number"]: (r["parts"][0][0]["lon"], r["attributes"]) for r in read_shapefiles(spark, str(tmp_path)).collect()}
    assert got == {0: (1.0, {"id": "x"}), 2: (3.0, {})}
    (tmp_path / "none").mkdir()
    assert read_shapefiles(spark, str(tmp_path / "none")).count() == 0
