import struct

import numpy as np
from pyspark.sql import functions as F

from voltspan.functions import geo, shapes
from voltspan.operators import layers, relational
from voltspan.sources.shapefile import read_shapefiles


def test_thinned_line_stays_within_its_tolerance():
    rng = np.random.default_rng(3)
    line = np.cumsum(rng.normal(size=(300, 2)), axis=0)
    kept = shapes.thinned(line, 0.8)
    assert 2 <= len(kept) < len(line) and (kept[0] == line[0]).all() and (kept[-1] == line[-1]).all()
    for p in line:
        a, b = kept[:-1], kept[1:]
        share = np.clip(((p - a) * (b - a)).sum(axis=1) / ((b - a) ** 2).sum(axis=1), 0, 1)
        assert np.hypot(*(p - a - share[:, None] * (b - a)).T).min() <= 0.8 + 1e-9


def test_hull_has_all_points_to_its_left():
    points = np.random.default_rng(4).random((60, 2))
    ring = shapes.outline(points)
    assert (ring[0] == ring[-1]).all()
    for a, b in zip(ring[:-1], ring[1:], strict=True):
        assert ((b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0]) >= -1e-12).all()
    assert len(shapes.outline(points[:1].repeat(4, axis=0))) == 1 and len(shapes.outline(points[:0])) == 0


def test_shapes_of_nulls_and_empty_lines(spark):
    rows = spark.createDataFrame([(0, None), (1, []), (2, [(0.0, 0.0), (1.0, 0.0001), (2.0, 0.0)])], "id int, line array<struct<lon:double,lat:double>>")
    got = {r[0]: r[1] for r in rows.select("id", shapes.simplify(0.01)(F.col("line"))).collect()}
    assert got[0] is None and got[1] == [] and [tuple(p) for p in got[2]] == [(0.0, 0.0), (2.0, 0.0)]


def test_clipping_sides_beside_and_across_a_box(spark):
    sides = [(0.5, 0.5, 0.5, 3.0), (2.0, 0.0, 2.0, 1.0), (-1.0, 0.5, 2.0, 0.5), (0.2, 0.2, 0.4, 0.4), (5.0, 5.0, 6.0, 6.0)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sides)], "id int, s struct<from_lon:double,from_lat:double,to_lon:double,to_lat:double>")
    got = {r[0]: r[1] and tuple(round(x, 9) for x in r[1]) for r in rows.select("id", geo.clipped_segment(F.col("s"), (0, 0, 1, 1))).collect()}
    assert got == {0: (0.5, 0.5, 0.5, 1.0), 1: None, 2: (0.0, 0.5, 1.0, 0.5), 3: (0.2, 0.2, 0.4, 0.4), 4: None}


def dbf(names, rows, width=10):
    head = 32 + 32 * len(names) + 1
    out = struct.pack("<4BiHH20x", 3, 24, 1, 1, len(rows), head, 1 + width * len(names))
    for n in names:
        out += n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15
    return out + b"\r" + b"".join(b" " + b"".join(v.encode("latin-1").ljust(width) for v in r) for r in rows)


def shp(records):
    out = b"\0" * 100
    for i, (code, body) in enumerate(records):
        out += struct.pack(">2i", i + 1, (4 + len(body)) // 2) + struct.pack("<i", code) + body
    return out


def test_shapefile_records(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    hole = [(0.1, 0.1), (0.2, 0.2), (0.1, 0.2), (0.1, 0.1)]
    polygon = struct.pack("<4d2i2i", 0, 0, 1, 1, 2, 8, 0, 4) + b"".join(struct.pack("<2d", *p) for p in ring + hole)
    (tmp_path / "a.shp").write_bytes(shp([(1, struct.pack("<2d", -99.5, 40.25)), (0, b""), (5, polygon)]))
    (tmp_path / "a.dbf").write_bytes(dbf(["NAME", "KV"], [["Señal", "138"], ["", ""], ["ring", "69"]]))
    (tmp_path / "notes.txt").write_text("not a shape")
    rows = read_shapefiles(spark, str(tmp_path)).orderBy("number").collect()
    assert [r["kind"] for r in rows] == ["Point", None, "Polygon"]
    assert tuple(rows[0]["parts"][0][0]) == (-99.5, 40.25) and rows[0]["attributes"] == {"NAME": "Señal", "KV": "138"}
    assert rows[1]["parts"] == [] and [[tuple(p) for p in part] for part in rows[2]["parts"]] == [ring, hole]


def test_layers_and_manifests(spark):
    df = spark.createDataFrame([(1, 1.23456, 2.0, "valve"), (2, 3.0, 4.0, "pump"), (3, 5.0, 6.0, None)], "id int, lon double, lat double, kind string")
    specs = [layers.LayerSpec("a", ("id",), "kind <> 'valve'", 2), layers.LayerSpec("b", skip=True), layers.LayerSpec("gone")]
    built = layers.build_all({"a": df, "b": df}, specs)
    assert list(built) == ["a"] and [tuple(r) for r in built["a"].collect()] == [(2, 3.0, 4.0)]
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {r[0]: r[1] for r in relational.cross_check(names("a", "b"), names("b", "b", "c"), "name", strict=True).collect()}
    assert got == {"a": "FAIL", "b": "PASS", "c": "FAIL"}
