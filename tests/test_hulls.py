"""Hulls that follow their points, buffers, and outlines of sites."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltspan.functions import geo, hulls
from voltspan.functions.shapes import outline
from voltspan.operators import sites


def inside(ring, point, slack=1e-7):
    """By the winding of the ring, or on it."""
    a, b = ring[:-1] - point, ring[1:] - point
    share = np.clip(-(a * (b - a)).sum(axis=1) / np.maximum(((b - a) ** 2).sum(axis=1), 1e-300), 0, 1)
    if np.hypot(*(a + share[:, None] * (b - a)).T).min() <= slack:
        return True
    return abs(np.arctan2(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0], (a * b).sum(axis=1)).sum()) > math.pi


CLOUDS = {
    "square": lambda r: r.random((120, 2)) * 1000,
    "corner": lambda r: (lambda p: p[(p[:, 0] < 300) | (p[:, 1] < 300)])(r.random((400, 2)) * 1000),
    "ring": lambda r: (lambda t: np.stack((np.cos(t), np.sin(t)), 1) * 500)(r.random(80) * 5),
    "grid": lambda r: np.stack(np.meshgrid(np.arange(9.0), np.arange(7.0)), -1).reshape(-1, 2),
    "few": lambda r: r.random((4, 2)),
}


@pytest.mark.parametrize("name", CLOUDS)
@pytest.mark.parametrize("ratio", [0.0, 0.2, 0.95, 1.0])
def test_hulls_hold_all_points(name, ratio):
    points = CLOUDS[name](np.random.default_rng(7))
    ring, whole = hulls.concave(points, ratio), outline(points)
    assert (ring[0] == ring[-1]).all() and hulls.area(ring) > 0
    assert all(inside(ring, p) for p in points)
    assert hulls.area(ring) <= hulls.area(whole) * (1 + 1e-9)
    if ratio == 1.0:
        assert hulls.area(ring) == pytest.approx(hulls.area(whole))
    if name == "corner" and ratio == 0.2:
        assert hulls.area(ring) < 0.75 * hulls.area(whole)  # the empty corner is left out


def test_triangles_are_delaunay():
    points = np.random.default_rng(3).random((60, 2))
    tri = hulls.triangles(points)
    total = sum(abs(np.cross(np.append(points[b] - points[a], 0), np.append(points[c] - points[a], 0))[2]) / 2 for a, b, c in tri)
    assert total == pytest.approx(hulls.area(outline(points)))
    for t in tri:
        (ax, ay), (bx, by), (cx, cy) = points[t]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        x = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        y = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        assert (np.hypot(points[:, 0] - x, points[:, 1] - y) >= math.hypot(ax - x, ay - y) - 1e-9).all()


@pytest.mark.parametrize("name", ["square", "corner", "ring"])
def test_buffers_reach_around(name):
    points = CLOUDS[name](np.random.default_rng(5))
    ring = hulls.concave(points, 0.3)
    wide = hulls.buffered(ring, 10.0)
    angles = np.arange(0, 2 * math.pi, math.pi / 7)
    near = 10.0 * math.cos(math.pi / 64) - 1e-6  # a polygon's sides are a little inside its circle
    assert all(inside(wide, p + near * np.array([math.cos(t), math.sin(t)])) for p in ring for t in angles)
    assert hulls.area(wide) > hulls.area(ring)


def test_buffers_of_a_point_and_a_line():
    disc, pill = hulls.buffered(np.array([(3.0, 4.0)]), 500.0), hulls.buffered(np.array([(0.0, 0.0), (300.0, 400.0)]), 100.0)
    circle = lambda r: 32 * r * r * math.sin(math.pi / 32)
    assert len(disc) == 65 and hulls.area(disc) == pytest.approx(circle(500))
    assert hulls.area(pill) == pytest.approx(circle(100) + 2 * 100 * 500)


def test_sites_hold_their_members(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [("one", -99.0, 40.0), ("two", -99.0, 41.0), ("two", -99.01, 41.005), ("same", -98.0, 41.0), ("same", -98.0, 41.0), ("same", -98.0, 41.0), ("none", None, 41.0)]
    rows += [("line", -97.0 + k * 0.001, 40.0 + k * 0.001) for k in range(6)]
    rows += [("many", -95 + float(x) * 0.1, 40 + float(y) * 0.1) for x, y in rng.random((3000, 2)) if x < 0.3 or y < 0.3]
    df = spark.createDataFrame(rows, "site string, lon double, lat double")
    once = {r["site"]: r for r in sites.site_shapes(df, "site", ratio=0.2).collect()}
    monkeypatch.setattr(sites, "SHARE", 100)  # shares of a cell's points are merged
    shared = {r["site"]: r for r in sites.site_shapes(df, "site", ratio=0.2).collect()}
    assert once == shared and set(once) == {"one", "two", "same", "line", "many"}
    for site, lon, lat in rows:
        if site != "none":
            assert inside(np.array([tuple(p) for p in once[site]["ring"]]), np.array((lon, lat)))
    bare = np.array([(x, y) for s, x, y in rows if s == "many"])
    assert hulls.area(np.array([tuple(p) for p in once["many"]["ring"]])) < 0.8 * hulls.area(outline(bare))


def test_no_task_gets_a_whole_site(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("site"), (F.rand(1) * 0.1).alias("lon"), (F.rand(2) * 0.1).alias("lat"))
    (row,) = sites.site_shapes(df, "site").collect()
    assert row["members"] == 200_000 and len(row["ring"]) < 3000
    assert df.join(spark.createDataFrame([row]), "site").where(~geo.in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).count() == 0


def test_dissolved_keys_have_each_polygon_once(spark):
    from voltspan.functions import wkb

    square = lambda x: [[(float(x), 0.0), (float(x), 1.0), (x + 1.0, 1.0), (float(x), 0.0)]]
    poly = lambda *xs: ("MultiPolygon" if len(xs) != 1 else "Polygon", [("Polygon", square(x)) for x in xs])
    rows = [("a", 2, "later", poly(1, 2)), ("a", 1, "first", poly(2)), ("b", 1, "bare", None), ("c", 1, "point", ("Point", [("Point", [[(0.0, 0.0)]])]))] + [("hot", i, f"n{i}", poly(i % 50)) for i in range(500)]
    df = spark.createDataFrame(rows, f"k string, o int, name string, g {wkb.GEOMETRY.simpleString()}")
    got = sites.dissolve(df, "k", "g", "o", ["name"], most=100).collect()
    parts = lambda k: sorted(m["parts"][0][0]["lon"] for r in got if r["k"] == k for m in r["g"]["members"])
    assert parts("a") == [1.0, 2.0] and parts("b") == parts("c") == [] and parts("hot") == [float(i) for i in range(50)]
    assert {r["k"]: (r["name"], r["shares"]) for r in got} == {"a": ("first", 1), "b": ("bare", 1), "c": ("point", 1), "hot": ("n0", 5)}
    assert sum(r["k"] == "hot" for r in got) > 1 and all(r["members"] == len(r["g"]["members"]) for r in got)


def test_sites_are_not_broadcast(spark):
    """There may be as many sites as members; their extents and outlines were sent through the driver."""
    members = spark.range(60).selectExpr("CAST(id AS string) AS site", "id / 10D AS lon", "40D AS lat")
    shapes = sites.site_shapes(members, "site")
    assert "BroadcastExchange" not in shapes._jdf.queryExecution().executedPlan().toString()
    assert {r.site for r in shapes.where("members = 1").collect()} == {str(i) for i in range(60)}
