"""Spatial joins against all pairs, at the equator, near the poles and across the antimeridian."""

import math
import random

import pytest

from voltspan.operators import spatial


def metres(a, b):
    (lon1, lat1), (lon2, lat2) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize(("lon", "lat", "spread"), [(0, 0, 0.05), (-180, 50, 0.05), (179.99, -60, 0.05), (20, 83, 0.2), (0, 89.99, 180), (0, -90, 180), (-180, 0, 0.02)])
def test_pairs_like_brute_force(spark, lon, lat, spread):
    rng = random.Random(int(lat))
    place = lambda: ((lon + rng.uniform(-spread, spread) + 540) % 360 - 180, max(-90.0, min(90.0, lat + rng.uniform(-0.04, 0.04))))
    a, b = [place() for _ in range(80)], [place() for _ in range(80)]
    left, right = (spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], f"{k} long, lon double, lat double") for x, k in ((a, "i"), (b, "j")))
    want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if metres(p, q) < 1000}
    got = [(r.i, r.j) for r in spatial.within_radius(left, right, 1000.0, "i", "j").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    alone = {r.i for r in spatial.without_neighbours(left, right, 1000.0).collect()}
    least = [min(metres(p, q) for q in b) for p in a]  # of chords, on a sphere a little smaller
    assert {i for i, m in enumerate(least) if m > 1001} <= alone <= {i for i, m in enumerate(least) if m > 999}


def test_copies_of_places_make_no_pairs_and_no_broadcast(spark):
    """400 x 400 points of one place: the copies in reach were broadcast whole, and each point met each."""
    points = spark.range(400).selectExpr("id AS i", "id % 1 + 10.0D AS lon", "id % 1 + 50.0D AS lat")
    others = spark.range(400).selectExpr("id + 7 AS j", "id % 1 + 10.0D AS lon", "id % 1 + 50.0D AS lat")
    near, alone = spatial.nearest_within(points, others, 500.0, "i", "j"), spatial.without_neighbours(points, others.limit(0), 500.0)
    for df in (near, alone, spatial.without_neighbours(points, others, 500.0), spatial.within_radius(points, others, 500.0, "i", "j")):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.i, r.j) for r in near.collect()} == {(i, 7) for i in range(400)} and alone.count() == 400
    assert spatial.without_neighbours(points, others, 500.0).count() == 0
    assert spatial.within_radius(points, others, 500.0, "i", "j").count() == 160_000
