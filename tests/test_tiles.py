"""Tile pyramids."""

import math
import re

from pyspark.sql import functions as F

from voltspan.operators import tiles


def test_no_tile_is_over_its_budget(spark):
    points = spark.range(5000).select("id", (F.rand(1) * 2 - 100).alias("lon"), (F.rand(2) * 2 + 40).alias("lat"), (F.col("id") % 40).cast("int").alias("rank"), (F.col("id") % 64).alias("tie"))
    pieces = tiles.point_pieces(points, 0, 8).cache()
    kept = tiles.within_budget(pieces, "rank", "tie", 3000).cache()
    sums = {tuple(r[:3]): r[3] for r in kept.groupBy(*tiles.TILE).agg(F.sum("bytes")).collect()}
    whole = {tuple(r[:3]): r[3] for r in pieces.groupBy(*tiles.TILE).agg(F.sum("bytes")).collect()}
    assert max(sums.values()) <= 3000 and all(sums[t] == n for t, n in whole.items() if n <= 3000)
    assert all(n > 1000 for t, n in sums.items() if whole[t] > 3000)
    lowest = {tuple(r[:3]): r[3] for r in kept.groupBy(*tiles.TILE).agg(F.min("rank")).collect()}
    gone = {tuple(r[:3]): r[3] for r in pieces.join(kept, ["id", *tiles.TILE], "left_anti").groupBy(*tiles.TILE).agg(F.max("rank")).collect()}
    assert gone and all(lowest[t] >= r for t, r in gone.items())


def test_lines_are_clipped_to_their_tiles(spark):
    zigzag = [(-100.0 + 0.7 * i, 40.0 + (3.0 if i % 2 else -2.0)) for i in range(9)]
    df = spark.createDataFrame([(1, zigzag), (2, [(10.0, 10.0), (10.0000001, 10.0)]), (3, [(5.0, 5.0)]), (4, []), (5, [(0.1, 51.0), (0.1, 51.0), (0.2, 51.1)])], "id int, line array<struct<lon:double,lat:double>>")
    rows = tiles.line_pieces(df, "id", "line", 3, 9).collect()
    assert {r["id"] for r in rows} == {1, 5}
    for r in rows:
        assert all(0 <= s[c] <= tiles.EXTENT for s in r["sides"] for c in ("x0", "y0", "x1", "y1"))
        for a, b in zip(r["sides"][:-1], r["sides"][1:], strict=True):  # in order; joined where the line stays in the tile
            assert (a["x1"], a["y1"]) == (b["x0"], b["y0"]) or min(a["x1"], a["y1"], tiles.EXTENT - a["x1"], tiles.EXTENT - a["y1"]) < 1e-6
    for z in range(3, 10):
        world = lambda p: (math.floor((p[0] + 180) / 360 * 2**z * tiles.EXTENT), math.floor((1 - math.log(math.tan(math.pi / 4 + math.radians(p[1]) / 2)) / math.pi) / 2 * 2**z * tiles.EXTENT))
        steps = [world(p) for p in zigzag]
        whole = sum(math.dist(a, b) for a, b in zip(steps[:-1], steps[1:], strict=True))
        cut = sum(math.hypot(s["x1"] - s["x0"], s["y1"] - s["y0"]) for r in rows if r["zoom"] == z and r["id"] == 1 for s in r["sides"])
        assert abs(cut - whole) < 1e-6 * whole + 3  # a step on either side of a floor


def test_a_viewport_reads_its_own_files(spark, tmp_path):
    points = spark.range(2000).select("id", (F.col("id") % 50 * 0.3 - 100).alias("lon"), (F.floor(F.col("id") / 50) * 0.3 + 30).alias("lat"))
    tiles.write_pyramid(tiles.point_pieces(points, 6, 9), str(tmp_path / "p"))
    shown = tiles.viewport(spark, str(tmp_path / "p"), 9, -97.0, 33.0, -95.0, 35.0)
    plan = shown._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block_x[^\]]*block_y", plan) and "PushedFilters: [IsNotNull(x)" in plan
    files = {r[0] for r in shown.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(files) < sum(1 for _ in (tmp_path / "p").rglob("*.parquet")) / 10
    assert {r["id"] for r in shown.where("px >= 0").collect()} >= {r["id"] for r in points.where("lon BETWEEN -97 AND -95 AND lat BETWEEN 33 AND 35").collect()}
    assert shown.count() < 500


def test_a_pyramid_without_pieces_is_read(spark, tmp_path):
    """Where no tile has room for anything, no file was there to tell the schema, and the viewport raised."""
    points = spark.range(10).select("id", (F.col("id") - 100.0).alias("lon"), F.lit(40.0).alias("lat"), F.lit(1).alias("rank"), F.lit(1).alias("tie"))
    pieces = tiles.within_budget(tiles.point_pieces(points, 3, 5), "rank", "tie", 1)
    tiles.write_pyramid(pieces, str(tmp_path / "p"))
    shown = tiles.viewport(spark, str(tmp_path / "p"), 4, -100.0, 30.0, -90.0, 50.0)
    assert shown.count() == 0 and {"id", "x", "y", "px", "py"} <= set(shown.columns)


def test_lines_are_cut_in_their_rows(spark):
    """Sides were shuffled one by one and gathered again, and each was asked of all tiles of its box: 67 million at zoom 13 here."""
    rows = [(1, [(-179.0, 80.0), (179.0, -80.0)]), (2, None), (3, [(0.0, 0.0), (None, 1.0), (0.2, 0.0), (0.4, 0.0)])]
    pieces = tiles.line_pieces(spark.createDataFrame(rows, "id int, line array<struct<lon:double,lat:double>>"), "id", "line", 13, 13)
    assert "Exchange" not in pieces._jdf.queryExecution().executedPlan().toString()
    got = pieces.collect()
    assert {r["id"] for r in got} == {1, 3} and 8000 < sum(r["id"] == 1 for r in got) < 20_000
    length = sum(math.hypot(s["x1"] - s["x0"], s["y1"] - s["y0"]) for r in got if r["id"] == 3 for s in r["sides"])
    assert abs(length - 0.2 / 360 * 2**13 * tiles.EXTENT) < 2
