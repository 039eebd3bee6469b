"""Grids as tables."""

from pyspark.sql import functions as F

from voltspan.operators import raster


def test_samples_of_one_place_are_not_all_copied(spark):
    """3,000 samples of one place were copied to nine cells each, and each target there was paired with all of them."""
    samples = spark.range(3000).selectExpr("id", "id % 1 + 0.5D AS x", "id % 1 + 0.5D AS y", "CAST(id AS double) AS value").union(spark.createDataFrame([(5000, 0.9, 0.5, 100.0)], "id long, x double, y double, value double"))
    targets = spark.range(4).selectExpr("id AS row", "0L AS col", "0.5D + id / 10D AS x", "0.5D AS y")
    found = raster.interpolated(targets, samples, 1.0, 3, 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "windowspecdefinition(x" in plan
    got = {r.row: r.value for r in found.collect()}
    for row in range(4):
        rows = sorted((((0.5 + row / 10 - x) ** 2, i, v) for i, x, v in [*((i, 0.5, float(i)) for i in range(3000)), (5000, 0.9, 100.0)]))[:3]
        weights = [1 / (d + 0.25) for d, _, _ in rows]
        assert abs(got[row] - sum(w * v for w, (_, _, v) in zip(weights, rows, strict=True)) / sum(weights)) < 1e-9
    assert found.where(F.col("value").isNull()).count() == 0
