"""Published versions, their statistics, and variables of variables."""

import graphlib

import pytest
from pyspark.sql import functions as F

from voltspan.operators.layers import ShownLayer, shown, shown_parts
from voltspan.operators.variables import Variable, evaluate, in_order, readings
from voltspan.sources import publication


def frame(spark, n):
    return spark.range(n).withColumn("name", F.concat(F.lit("n"), "id"))


def test_a_version_replaces_another_and_statistics_go_with_it(spark, tmp_path):
    path = str(tmp_path / "p")
    assert publication.live_manifest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        publication.read_live(spark, path)
    counts = {"even": F.col("id") % 2 == 0, "unknown": F.when(F.col("id") > 100, True)}
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("publish", "one job")
    assert publication.publish(frame(spark, 7), path, counts) == {"rows": 7, "even": 4, "unknown": 0}
    assert len(jobs.getJobIdsForGroup("publish")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    before = publication.read_live(spark, path)
    assert publication.publish(frame(spark, 0), path) is None  # nothing to publish: the last good version stays
    assert publication.publish(frame(spark, 3), path) == {"rows": 3}
    assert before.count() == 7 and publication.read_live(spark, path).count() == 3
    assert publication.live_manifest(spark, f"file://{path}")["stats"] == {"rows": 3}
    assert publication.merged({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 5}


def test_a_job_that_dies_between_the_steps_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    publication.publish(frame(spark, 5), path)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(publication, "make_live", dies)
        with pytest.raises(RuntimeError):
            publication.publish(frame(spark, 9), path)
    assert publication.read_live(spark, path).count() == 5
    failing = frame(spark, 9).withColumn("x", F.raise_error(F.lit("bad row")).cast("string"))
    with pytest.raises(Exception, match="bad row"):
        publication.publish(failing, path)
    assert publication.read_live(spark, path).count() == 5
    assert publication.collect_versions(spark, path, 0) == []  # those that came later may yet be named
    publication.publish(frame(spark, 2), path)
    assert len(publication.collect_versions(spark, path, 3600)) == 0
    gone = publication.collect_versions(spark, path, 0)
    assert len(gone) == 3 and len(list((tmp_path / "p" / "versions").iterdir())) == 1
    assert publication.read_live(spark, path).count() == 2


def test_a_failed_reading_takes_its_dependants_only(spark):
    graph = [Variable("d", ("c", "x"), lambda c, x: c + x), Variable("c", ("b",), lambda b: b * 2), Variable("b", ("y",), lambda y: y + 1), Variable("a", ("x",), lambda x: -x)]
    names = [v.name for v in in_order(graph)]
    assert names.index("b") < names.index("c") < names.index("d") and sorted(names) == ["a", "b", "c", "d"]
    rows = spark.createDataFrame([(s, raw, float(v)) for s in (0, 1) for raw, v in (("x", 10), ("y", 3), ("z", 1))], "step int, raw string, value double")
    cells = readings(rows, ["step"], "raw", "value", ["x", "y"])
    failed = spark.createDataFrame([(1, "y"), (1, "y")], "step int, raw string")
    got = {(r["step"], r["variable"]): (r["value"], r["status"]) for r in evaluate(cells, ["step"], graph, "step", failed).collect()}
    assert got == {(0, "a"): (-10, "ok"), (0, "b"): (4, "ok"), (0, "c"): (8, "ok"), (0, "d"): (18, "ok"), (1, "a"): (-10, "ok"), (1, "b"): (None, "failed"), (1, "c"): (None, "failed"), (1, "d"): (None, "failed")}
    before = spark.createDataFrame([(1, "d", 99.0), (1, "a", 1.0)], "step int, variable string, value double")
    got = {(r["step"], r["variable"]): (r["value"], r["status"]) for r in evaluate(cells, ["step"], graph, "step", failed, before).collect()}
    assert got[1, "d"] == (99.0, "previous") and got[1, "a"] == (-10, "ok") and got[1, "c"] == (None, "failed")
    plan = evaluate(cells, ["step"], graph, "step")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Join" not in plan


def test_graphs_that_cannot_be_evaluated(spark):
    same = lambda x: x
    with pytest.raises(graphlib.CycleError):
        in_order([Variable("a", ("b",), same), Variable("b", ("a",), same)])
    with pytest.raises(ValueError):
        in_order([Variable("a", (), same), Variable("a", (), same)])
    with pytest.raises(ValueError):
        evaluate(spark.range(1), ["id"], [Variable("a", ("nothing",), same)], "id")


def test_modes_as_columns_are_modes_as_functions(spark):
    known = (ShownLayer("one", ("p", "q", "r"), "q", (("icons", ("p",)), ("heat", ("q", "r")))), ShownLayer("two", ("s", "t"), "s"))
    rows = [(x, m) for x in ("one", "two", "three") for m in ("icons", "heat", "both", "off", "odd", None)]
    df = spark.createDataFrame(rows, "layer string, mode string")
    got = {(r[0], r[1]): r[2] for r in df.select("*", shown(F.col("layer"), F.col("mode"), known, "off")).collect()}
    assert got == {(x, m): next((list(shown_parts(k, m != "off", m)) for k in known if k.name == x), None) for x, m in rows}
