import gzip
import json

from pyspark.sql import functions as F

from voltspan.sources import readers, sinks
from voltspan.streaming import snapshots


def test_csv_points(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name,LAT,Long,note\n"Plant ""A"", east",40.5x,-99,"two\nlines"\nbad,x,1,\nfar,91,1,\n')
    df = readers.points_of_csv(readers.read_csv(spark, str(tmp_path / "a.csv")))
    assert [tuple(r) for r in df.collect()] == [(-99.0, 40.5, 'Plant "A", east', "two\nlines")]


def test_geojson(spark, tmp_path):
    f = {"type": "Feature", "properties": {"a": "1"}, "geometry": {"type": "Point", "coordinates": [1.5, 2]}}
    (tmp_path / "l.json").write_text(json.dumps(f) + "\n\x1e" + json.dumps(f) + "\nnot json\n\n")
    features, bad = readers.read_geojson_lines(spark, str(tmp_path / "l.json"))
    assert features.count() == 2 and [r[0] for r in bad.collect()] == ["not json"]
    assert features.first()["properties"] == {"a": "1"}
    with gzip.open(tmp_path / "c.json.gz", "wt") as out:
        json.dump({"type": "FeatureCollection", "features": [f, f, f]}, out)
    assert readers.read_geojson(spark, str(tmp_path / "c.json.gz")).count() == 3


def test_kml(spark, tmp_path):
    (tmp_path / "a.kml").write_text("<kml><Document><Placemark><name>P</name><Point><coordinates>1.5,2.5,0</coordinates></Point></Placemark><Placemark><name>no point</name></Placemark></Document></kml>")
    assert [tuple(r) for r in readers.read_kml_points(spark, str(tmp_path / "a.kml")).collect()] == [("P", 1.5, 2.5)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1.23456789, 2.0, "a", None), (3.0, 4.0, "b", 5)], "lon double, lat double, name string, mw int")
    sinks.write_geojson_lines(df, ["name", "mw"], str(tmp_path / "g"), where="name = 'a'")
    (line,) = [r[0] for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert json.loads(line) == {"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Point", "coordinates": [1.234568, 2.0]}}
    sinks.write_tiles(df, 3, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert sinks.write_snapshot(df, str(tmp_path / "s")) and not sinks.write_snapshot(df.limit(0), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where(F.col("mw").isNull()).count() == 1


def test_feed_keeps_the_newest_snapshot(spark, tmp_path):
    feed, state, schema = tmp_path / "feed", str(tmp_path / "state"), "generated_utc string, fips string, out long"
    feed.mkdir()
    run = lambda: snapshots.run_feed(spark, str(feed), spark.createDataFrame([], schema).schema, state, str(tmp_path / "check")).awaitTermination()

    def put(name, generated, rows):
        (feed / name).write_text("".join(json.dumps({"generated_utc": generated, "fips": k, "out": v}) + "\n" for k, v in rows))

    put("1.json", "2024-01-01T00:00", [("00001", 5), ("00002", 1)])
    run()
    put("2.json", "2024-01-01T01:00", [("00001", 7)])
    run()
    put("3.json", "2024-01-01T00:30", [("00003", 9)])  # older: doesn't replace
    run()
    assert [(r["fips"], r["out"]) for r in snapshots.current(spark, state, "generated_utc").collect()] == [("00001", 7)]
