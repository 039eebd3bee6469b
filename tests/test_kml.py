"""KML and KMZ, read and written."""

import zipfile

import pytest

from tests.test_geoparquet import SHAPES, plain
from voltspan.functions import wkb
from voltspan.sources import kml

DOCUMENT = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>doc</name>
<Style id="s"><LineStyle><color>7f0000ff</color><width>2.5</width></LineStyle></Style>
<StyleMap id="m"><Pair><key>highlight</key><styleUrl>#none</styleUrl></Pair><Pair><key>normal</key><styleUrl>#s</styleUrl></Pair></StyleMap>
<Folder><name>Lines &amp; more</name><Folder><name>inner</name>
<Placemark><name>line</name><styleUrl>#m</styleUrl><LineString><coordinates>1,2,3 4,5 bad 6,x 7,8</coordinates></LineString></Placemark></Folder>
<Placemark><styleUrl>#s</styleUrl><Style><PolyStyle><color>ff102030</color></PolyStyle></Style><ExtendedData><Data name="a"><value> 1 </value></Data><SchemaData><SimpleData name="b">two</SimpleData></SchemaData></ExtendedData>
<Polygon><innerBoundaryIs><LinearRing><coordinates>0.2,0.2 0.4,0.2 0.4,0.4 0.2,0.2</coordinates></LinearRing></innerBoundaryIs><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Folder>
<Placemark><name>mixed</name><description><![CDATA[<b>x</b>]]></description><MultiGeometry><Point><coordinates>1,2</coordinates></Point><LineString><coordinates>1,2 3,4</coordinates></LineString></MultiGeometry></Placemark>
<Placemark><name>nothing</name></Placemark></Document></kml>"""


def check(rows):
    line, polygon, mixed, nothing = rows
    assert line["folders"] == ["Lines & more", "inner"] and (line["stroke"], line["stroke_opacity"], line["stroke_width"]) == ("#ff0000", 0.5, 2.5)
    assert plain(line["geometry"]) == ("LineString", [("LineString", [[(1.0, 2.0), (4.0, 5.0), (7.0, 8.0)]])])
    assert polygon["attributes"] == {"a": "1", "b": "two"} and polygon["fill"] == "#302010" and polygon["stroke"] == "#ff0000" and polygon["name"] is None
    assert [len(r) for r in polygon["geometry"]["members"][0]["parts"]] == [4, 4] and polygon["geometry"]["members"][0]["parts"][0][1]["lon"] == 1.0
    assert mixed["folders"] == [] and mixed["description"] == "<b>x</b>" and mixed["geometry"]["kind"] == "GeometryCollection"
    assert nothing["geometry"] is None and nothing["stroke"] is None


def test_folders_styles_holes_and_zips(spark, tmp_path):
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.kml").write_text(DOCUMENT)
    check(kml.read_kml(spark, str(tmp_path / "plain")).collect())
    (tmp_path / "zip").mkdir()
    with zipfile.ZipFile(tmp_path / "zip" / "b.KMZ", "w") as z:
        z.writestr("doc.kml", DOCUMENT)
        z.writestr("images/x.png", b"no placemarks")
    rows = kml.read_kml(spark, str(tmp_path / "zip")).collect()
    check(rows)
    assert rows[0]["member"] == "doc.kml" and kml.read_kml(spark, str(tmp_path / "zip" / "b.KMZ")).count() == 4


@pytest.mark.parametrize("zipped", [False, True])
def test_what_is_written_comes_back(spark, tmp_path, zipped):
    shapes = [s if s is None or s[1] else None for s in SHAPES]  # an empty geometry is none
    rows = [(i, f"n <{i}> & 'x'" if i % 3 else None, "#0a0b0c" if i % 2 else None, 0.4, 1.5 if i % 2 else None, f"f{i % 2}", 'q"<' if i else None, s) for i, s in enumerate(shapes)]
    df = spark.createDataFrame(rows, f"id int, name string, stroke string, stroke_opacity double, stroke_width double, folder string, note string, geometry {wkb.GEOMETRY.simpleString()}")
    assert kml.write_kml(df.repartition(2, "id"), str(tmp_path / "k"), ["id", "note"], folder="folder", zipped=zipped) == 2
    back = {int(r["attributes"]["id"]): r for r in kml.read_kml(spark, str(tmp_path / "k")).collect()}
    for i, name, stroke, opacity, width, folder, note, shape in rows:
        r = back[i]
        assert (r["name"], r["stroke"], r["stroke_opacity"], r["stroke_width"], r["folders"], r["attributes"].get("note"), plain(r["geometry"])) == (name, stroke, opacity if stroke else None, width, [folder], note, shape)


def test_colours():
    assert kml.colour("80ff8000") == ("#0080ff", 0.5) and kml.colour("#ff0000ff") == ("#ff0000", 1.0)
    assert kml.colour("red") == kml.colour(None) == kml.colour("ff00") == (None, None)


def test_a_partition_becomes_files_of_bounded_size(spark, tmp_path):
    """A partition was one file, however large, and a reader held all its elements."""
    df = spark.range(3000).selectExpr("CAST(id AS string) AS id", "concat('n', id) AS name", "concat('f', id % 3) AS folder").coalesce(1)
    assert kml.write_kml(df, str(tmp_path / "k"), ["id"], folder="folder", most=20_000) > 10
    assert max(f.stat().st_size for f in (tmp_path / "k").glob("*.kml")) < 25_000
    back = kml.read_kml(spark, str(tmp_path / "k")).collect()
    assert sorted((int(r["attributes"]["id"]), r["name"], r["folders"]) for r in back) == [(i, f"n{i}", [f"f{i % 3}"]) for i in range(3000)]
    last = "<Style id='s'><LineStyle><color>7f0000ff</color></LineStyle></Style>"
    marks = "".join(f"<Placemark><name>{i}</name><styleUrl>#s</styleUrl></Placemark>" for i in range(5000))
    some, held = kml.placemarks(f"<kml><Document><Folder>{marks}<name>a</name></Folder>{last}</Document></kml>".encode()), []
    for p in some:
        if len(held) % 1000 == 0:
            around = some.gi_frame.f_locals["around"]
            assert sum(len(n) for n in around) < 1000
        held.append((p["name"], p["folders"], p["stroke"]))
    assert held == [(str(i), ["a"], "#ff0000") for i in range(5000)]
