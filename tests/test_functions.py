import math
import zlib

import pytest
from pyspark.sql import functions as F

from voltspan.functions import filters, geo, numeric, text
from voltspan.functions.style import compile_style
from voltspan.sources import querystate


def values(spark, inputs, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("x")).alias("y")).collect()]


@pytest.mark.parametrize(
    ("function", "inputs", "expected"),
    [
        (text.best_kv, ["138000;69000", "480", "138", None, "", "abc", "230000 V"], [138, None, None, None, None, None, 230]),
        (text.top_kv_or_unknown, ["138000", "480", "", None, "x"], [138, 0, -1, -1, -1]),
        (text.voltage_levels, ["138000;69", "138;138000", " 500 ;x", None, ""], [[138, 69], [138], [500], None, []]),
        (text.kv_in_name, ["Line 230 kV", "x 9kV", "3000 KV", None], [230, None, None, None]),
        (text.output_mw, ["5 MW", "1,500 kW", "2 GW", "100 W", "yes", "", None, "7", "1.2.3 MW", "about 5"], [5.0, 1.5, 2000.0, 0.0001, None, None, None, 7.0, None, None]),
        (text.canonical_source, ["Water", "petroleum;gas", "tidal", None], ["hydro", "oil", "tidal", ""]),
        (text.keyword_category, ["Gold and copper", "TIN ORE", "sandstone", None, "water"], ["precious", "base", "industrial", "other", "other"]),
        (text.title_case, ["O'NEIL LAKE-WEST 2ND", "", None], ["O'Neil Lake-West 2Nd", "", None]),
        (text.bracket_code, ["WESTERN COUNCIL (WECC)", "RELIABILITY (SERC, RE)", "nothing here at all"], ["WECC", "SERC", "nothing he"]),
        (text.county_fips, ["TXC001", "QQC001", "TXZ001", "TX", None], ["48001", None, None, None, None]),
        (text.same_fips, ["048001", "048000", "48001", None], ["48001", None, None, None]),
        (text.leading_number, ["12abc", "-3.5e2 m", "x1", "", None], [12.0, -350.0, None, None, None]),
        (text.kml_colour, ["#AABBCC", "red", None], ["ffccbbaa", None, None]),
        (text.safe_html, ['<a href="x">&'], ["&lt;a href=&quot;x&quot;&gt;&amp;"]),
        (text.redacted_tokens, ["u?token=abc&x=1", "u?a=1&TOKEN=z"], ["u?token=REDACTED&x=1", "u?a=1&TOKEN=REDACTED"]),
    ],
)
def test_text(spark, function, inputs, expected):
    assert values(spark, inputs, function) == expected


def test_hash_bucket_is_crc32(spark):
    names = ["AEP", "ñandú", ""]
    assert values(spark, names, lambda x: text.hash_bucket(x, 6)) == [zlib.crc32(n.encode()) % 6 for n in names]


def test_hstore(spark):
    tags = ['"name"=>"A","ref"=>" 7 "', None, ""]
    assert values(spark, tags, lambda x: text.hstore(x, "ref")) == ["7", None, None]
    assert values(spark, tags, text.hstore_map)[0] == {"name": "A", "ref": " 7 "}


def test_ranges(spark):
    assert values(spark, [0.0, 0.1, 50.0, 600.0, -1.0, None], numeric.kv_range, "double") == ["unknown", "0-50", "50-100", "600+", "unknown", "unknown"]
    assert values(spark, [0.0, 5.0, 999.0, 1000.0, -1.0], numeric.mw_range, "double") == ["0-5", "5-10", "500-1000", "1000+", None]


def test_rounding_is_half_even(spark):
    assert values(spark, [0.25, 0.35, None], lambda x: numeric.encode_int16(x, 10, -9999), "double") == [2, 4, -9999]


def test_alive(spark):
    rows = spark.createDataFrame([(1990, 2000), (None, None), (2001, 0), (1990, 1995)], "a int, b int")
    assert [r[0] for r in rows.select(numeric.alive(1999, F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


def test_geometry(spark):
    one = spark.range(1)
    degree = one.select(geo.haversine(*(F.lit(float(x)) for x in (0, 0, 1, 0)))).first()[0]
    assert abs(degree - 111195.08) < 0.01
    ring = F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))))
    area, inside, out = one.select(geo.ring_area(ring), geo.in_ring(F.lit(0.5), F.lit(0.5), ring), geo.in_ring(F.lit(1.5), F.lit(0.5), ring)).first()
    assert abs(area / 12391399902 - 1) < 0.01 and inside and not out


def interpret(e, row):
    """A plain interpreter of the expressions below."""
    if not isinstance(e, list):
        return e
    op, *a = e
    go = lambda x: interpret(x, row)
    if op == "get":
        return row[a[0]]
    if op == "to-number":
        try:
            return float(go(a[0]))
        except (TypeError, ValueError):
            return go(a[1]) if len(a) > 1 else 0.0
    if op in (">=", "<"):
        v = go(a[0])
        return v is not None and (v >= go(a[1]) if op == ">=" else v < go(a[1]))
    if op == "in":
        return go(a[0]) in a[1][1]
    if op == "!":
        return not go(a[0])
    if op == "all":
        return all(map(go, a))
    if op == "any":
        return any(map(go, a))
    if op == "match":
        v = go(a[0])
        return next((r for k, r in zip(a[1:-1:2], a[2:-1:2]) if v in (k if isinstance(k, list) else [k])), a[-1])
    raise AssertionError(op)


@pytest.mark.parametrize(
    "expr",
    [
        ["all", [">=", ["to-number", ["get", "s"], -1], 5], ["<", ["to-number", ["get", "s"], -1], 50]],
        ["any", ["in", ["get", "k"], ["literal", ["a", "b"]]], ["!", ["in", ["get", "k"], ["literal", ["a", "b", "c"]]]]],
        ["match", ["get", "k"], ["a", "b"], "first", "c", "second", "none"],
        ["all"],
        ["any"],
    ],
)
def test_style_like_an_interpreter(spark, expr):
    rows = [{"s": s, "k": k} for s in (None, "", "5", "49.9", "50", "x") for k in (None, "a", "c", "z")]
    df = spark.createDataFrame([(i, r["s"], r["k"]) for i, r in enumerate(rows)], "i int, s string, k string")
    assert [r[0] for r in df.orderBy("i").select(compile_style(expr)).collect()] == [interpret(expr, r) for r in rows]


def test_filters_that_keep_all_are_none():
    assert filters.kv_buckets("kv", None) is None and filters.kv_buckets("kv", filters.KV_BUCKETS) is None
    assert filters.mw_between("mw", 0, 10_000) is None
    assert filters.value_buckets("f", {"a", "other"}, {"a": ["A"]}, ["a", "other"]) is None


def test_query_state_round_trip():
    state = querystate.QueryState(5.0, 41.5, -99.25, frozenset({"lines", "gas,oil"}), frozenset({"<100"}), (5, 500), 2001)
    found = querystate.decode(querystate.encode(state), {"lines"}, {"<100", "550+"})
    assert found == querystate.QueryState(5.0, 41.5, -99.25, frozenset({"lines"}), frozenset({"<100"}), (5, 500), 2001)
    assert querystate.decode("#bad", set(), set()) == querystate.QueryState()


def test_a_point_inside_is_computed_once(spark):
    """Its parts were named in functions of arrays in functions of arrays, and computed anew for each element of each."""
    ring = [(math.cos(i / 30 * math.pi), math.sin(i / 30 * math.pi)) for i in range(60)]
    df = spark.createDataFrame([([[*ring, ring[0]]],)] * 200, "rings array<array<struct<lon:double,lat:double>>>").select(geo.inside_point(F.col("rings")).alias("p"))
    assert df._jdf.queryExecution().analyzed().toString().count("flatten") <= 8
    assert all(abs(r.p.lon) < 1e-9 and abs(r.p.lat) < 0.06 for r in df.collect())
