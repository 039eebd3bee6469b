"""Text functions on columns: tags, voltages, capacities, names, codes. All JVM-side."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of energy sources.
SOURCES = {
    "wind": "wind", "solar": "solar", "hydro": "hydro", "water": "hydro", "nuclear": "nuclear", "coal": "coal", "gas": "gas", "natural_gas": "gas", "oil": "oil",
    "petroleum": "oil", "diesel": "oil", "geothermal": "geothermal", "biomass": "biomass", "biofuel": "biomass", "waste": "biomass", "storage": "battery", "battery": "battery",
}
#: Keywords of commodity categories; the first category with a keyword wins.
COMMODITIES = (
    ("precious", ("gold", "silver", "platinum")),
    ("base", ("copper", "lead", "zinc", "nickel", "tin ", "lead-zinc", "bauxite")),
    ("ferroalloy", ("iron", "manganese", "chromium", "chromite", "molybdenum", "tungsten", "titanium", "vanadium", "ferroalloy", "cobalt")),
    ("battery", ("lithium", "rare earth", "graphite", "beryllium", "niobium", "tantalum", "columbium")),
    ("energy", ("coal", "uranium", "oil", "gas", "peat", "geothermal", "lignite", "anthracite")),
    ("gem", ("gem",)),
    ("industrial", ("stone", "sand", "gravel", "clay", "limestone", "gypsum", "cement", "lime", "sulfur", "phosphate", "potash", "salt", "barite", "talc", "feldspar", "silica", "mica", "shale", "traprock", "granite", "sandstone", "slate", "marble", "dolomite", "pumice", "perlite", "borate", "fluorspar", "kaolin", "bentonite", "diatomite", "vermiculite", "wollastonite", "zeolite", "nonmetallic", "abrasive")),
)
#: County codes of states and territories.
STATE_FIPS = {
    "AL": "01", "AK": "02", "AZ": "04", "AR": "05", "CA": "06", "CO": "08", "CT": "09", "DE": "10", "DC": "11", "FL": "12", "GA": "13", "HI": "15", "ID": "16", "IL": "17", "IN": "18", "IA": "19", "KS": "20",
    "KY": "21", "LA": "22", "ME": "23", "MD": "24", "MA": "25", "MI": "26", "MN": "27", "MS": "28", "MO": "29", "MT": "30", "NE": "31", "NV": "32", "NH": "33", "NJ": "34", "NM": "35", "NY": "36", "NC": "37",
    "ND": "38", "OH": "39", "OK": "40", "OR": "41", "PA": "42", "RI": "44", "SC": "45", "SD": "46", "TN": "47", "TX": "48", "UT": "49", "VT": "50", "VA": "51", "WA": "53", "WV": "54", "WI": "55", "WY": "56",
    "AS": "60", "GU": "66", "MP": "69", "PR": "72", "VI": "78",
}
#: Zone code prefixes of marine zones.
MARINE = ("AM", "AN", "GM", "PZ", "PK", "PH", "PM", "PS", "LE", "LH", "LM", "LO", "LC", "LS", "SL")
PLACEHOLDER = r"^(TAP\d+|DEADEND\d*|RISER\d+|\d+)$"


def mapped(value: Column, names: dict[str, str]) -> Column:
    """The value's name in a dictionary, or itself."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), value), value)


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def first_filled(*values: Column) -> Column:
    """The first value that isn't blank, trimmed."""
    return F.coalesce(*map(blank_to_null, values))


def hstore(tags: Column, key: str) -> Column:
    """The value of a key in `"k"=>"v","k2"=>"v2"`; null if it isn't there."""
    found = F.trim(F.regexp_extract(tags, rf'"{re.escape(key)}"=>"([^"]*)"', 1))
    return F.when(tags.rlike(rf'"{re.escape(key)}"=>"'), found)


def hstore_map(tags: Column) -> Column:
    """All pairs of an hstore text as a map; keys are unique."""
    keys, values = (F.regexp_extract_all(tags, F.lit(p), F.lit(1)) for p in ('"([^"]*)"=>"[^"]*"', '"[^"]*"=>"([^"]*)"'))
    return F.map_from_arrays(keys, values)


def _integers(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit("([0-9]{1,15})"), F.lit(1)), lambda x: x.cast("long"))


def best_kv(voltage: Column) -> Column:
    """The greatest positive kV of the volts in a text: every integer counts, divided by 1000; else null."""
    return F.array_max(F.filter(F.transform(_integers(voltage), lambda v: F.floor(v / 1000)), lambda k: k > 0))


def top_kv_or_unknown(voltage: Column) -> Column:
    """The greatest integer in a text divided by 1000, zero included; -1 if there is none."""
    return F.coalesce(F.floor(F.array_max(_integers(voltage)) / 1000), F.lit(-1))


def voltage_levels(voltage: Column) -> Column:
    """Distinct kV levels of a `;` list, greatest first: tokens of digits, from 1000 up volts, below that kV."""
    tokens = F.filter(F.transform(F.split(voltage, ";"), lambda t: F.trim(t)), lambda t: t.rlike("^[0-9]{1,15}$"))
    kv = F.filter(F.transform(F.transform(tokens, lambda t: t.cast("long")), lambda v: F.when(v >= 1000, F.floor(v / 1000)).otherwise(v)), lambda v: v > 0)
    return F.sort_array(F.array_distinct(kv), asc=False)


def kv_in_name(name: Column) -> Column:
    """A voltage such as `230 kV` in a name, from 1 to 2000; else null."""
    found = F.nullif(F.regexp_extract(name, r"\b(\d{2,4})\s*[Kk][Vv]\b", 1), F.lit("")).cast("int")
    return F.when(found.between(1, 2000), found)


def output_mw(text: Column) -> Column:
    """Megawatts of a capacity with a unit (MW if none; kW, GW, W), thousands commas allowed; yes, no and blanks are null."""
    value = F.trim(text)
    number = F.regexp_extract(value, r"^([0-9,.]+)", 1)
    n = F.replace(number, F.lit(","), F.lit("")).try_cast("double")
    unit = F.upper(F.regexp_extract(value, r"(?i)^[0-9,.]+\s*(MW|kW|GW|W)?", 1))
    scaled = F.when(unit == "GW", n * F.lit(1e3)).when(unit == "KW", n / F.lit(1e3)).when(unit == "W", n / F.lit(1e6)).otherwise(n)
    return F.when(~F.lower(value).isin("", "yes", "no"), scaled)


def canonical_source(source: Column) -> Column:
    """The energy source's canonical name: the first of a `;` list, lower-cased; unknown names stay."""
    return mapped(F.trim(F.split_part(F.lower(F.trim(F.coalesce(source, F.lit("")))), F.lit(";"), F.lit(1))), SOURCES)


def keyword_category(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...] = COMMODITIES) -> Column:
    """The first category one of whose keywords is in the text, whatever the case; `other` if none."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("other")
    for name, keywords in reversed(rules):
        out = F.when(reduce(operator.or_, (low.contains(k) for k in keywords)), name).otherwise(out)
    return out


def bracket_code(name: Column) -> Column:
    """The capitals in brackets of `FULL NAME (ABBR)`, without `, RE`; else the first ten characters."""
    found = F.regexp_extract(name, r"\(([A-Z]+(,\s*RE)?)\)", 1)
    code = F.trim(F.replace(F.replace(found, F.lit(","), F.lit("")), F.lit(" RE"), F.lit("")))
    return F.when(found != "", code).otherwise(F.left(name, F.lit(10)))


def without_bracket(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))


def title_case(text: Column) -> Column:
    """A capital at the start of each run of letters, small letters after it."""
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), "")


def joined(separator: str, *values: Column) -> Column:
    """The values that aren't blank, joined."""
    return F.array_join(F.filter(F.array(*(F.coalesce(F.trim(v), F.lit("")) for v in values)), lambda v: v != ""), separator)


def zone_of_url(url: Column) -> Column:
    """(type, ugc) of `/zones/<type>/<ugc>`; codes with a marine prefix are marine unless of a county. Else null."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    kind, ugc = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    fits = (F.get(parts, F.lit(0)) == "zones") & kind.isin("forecast", "fire", "county", "marine") & ugc.isNotNull()
    return F.when(fits, F.struct(F.when((kind != "county") & F.left(ugc, F.lit(2)).isin(*MARINE), "marine").otherwise(kind).alias("type"), ugc.alias("ugc")))


def county_fips(ugc: Column) -> Column:
    """The county code of a zone code `SSC###`, or null."""
    state = F.element_at(F.create_map(*(F.lit(x) for pair in STATE_FIPS.items() for x in pair)), F.left(ugc, F.lit(2)))
    return F.when(ugc.rlike("^..C[0-9]{3}$"), F.concat(state, F.substr(ugc, F.lit(4))))


def same_fips(code: Column) -> Column:
    """The county code of a six-digit area code; whole states (000) and malformed codes are null."""
    return F.when(code.rlike("^[0-9]{6}$") & ~code.endswith("000"), F.substr(code, F.lit(2)))


def hash_bucket(name: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.encode(name, "UTF-8")), F.lit(n)).cast("int")


def redacted_tokens(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)([?&]token=)[^&\s]*", "$1REDACTED")


def kml_colour(colour: Column, opacity: float = 1.0) -> Column:
    """`#rrggbb` as `aabbggrr`."""
    alpha = f"{round(opacity * 255):02x}"
    return F.when(colour.rlike("^#[0-9A-Fa-f]{6}$"), F.lower(F.concat(F.lit(alpha), F.substring(colour, 6, 2), F.substring(colour, 4, 2), F.substring(colour, 2, 2))))


def safe_html(text: Column) -> Column:
    """Markup characters as entities."""
    out = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def leading_number(text: Column) -> Column:
    """The number that a text begins with, whatever follows; else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1), F.lit("")).try_cast("double")


def safe_link(url: Column) -> Column:
    """A url for markup, without control characters and blanks; null if it would run a script."""
    plain = F.regexp_replace(url, r"[\x00-\x20]", "")
    return F.when(~F.lower(plain).startswith("javascript:"), safe_html(plain))


def clean_reference(reference: Column) -> Column:
    """A short site code of letters, digits and hyphens; null for anything else."""
    return F.when(reference.rlike(r"^[A-Za-z0-9-]{1,10}\z"), reference)


def not_pipeline(man_made: Column) -> Column:
    """Whether a line isn't tagged as a pipeline; an untagged one isn't."""
    return F.coalesce(man_made != "pipeline", F.lit(True))


def osm_link(kind: str, key: Column) -> Column:
    """The address of an element of the open map (kind: node, way or relation); empty without a key."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(f"https://www.openstreetmap.org/{kind}/"), encoded))
