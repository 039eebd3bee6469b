"""Numbers and times on columns: conversions, ranges, formulas, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edges of the classes; a class holds its lower edge.
KV_EDGES, MW_EDGES = (0, 50, 100, 200, 300, 400, 500, 600), (0, 5, 10, 20, 100, 500, 1000)


def number(value: Column, default: float | None = None) -> Column:
    """A number of whatever type, also from text; blank and bad values give the default."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(default).cast("double"))


def cut(value: Column, edges: tuple[int, ...], unknown: str | None = None, positive: bool = False) -> Column:
    """The label `lo-hi` of the class of a value, `lo+` for the last; `unknown` for nulls, values below, and zero if it must be positive."""
    out = F.lit(unknown)
    for lo, hi in zip(edges, (*edges[1:], None), strict=True):
        within = (value > lo if positive and lo == 0 else value >= lo) & (F.lit(True) if hi is None else value < hi)
        out = F.when(within, f"{lo}+" if hi is None else f"{lo}-{hi}").otherwise(out)
    return out


def kv_range(kv: Column) -> Column:
    return cut(kv, KV_EDGES, "unknown", positive=True)


def mw_range(mw: Column) -> Column:
    return cut(mw, MW_EDGES)


def sentinel_to_null(value: Column, sentinel: float = -999999) -> Column:
    return F.when(value > sentinel, value)


def relative_humidity(celsius: Column, dew_point: Column) -> Column:
    """Per cent, by Magnus' formula, within 0 and 100."""
    pressure = lambda t: F.exp(F.lit(17.625) * t / (F.lit(243.04) + t))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) * pressure(dew_point) / pressure(celsius)))


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def log_population(value: Column) -> Column:
    return F.when(value > 0, F.log10(value + 1)).otherwise(F.lit(0.0))


def encode_int16(value: Column, scale: float, nodata: int) -> Column:
    """Scaled and rounded half to even; null becomes nodata."""
    return F.coalesce(F.bround(value * F.lit(float(scale)), 0), F.lit(float(nodata))).cast("short")


def decode_int16(value: Column, scale: float, nodata: int) -> Column:
    return F.when(value > nodata, value / F.lit(float(scale)))


SLIDER_TOP = 4000


def slider_to_mw(position: Column) -> Column:
    """A logarithmic slider: ten to the power of a thousandth of the position, rounded half up; 0 at and below its start, its end's value beyond it."""
    mw = F.floor(F.pow(F.lit(10.0), F.least(position, F.lit(SLIDER_TOP)) / F.lit(1000.0)) + F.lit(0.5))
    return F.when(position <= 0, F.lit(0).cast("long")).otherwise(mw)


def mw_to_slider(mw: Column) -> Column:
    """The slider's position for a number of megawatts, rounded half up and kept on the slider; 0 for none."""
    place = F.least(F.greatest(F.lit(1000.0) * F.log10(mw), F.lit(0.0)), F.lit(float(SLIDER_TOP)))
    return F.when(mw <= 0, F.lit(0).cast("long")).otherwise(F.floor(place + F.lit(0.5)))


def epoch_ms_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd'T'HH:mm'Z'")


def julian_time(text: Column) -> Column:
    """`YYYYDDD HHMM` as a time; without the hour midnight; bad text null."""
    whole = F.when(text.rlike("^[0-9]{7}$"), F.concat(text, F.lit(" 0000"))).otherwise(text)
    return F.when(whole.rlike("^[0-9]{7} [0-9]{4}$"), F.try_to_timestamp(whole, F.lit("yyyyDDD HHmm")))


def date_and_hhmm(date: Column, hhmm: Column) -> Column:
    return F.try_to_timestamp(F.concat(date, F.lit(" "), F.lpad(hhmm, 4, "0")), F.lit("yyyy-MM-dd HHmm"))


def age_hours(then: Column, now: Column) -> Column:
    """Hours between two times, one decimal, half to even."""
    return F.bround((F.unix_micros(now) - F.unix_micros(then)) / F.lit(3.6e9), 1)


def age_text(minutes: Column) -> Column:
    """42m, 3h 5m, 2d 1h."""
    h, m = F.floor(minutes / 60), F.pmod(minutes, F.lit(60))
    text = lambda x, unit: F.concat(x.cast("long").cast("string"), F.lit(unit))
    days = F.concat_ws(" ", text(F.floor(h / 24), "d"), text(F.pmod(h, F.lit(24)), "h"))
    return F.when(h >= 24, days).when(h > 0, F.concat_ws(" ", text(h, "h"), text(m, "m"))).otherwise(text(m, "m"))


def age_text_short(minutes: Column) -> Column:
    """Only the largest unit, rounded half up."""
    min_ = F.greatest(minutes, F.lit(0))
    h = F.floor(min_ / 60 + F.lit(0.5))
    text = lambda x, unit: F.concat(x.cast("long").cast("string"), F.lit(unit))
    return F.when(min_ < 60, text(min_, "m")).when(h < 24, text(h, "h")).otherwise(text(F.floor(h / 24 + F.lit(0.5)), "d"))


def alive(year: int | Column, start: Column, end: Column) -> Column:
    """In service in a year: from the start (missing: always) until the end (missing, zero or negative: never)."""
    until = F.when(F.coalesce(end, F.lit(0)) <= 0, 9999).otherwise(end)
    return (F.coalesce(start, F.lit(0)) <= year) & (F.lit(year) < until if isinstance(year, int) else year < until)


def rescaled(value: Column, low: float, high: float, top: float) -> Column:
    """`low` to `high` spread over 0 to `top`, rounded half to even, within these."""
    share = (value - F.lit(float(low))) / F.lit(float(high - low)) * F.lit(float(top))
    return F.bround(F.least(F.lit(float(top)), F.greatest(F.lit(0.0), share)), 0)


def cycles(now: Column, back: int, hours: int = 6) -> Column:
    """The start of the model cycle that a time is in, and of the `back` cycles before it, newest first."""
    width = hours * 3600
    newest = F.floor(F.unix_timestamp(now) / width) * width
    return F.transform(F.sequence(F.lit(0), F.lit(back)), lambda i: F.timestamp_seconds(newest - i * width))
