"""Filters over buckets and ranges, as columns. A filter that keeps all is None."""

from __future__ import annotations

import operator
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltspan.functions.numeric import alive, number

#: Bounds of the voltage buckets (at least, below); None is open. Unknown is zero and below.
KV_BUCKETS = {"550+": (550, None), "500-549": (500, 550), "300-499": (300, 500), "200-299": (200, 300), "100-199": (100, 200), "<100": (0, 100), "unknown": (None, 0)}
MW_OPEN = 10_000


def any_of(conditions: list[Column]) -> Column:
    return reduce(operator.or_, conditions, F.lit(False))


def combined(*filters: Column | None) -> Column:
    """All filters that aren't None; true for none."""
    return reduce(operator.and_, (f for f in filters if f is not None), F.lit(True))


def value_buckets(field: str, active: Collection[str] | None, buckets: dict[str, list[str]], all_ids: Collection[str]) -> Column | None:
    """Values of the active buckets; `other` is whatever no bucket names, missing values included."""
    if active is None or len(active) == len(all_ids):
        return None
    allowed = [v for k, own in buckets.items() if k in active for v in own]
    conditions = [F.coalesce(F.col(field).isin(allowed), F.lit(False))] if allowed else []
    if "other" in active:
        conditions.append(~F.coalesce(F.col(field).isin([v for own in buckets.values() for v in own]), F.lit(False)))
    return any_of(conditions)


def kv_bucket(kv: Column) -> Column:
    """The voltage bucket of a number or text; bad and missing values are unknown."""
    value, out = number(kv, -1.0), F.lit("unknown")
    for name, (lo, hi) in KV_BUCKETS.items():
        if lo is not None:
            out = F.when((value > lo if lo == 0 else value >= lo) & (F.lit(True) if hi is None else value < hi), name).otherwise(out)
    return out


def kv_buckets(field: str, active: Collection[str] | None) -> Column | None:
    if active is None or len(active) == len(KV_BUCKETS):
        return None
    return kv_bucket(F.col(field)).isin(list(active)) if active else F.lit(False)


def mw_between(field: str, least: float, most: float) -> Column | None:
    """A range whose ends are open at 0 and below and at MW_OPEN and above; a missing value counts as 0."""
    value = number(F.col(field), 0.0)
    return combined(None if least <= 0 else value >= least, None if most >= MW_OPEN else value <= most) if least > 0 or most < MW_OPEN else None


def alive_in(year: int, start: str, end: str) -> Column:
    return alive(year, F.col(start), F.col(end))


def fuel(field: str, mover: str, active: Collection[str], buckets: dict[str, list[str]]) -> Column | None:
    """Fuel buckets, where pumped storage (mover PS) is apart from other hydro (WAT)."""
    if set(active) >= {*buckets, "hydro", "pumped_storage"}:
        return None
    rest = [v for k, own in buckets.items() if k in active and k not in ("hydro", "pumped_storage") for v in own]
    known = [v for own in buckets.values() for v in own]
    conditions = [F.coalesce(F.col(field).isin(rest), F.lit(False))] if rest else []
    if "other" in active:
        conditions.append(~F.coalesce(F.col(field).isin(known), F.lit(False)))
    water, pumped = F.col(field).eqNullSafe("WAT"), F.col(mover).eqNullSafe("PS")
    if "hydro" in active and "pumped_storage" in active:
        conditions.append(water)
    elif "hydro" in active:
        conditions.append(water & ~pumped)
    elif "pumped_storage" in active:
        conditions.append(pumped)
    return any_of(conditions)


def has_text(fields: list[str], query: str) -> Column:
    """Whether a field holds the query, whatever the case; queries under two characters match nothing."""
    needle = query.strip().lower()
    return any_of([F.coalesce(F.lower(F.col(f)).contains(needle), F.lit(False)) for f in fields]) if len(needle) >= 2 else F.lit(False)


#: Global fuels, and the bucket of each in the sources that name it otherwise.
FUELS = ("wind", "solar", "hydro", "pumped_storage", "nuclear", "coal", "gas", "oil", "storage", "geo", "biomass", "other")
FUEL_NAMES = {"osm": {"storage": "battery", "geo": "geothermal"}, "eia": {}}
#: What is shown before a user filters anything.
DEFAULTS = {"mw_min": 0, "mw_max": 10_000, "year": 2025, "year_min": 1900, "year_max": 2031, "year_enabled": False}


def source_fuels(active: Collection[str], source: str) -> list[str]:
    """The buckets of a source for active global fuels; names that are no fuel are ignored."""
    return [FUEL_NAMES[source].get(f, f) for f in FUELS if f in active]


def source_bucket(fuel: Column, source: Column) -> Column:
    """The bucket of a source (a key of FUEL_NAMES) for a global fuel; null for what is no fuel, the fuel itself for other sources."""
    own = F.create_map(*(F.lit(x) for s, names in FUEL_NAMES.items() for f, name in names.items() for x in (f"{s} {f}", name)))
    return F.when(fuel.isin(*FUELS), F.coalesce(own[F.concat_ws(" ", source, fuel)], fuel))


def by_defaults(mw: str, start: str, end: str, mw_range: tuple[float, float] | None = None, year: int | None = None, year_enabled: bool | None = None) -> Column:
    """The global filters, each at its default unless given: rated MW, and whether a unit is alive in a year within the bounds."""
    least, most = mw_range or (DEFAULTS["mw_min"], DEFAULTS["mw_max"])
    enabled = DEFAULTS["year_enabled"] if year_enabled is None else year_enabled
    at = min(max(DEFAULTS["year"] if year is None else year, DEFAULTS["year_min"]), DEFAULTS["year_max"])
    return combined(mw_between(mw, least, most), alive_in(at, start, end) if enabled else None)


@dataclass(frozen=True)
class LegendFilter:
    """A group of a legend: its key and code in urls, the field it filters, its buckets (id: values) and those active at first (all, if none are named)."""

    key: str
    code: str
    field: str
    buckets: tuple[tuple[str, tuple[str, ...]], ...]
    first: tuple[str, ...] | None = None

    def condition(self, active: Collection[str] | None = None) -> Column | None:
        """Rows of the active buckets, or of those active at first; none if all are."""
        chosen = self.first if active is None else active
        own = {k: list(v) for k, v in self.buckets}
        return value_buckets(self.field, chosen, {k: v for k, v in own.items() if k != "other"}, list(own))


def by_legend(registry: Sequence[LegendFilter], keys: Sequence[str], active: Mapping[str, Collection[str]]) -> Column:
    """The filters of a layer, named by keys, together; active: what the user chose, by key. A key that isn't registered is an error."""
    named = {f.key: f for f in registry}
    return combined(*(named[k].condition(active.get(k)) for k in keys))
