"""The state of a query (view, layers, filters) as a short url fragment, and back. Defaults are left out; unknown codes are ignored."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qsl, quote

#: Default ranges of capacity and year.
MW, YEAR = (0, 10_000), 2025


@dataclass(frozen=True)
class QueryState:
    """zoom, lat, lon; layers on; voltage buckets (None: all); capacity range; year (None: off)."""

    zoom: float = 4.0
    lat: float = 40.0
    lon: float = -98.0
    layers: frozenset[str] = field(default_factory=frozenset)
    kv: frozenset[str] | None = None
    mw: tuple[int, int] = MW
    year: int | None = None


def encode(state: QueryState) -> str:
    parts = []
    if state.layers:
        parts.append("l=" + ",".join(quote(x, safe="") for x in sorted(state.layers)))
    if state.kv is not None:
        parts.append("v=" + ",".join(quote(x, safe="") for x in sorted(state.kv)))
    if state.mw != MW:
        parts.append(f"mw={state.mw[0]}-{state.mw[1]}")
    if state.year is not None:
        parts.append(f"y={state.year}")
    return f"#{state.zoom:.2f}/{state.lat:.5f}/{state.lon:.5f}" + ("?" + "&".join(parts) if parts else "")


def decode(fragment: str, layers: set[str], kv: set[str]) -> QueryState:
    view, _, query = fragment.removeprefix("#").partition("?")
    values = dict(parse_qsl(query, keep_blank_values=True))
    own = lambda key, known: frozenset(x for x in values[key].split(",") if x in known)
    try:
        zoom, lat, lon = (float(x) for x in view.split("/")[:3])
    except ValueError:
        zoom, lat, lon = QueryState.zoom, QueryState.lat, QueryState.lon
    lo, _, hi = values.get("mw", "").partition("-")
    year = values.get("y", "")
    return QueryState(
        zoom, lat, lon, own("l", layers) if "l" in values else frozenset(), own("v", kv) if "v" in values else None,
        (int(lo), int(hi)) if lo.isdigit() and hi.isdigit() else MW, int(year) if year.isdigit() else None,
    )
