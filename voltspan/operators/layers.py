"""Layers described as data: what a layer keeps of its source, and how it is served."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltspan.operators.relational import keep_columns


@dataclass(frozen=True)
class LayerSpec:
    """Columns to keep (those that are there), a condition on rows, decimal places of coordinates, and whether it is left out."""

    name: str
    select: tuple[str, ...] = ()
    where: str | None = None
    precision: int | None = None
    skip: bool = False


def build(df: DataFrame, spec: LayerSpec) -> DataFrame:
    """The rows and columns of a layer; lon and lat always stay, rounded half to even. Rows for which the condition is null go."""
    rows = df.where(spec.where) if spec.where else df
    kept = keep_columns(rows, [*spec.select, "lon", "lat"]) if spec.select else rows
    if spec.precision is None:
        return kept
    return kept.withColumns({c: F.bround(c, spec.precision) for c in ("lon", "lat") if c in kept.columns})


@dataclass(frozen=True)
class ShownLayer:
    """A layer of the registry: its drawn parts, of which `heat` is the heat map, and its display modes (name: parts), if it has its own."""

    name: str
    parts: tuple[str, ...]
    heat: str | None = None
    modes: tuple[tuple[str, tuple[str, ...]], ...] = ()
    default: str = "icons"


def shown_parts(layer: ShownLayer, on: bool, mode: str | None = None) -> tuple[str, ...]:
    """The parts that a display mode draws: those that the mode names (an unknown mode: the first's); without modes of its own, the heat map, the rest or both."""
    mode = mode or layer.default
    if not on:
        return ()
    if layer.modes:
        own = dict(layer.modes).get(mode, layer.modes[0][1])
        return tuple(p for p in layer.parts if p in own)
    return tuple(p for p in layer.parts if mode == "both" or (mode == "heat") == (p == layer.heat))


def shown(layer: Column, mode: Column, known: Sequence[ShownLayer], off: str) -> Column:
    """shown_parts on columns: the parts of each row's layer in its mode (null: the layer's own first; `off`: none); null for an unknown layer."""
    modes = lambda x: dict.fromkeys([m for m, _ in x.modes] + ["both", "heat"])
    parts = lambda x, m: F.array(*map(F.lit, shown_parts(x, True, m))).cast("array<string>")
    out = F.lit(None).cast("array<string>")
    for x in known:
        chosen = parts(x, "-")  # a mode that no layer names
        for m in modes(x):
            chosen = F.when(mode == m, parts(x, m)).otherwise(chosen)
        chosen = F.when(mode == off, F.array().cast("array<string>")).when(mode.isNull(), parts(x, None)).otherwise(chosen)
        out = F.when(layer == x.name, chosen).otherwise(out)
    return out


def drawn(parts: DataFrame, order: list[str], part: str) -> DataFrame:
    """Rows of parts with their place `z` in the total draw order, sorted from the bottom up; parts that the order doesn't name go on top, by name."""
    ranks = parts.sparkSession.createDataFrame([(p, z) for z, p in enumerate(order)], f"{part} string, z int")  # some forty rows
    placed = parts.join(F.broadcast(ranks), part, "left")
    return placed.withColumn("z", F.coalesce("z", F.lit(len(order)))).orderBy("z", part)


def build_all(sources: dict[str, DataFrame], specs: list[LayerSpec]) -> dict[str, DataFrame]:
    """All layers that aren't left out and whose source is there."""
    return {s.name: build(sources[s.name], s) for s in specs if not s.skip and s.name in sources}
