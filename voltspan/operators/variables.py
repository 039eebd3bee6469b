"""Variables derived from raw readings and from each other, over one scan; what fails takes only its dependants with it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, PREVIOUS, FAILED = "ok", "previous", "failed"


@dataclass(frozen=True)
class Variable:
    """Its name, the raw readings and other variables that it needs, and the column that it is of theirs, in this order."""

    name: str
    needs: tuple[str, ...]
    combine: Callable[..., Column]


def in_order(variables: Sequence[Variable]) -> list[Variable]:
    """Each after those that it needs; a cycle raises graphlib.CycleError, two of one name ValueError."""
    known = {v.name: v for v in variables}
    if len(known) < len(variables):
        raise ValueError("a variable is defined twice")
    return [known[n] for n in TopologicalSorter({v.name: v.needs for v in variables}).static_order() if n in known]


def readings(rows: DataFrame, cell: Sequence[str], name: str, value: str, raws: Sequence[str]) -> DataFrame:
    """A row for each cell with a column for each raw reading, by one partial aggregation; the largest of several, null if there is none."""
    return rows.groupBy(*cell).agg(*(F.max(F.when(F.col(name) == r, F.col(value))).alias(r) for r in raws))


def evaluate(cells: DataFrame, cell: Sequence[str], variables: Sequence[Variable], step: str, failed: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """(cell, variable, value, status) of all variables.

    cells: the raw readings by name. failed: (step, raw), the readings that could not be had in a step; small, as raws and steps are few. A variable is
    failed in a step if anything that it needs is, by whatever way; then its value is that of `before` (cell, variable, value) with status
    `previous`, or null with status `failed`. Others are not touched. All variables come from one pass over the cells, without a join between them.
    """
    order = in_order(variables)
    raws = [c for c in cells.columns if c not in cell]
    missing = {n for v in order for n in v.needs} - set(raws) - {v.name for v in order}
    if missing:
        raise ValueError(f"no reading or variable {sorted(missing)}")
    rows = cells
    if failed is not None:
        gone = failed.groupBy(step).agg(F.collect_set("raw").alias("_gone"))
        rows = rows.join(gone, step, "left")
    gone = F.coalesce(F.col("_gone"), F.array()) if failed is not None else F.array().cast("array<string>")
    bad: dict[str, Column] = {r: F.array_contains(gone, r) for r in raws}
    for v in order:
        rows = rows.withColumns({f"_bad_{v.name}": F.array(*(bad[n] for n in v.needs)), v.name: v.combine(*map(F.col, v.needs))})
        rows = rows.withColumn(f"_bad_{v.name}", F.array_contains(f"_bad_{v.name}", True))
        bad[v.name] = F.col(f"_bad_{v.name}")
    each = F.array(*(F.struct(F.lit(v.name).alias("variable"), F.when(~bad[v.name], F.col(v.name).cast("double")).alias("value"), F.when(bad[v.name], FAILED).otherwise(OK).alias("status")) for v in order))
    found = rows.select(*cell, F.inline(each))
    if before is None:
        return found
    joined = found.join(before.select(*cell, "variable", F.col("value").alias("_before")), [*cell, "variable"], "left")
    back = (F.col("status") == FAILED) & F.col("_before").isNotNull()
    return joined.select(*cell, "variable", F.when(back, F.col("_before")).otherwise(F.col("value")).alias("value"), F.when(back, PREVIOUS).otherwise(F.col("status")).alias("status"))
