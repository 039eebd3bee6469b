"""A compiler from map style expressions (nested lists) to columns, so that filters and paints written as data run in Catalyst.

Supported: get, has, literal, feature-state, zoom, to-number, to-string, to-boolean, coalesce, case, match, step, interpolate (linear),
in, index-of, all, any, !, comparisons, arithmetic, min, max, sqrt, round, floor, concat, upcase, downcase.
"""

from __future__ import annotations

import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltspan.functions.numeric import number

COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
NUMERIC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}


def compile_style(expr: Any, zoom: float | None = None, state: str = "state") -> Column:
    """The column of an expression. A missing value compares as different, and isn't in any list."""
    go = lambda e: compile_style(e, zoom, state)
    if not isinstance(expr, list):
        return F.lit(expr)
    op, *args = expr
    if op == "literal":
        return F.array(*map(F.lit, args[0])) if isinstance(args[0], list) else F.lit(args[0])
    if op == "get":
        return F.col(args[0])
    if op == "has":
        return F.col(args[0]).isNotNull()
    if op == "feature-state":
        return F.col(f"{state}.{args[0]}")
    if op == "zoom":
        return F.lit(zoom)
    if op == "to-number":
        return F.coalesce(*(number(go(a)) for a in args), F.lit(0.0)) if len(args) == 1 else F.coalesce(*(number(go(a)) for a in args))
    if op == "to-string":
        return F.coalesce(go(args[0]).cast("string"), F.lit(""))
    if op == "to-boolean":
        return F.coalesce(~go(args[0]).cast("string").isin("", "0", "0.0", "false", "NaN"), F.lit(False))
    if op in ("==", "!="):
        same = go(args[0]).eqNullSafe(go(args[1]))
        return same if op == "==" else ~same
    if op in COMPARE:
        return F.coalesce(COMPARE[op](go(args[0]), go(args[1])), F.lit(False))
    if op in ("all", "any"):
        return reduce(operator.and_ if op == "all" else operator.or_, map(go, args), F.lit(op == "all"))
    if op == "!":
        return ~go(args[0])
    if op == "in":
        items = args[1][1] if isinstance(args[1], list) and args[1][0] == "literal" else None
        return F.coalesce(go(args[0]).isin(items) if isinstance(items, list) else F.instr(go(args[1]), args[0]) > 0, F.lit(False)) if items != [] else F.lit(False)
    if op == "index-of":
        return F.locate(args[0], go(args[1])) - 1
    if op == "coalesce":
        return F.coalesce(*map(go, args))
    if op == "case":
        out = go(args[-1])
        for condition, value in reversed(list(zip(args[:-1:2], args[1:-1:2], strict=True))):
            out = F.when(go(condition), go(value)).otherwise(out)
        return out
    if op == "match":
        value, out = go(args[0]), go(args[-1])
        for labels, result in reversed(list(zip(args[1:-1:2], args[2:-1:2], strict=True))):
            out = F.when(value.isin(labels if isinstance(labels, list) else [labels]), go(result)).otherwise(out)
        return out
    if op == "step":
        value, out = go(args[0]), go(args[1])
        for edge, result in zip(args[2::2], args[3::2], strict=True):
            out = F.when(value >= edge, go(result)).otherwise(out)
        return out
    if op == "interpolate":
        if args[0] != ["linear"]:
            raise ValueError(f"not supported: interpolate {args[0]}")
        value, stops = go(args[1]), list(zip(args[2::2], map(go, args[3::2]), strict=True))
        out = stops[-1][1]
        for (x0, y0), (x1, y1) in reversed(list(zip(stops, stops[1:], strict=False))):
            out = F.when(value < x1, y0 + (y1 - y0) * (value - F.lit(float(x0))) / F.lit(float(x1 - x0))).otherwise(out)
        return F.when(value.isNull(), None).when(value <= stops[0][0], stops[0][1]).otherwise(out)
    if op in NUMERIC:
        return -go(args[0]) if op == "-" and len(args) == 1 else reduce(NUMERIC[op], map(go, args))
    if op in ("min", "max"):
        return (F.least if op == "min" else F.greatest)(*map(go, args))
    if op == "sqrt":
        return F.sqrt(go(args[0]))
    if op == "round":
        return F.floor(go(args[0]) + F.lit(0.5))
    if op == "floor":
        return F.floor(go(args[0]))
    if op == "concat":
        return F.concat(*(F.coalesce(go(a).cast("string"), F.lit("")) for a in args))
    if op in ("upcase", "downcase"):
        return (F.upper if op == "upcase" else F.lower)(go(args[0]))
    raise ValueError(f"not supported: {op}")
