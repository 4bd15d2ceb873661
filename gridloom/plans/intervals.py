"""Intervals of expressions over boxes: which part of a callee a box of its caller needs."""

from __future__ import annotations

from gridloom.functions.expr import Expr
from gridloom.functions.types import Type

#: Lowest and highest value, or None where nothing bounds it.
Interval = tuple[int, int] | None
#: For each axis: least coordinate and number of sites.
Box = dict[str, tuple[int, int]]


def of_type(kind: Type) -> Interval:
    return (kind.min(), kind.max()) if kind.is_int and kind.bits <= 16 else None


def bounds(e: Expr, ranges: dict[object, tuple[int, int]]) -> Interval:
    """Bounds of ``e`` when each variable stays within its range; small integer types bound what is unknown."""
    got = _bounds(e, ranges)
    limit = of_type(e.kind)
    if got is None or limit and (got[0] < limit[0] or got[1] > limit[1]):
        return limit
    return got


def _bounds(e: Expr, ranges: dict[object, tuple[int, int]]) -> Interval:
    if e.op in ("var", "rvar"):
        return ranges.get(e.data)
    if e.op == "const":
        return (e.data, e.data) if e.kind.is_int else None
    if e.kind.is_float or e.kind.is_bool:
        return (0, 1) if e.kind.is_bool else None
    a = [bounds(x, ranges) for x in e.args]
    match e.op:
        case "max" | "min" if any(a):
            # One bounded side bounds half of the result; the other half needs both.
            pick = max if e.op == "max" else min
            known = [x for x in a if x]
            if len(known) == 2:
                return pick(a[0][0], a[1][0]), pick(a[0][1], a[1][1])
            return _clamped(e, ranges)
        case "select":
            return (min(a[1][0], a[2][0]), max(a[1][1], a[2][1])) if a[1] and a[2] else None
        case "%" if a[1] and (a[1][0] > 0 or a[1][1] < 0):
            most = max(abs(a[1][0]), abs(a[1][1])) - 1
            return (a[0][0], a[0][1]) if a[0] and a[0][0] >= 0 and a[1][0] > a[0][1] else (0, most)
        case "cast" if a[0]:
            return a[0]
    if not a or not all(a):
        return None
    match e.op:
        case "+":
            return a[0][0] + a[1][0], a[0][1] + a[1][1]
        case "-":
            return a[0][0] - a[1][1], a[0][1] - a[1][0]
        case "*":
            p = [x * y for x in a[0] for y in a[1]]
            return min(p), max(p)
        case "/" if a[1][0] > 0 or a[1][1] < 0:
            p = [(x - x % abs(y)) // y for x in a[0] for y in a[1]]
            return min(p), max(p)
        case "abs":
            return (0 if a[0][0] <= 0 <= a[0][1] else min(map(abs, a[0]))), max(map(abs, a[0]))
        case ">>" if a[1][0] == a[1][1]:
            return a[0][0] >> a[1][0], a[0][1] >> a[1][0]
    return None


def _clamped(e: Expr, ranges: dict[object, tuple[int, int]]) -> Interval:
    """max(min(unknown, high), low), in either order."""
    outer = [bounds(x, ranges) for x in e.args]
    for side, inner in ((0, 1), (1, 0)):
        known, other = outer[side], e.args[inner]
        if known and not outer[inner] and other.op in ("max", "min") and other.op != e.op:
            limits = [x for x in (bounds(y, ranges) for y in other.args) if x]
            if limits:
                return (known[0], max(known[1], limits[0][1])) if e.op == "max" else (min(known[0], limits[0][0]), known[1])
    return None


def hull(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    """Of two (least, extent)."""
    low = min(a[0], b[0])
    return low, max(a[0] + a[1], b[0] + b[1]) - low
