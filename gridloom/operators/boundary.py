"""What a function gives outside its box. Each wraps an input or function; an axis given as None stays as it is.

Bounds default to an input's own box. The result is computed once over the box that is needed, so a stencil above it
finds its neighbours in one join.
"""

from __future__ import annotations

from collections.abc import Callable

from gridloom.functions.expr import Expr, GridError, absolute, cast, clamp, const, select
from gridloom.functions.types import Bool, Int
from gridloom.plans.func import Func, Input, Var

Bounds = list[tuple[int, int] | None]


def _wrapped(source: Func | Input, bounds: Bounds | None, place: Callable[[Expr, int, int], Expr], name: str) -> tuple[Func, list[Expr], Bounds]:
    if bounds is None:
        if not isinstance(source, Input):
            raise GridError("a function has no box of its own: give its bounds")
        bounds = list(source.box.values())
    if any(b is not None and (len(b) != 2 or b[0] is None or b[1] is None) for b in bounds):
        raise GridError("a bound needs both least coordinate and extent")
    if len(bounds) > source.dimensions():
        raise GridError("more bounds than dimensions")
    bounds = bounds + [None] * (source.dimensions() - len(bounds))
    names = list(source.coords) if isinstance(source, Input) else list(source.vars)
    at = [Var(n) for n in names]
    f = Func(name)
    f[tuple(at)] = source[tuple(v if b is None else place(v, *b) for v, b in zip(at, bounds, strict=True))]
    return f.compute_root(), at, bounds


def repeat_edge(source: Func | Input, bounds: Bounds | None = None) -> Func:
    return _wrapped(source, bounds, lambda v, a, n: clamp(v, a, a + n - 1), "repeat_edge")[0]


def constant_exterior(source: Func | Input, value: object, bounds: Bounds | None = None) -> Func:
    inner, at, bounds = _wrapped(source, bounds, lambda v, a, n: clamp(v, a, a + n - 1), "inside")
    inner.root = False
    outside = const(False, Bool)
    for v, b in zip(at, bounds, strict=True):
        if b is not None:
            outside = outside | (v < b[0]) | (v >= b[0] + b[1])
    f, got = Func("constant_exterior"), inner[tuple(at)]
    f[tuple(at)] = tuple(select(outside, cast(g.kind, value), g) for g in got) if isinstance(got, tuple) else select(outside, cast(got.kind, value), got)
    return f.compute_root()


def repeat_image(source: Func | Input, bounds: Bounds | None = None) -> Func:
    return _wrapped(source, bounds, lambda v, a, n: (v - a) % n + a, "repeat_image")[0]


def mirror_image(source: Func | Input, bounds: Bounds | None = None) -> Func:
    def place(v: Expr, a: int, n: int) -> Expr:
        m = (v - a) % (2 * n)
        return clamp(select(m >= n, 2 * n - 1 - m, m) + a, a, a + n - 1)

    return _wrapped(source, bounds, place, "mirror_image")[0]


def mirror_interior(source: Func | Input, bounds: Bounds | None = None) -> Func:
    def place(v: Expr, a: int, n: int) -> Expr:
        if n == 1:
            return const(a)
        last = n - 1
        return clamp(last - cast(Int(32), absolute((v - a) % (2 * last) - last)) + a, a, a + last)

    return _wrapped(source, bounds, place, "mirror_interior")[0]
