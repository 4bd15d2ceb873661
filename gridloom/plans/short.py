"""Short forms: anonymous functions, remaining dimensions, parameters with ranges, complex values."""

from __future__ import annotations

from collections.abc import Callable

from gridloom.functions import expr as E
from gridloom.functions.expr import Expr, GridError, const, select
from gridloom.functions.types import Type
from gridloom.plans.func import Func, Input, Var

_count = iter(range(1 << 62))


def lam(*parts: Expr) -> Func:
    """``lam(x, y, e)``: a function without a name of its own."""
    f = Func(f"lambda{next(_count)}")
    f[tuple(parts[:-1])] = parts[-1]
    return f


def rest(source: Func | Input, value: Callable[[Expr], Expr], *given: Expr, name: str = "f") -> Func:
    """``value(source[given..., _])``: what dimensions remain after the given ones is carried through under names of their own."""
    left = source.dimensions() - len(given)
    if left < 0:
        raise GridError(f"{source.name} has only {source.dimensions()} dimensions")
    places = tuple(Var(f"_{k}") for k in range(left))
    own = tuple(g for g in given if g.op == "var")
    f = Func(name)
    f[own + places] = value(source[(*given, *places)])
    return f


def param(kind: Type, value: object, least: object = None, most: object = None) -> Expr:
    """A value given from outside, within its range."""
    if least is not None and value < least or most is not None and value > most:
        raise GridError(f"{value} lies outside {least} to {most}")
    return const(value, kind)


Complex = tuple[Expr, Expr]


def c_add(a: Complex, b: Complex) -> Complex:
    return a[0] + b[0], a[1] + b[1]


def c_sub(a: Complex, b: Complex) -> Complex:
    return a[0] - b[0], a[1] - b[1]


def c_mul(a: Complex, b: Complex) -> Complex:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def c_conj(a: Complex) -> Complex:
    return a[0], -a[1]


def c_scale(a: Complex, by: Expr | float) -> Complex:
    return a[0] * by, a[1] * by


def c_expj(angle: Expr) -> Complex:
    return E.cos(angle), E.sin(angle)


def c_select(cond: Expr, a: Complex, b: Complex) -> Complex:
    return select(cond, a[0], b[0]), select(cond, a[1], b[1])
