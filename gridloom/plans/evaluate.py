"""Expressions in plain Python, one site at a time: what folds use, and what tests hold columns against."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

from gridloom.functions.expr import Expr, GridError
from gridloom.functions.types import Type


def fold(value: int, kind: Type) -> int:
    value &= (1 << kind.bits) - 1
    return value - (1 << kind.bits) if kind.code == "int" and value >> kind.bits - 1 else value


def _real(f: Callable[..., float], *a: float) -> float:
    try:
        return f(*a)
    except OverflowError:
        return math.inf
    except ValueError:
        return math.nan


def stored(value: object, kind: Type) -> object:
    if value is None or kind.is_bool or kind.is_int:
        return value
    return struct.unpack("f", struct.pack("f", value))[0] if kind.bits == 32 and abs(value) < 3e38 else value


def evaluate(e: Expr, env: Callable[[Expr], object]) -> object:
    if e.op in ("var", "rvar", "call", "reduce"):
        return env(e)
    if e.op == "const":
        return e.data
    if e.op == "undef":
        return None
    if e.op == "select":
        return evaluate(e.args[1] if evaluate(e.args[0], env) else e.args[2], env)
    a = [evaluate(x, env) for x in e.args]
    if any(x is None for x in a):
        return None
    kind, had = e.kind, e.args[0].kind
    match e.op:
        case "+" | "-" | "*":
            got = a[0] + a[1] if e.op == "+" else a[0] - a[1] if e.op == "-" else a[0] * a[1]
            return got if kind.is_float else fold(int(got), kind)
        case "/":
            if kind.is_float:
                return a[0] / a[1] if a[1] else math.nan if not a[0] or a[0] != a[0] else math.copysign(math.inf, a[0])
            return fold((int(a[0]) - int(a[0]) % abs(int(a[1]))) // int(a[1]), kind)
        case "%":
            return a[0] - a[1] * math.floor(a[0] / a[1]) if kind.is_float else int(a[0]) % abs(int(a[1]))
        case "max" | "min":
            return (max if e.op == "max" else min)(a)
        case "abs":
            return abs(a[0])
        case "absd":
            return abs(a[0] - a[1])
        case "<" | "<=" | ">" | ">=" | "==" | "!=":
            return {"<": a[0] < a[1], "<=": a[0] <= a[1], ">": a[0] > a[1], ">=": a[0] >= a[1], "==": a[0] == a[1], "!=": a[0] != a[1]}[e.op]
        case "&" | "|" | "^":
            return a[0] & a[1] if e.op == "&" else a[0] | a[1] if e.op == "|" else a[0] ^ a[1]
        case "!":
            return not a[0]
        case "~":
            return fold(~a[0], kind)
        case "<<":
            return fold(int(a[0]) << int(a[1]), kind)
        case ">>":
            return int(a[0]) >> int(a[1])
        case "cast":
            if kind.is_bool:
                return bool(a[0])
            if kind.is_float:
                return stored(float(a[0]), kind)
            return fold(int(a[0]), kind)
        case "popcount":
            return (a[0] & (1 << kind.bits) - 1).bit_count()
        case "clz":
            return kind.bits - (a[0] & (1 << kind.bits) - 1).bit_length()
        case "ctz":
            return ((a[0] & -a[0]) - 1).bit_count()
        case "floor" | "ceil" | "trunc":
            return float(getattr(math, e.op)(a[0]))
        case "rint":
            return float(round(a[0]))
        case "fract":
            return a[0] - math.trunc(a[0])
        case "is_nan":
            return a[0] != a[0]
        case "log":
            return math.nan if a[0] < 0 else -math.inf if a[0] == 0 else math.log(a[0])
        case "reinterpret" if had.is_int and kind.is_int:
            return fold(int(a[0]), kind)
        case "sin" | "cos" | "tan" | "asin" | "acos" | "atan" | "atan2" | "sinh" | "cosh" | "tanh" | "asinh" | "acosh" | "atanh" | "sqrt" | "exp" | "pow" | "hypot":
            return stored(_real(getattr(math, e.op), *a), kind)
    raise GridError(f"{e.op} has no plain form")
