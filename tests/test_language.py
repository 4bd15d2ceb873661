"""Expressions, definitions and updates against plain Python; what must fail, fails."""

import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import expr as E
from gridloom.functions.expr import GridError, cast, compile, const, select
from gridloom.functions.types import Float, Int, Type, UInt, matched
from gridloom.operators import boundary
from gridloom.plans.evaluate import evaluate
from gridloom.plans.func import Func, Input, RDom, Var, argmax, argmin, sum_

x, y = Var("x"), Var("y")
KINDS = [Int(8), Int(16), Int(32), UInt(8), UInt(16), UInt(32)]


def leaf(kind):
    return st.integers(kind.min(), kind.max()).map(lambda v: const(v, kind))


def trees():
    base = st.sampled_from(KINDS).flatmap(leaf)

    def grow(inner):
        binary = st.tuples(st.sampled_from("+-*"), inner, inner).map(lambda t: {"+": t[1] + t[2], "-": t[1] - t[2], "*": t[1] * t[2]}[t[0]])
        safe = st.tuples(inner, st.integers(1, 100), st.booleans()).map(lambda t: t[0] % t[1] if t[2] else t[0] / t[1])
        other = st.tuples(inner, inner).map(lambda t: E.maximum_of(*t))
        chosen = st.tuples(inner, inner).map(lambda t: select(t[0] < t[1], t[0] + 0 * cast(t[0].kind, t[1]), t[0]))
        return st.one_of(binary, safe, other, chosen, inner.map(E.absolute), st.tuples(inner, st.sampled_from(KINDS)).map(lambda t: cast(t[1], t[0])))

    return st.recursive(base, grow, max_leaves=6)


@settings(max_examples=25, deadline=None)
@given(st.lists(trees(), min_size=8, max_size=8))
def test_random_expressions(spark, exprs):
    row = spark.range(1).select(*[compile(e, lambda _: None).alias(f"c{k}") for k, e in enumerate(exprs)]).first()
    assert [int(v) for v in row] == [int(evaluate(e, lambda _: None)) for e in exprs]


def test_division_signs(spark):
    pairs = [(a, b) for a in (-7, -1, 0, 1, 7, 127, -128) for b in (-3, -1, 1, 2, 5)]
    cells = [c for a, b in pairs for c in (compile(const(a, Int(16)) / const(b, Int(16)), lambda _: None), compile(const(a, Int(16)) % const(b, Int(16)), lambda _: None))]
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cells)]).first()
    for (a, b), q, r in zip(pairs, row[::2], row[1::2], strict=True):
        assert q * b + r == a and 0 <= r < abs(b)


def test_wide_integers(spark):
    a, b = const((1 << 63) - 1, Int(64)), const(-(1 << 62) - 12345, Int(64))
    got = spark.range(1).select(*[compile(e, lambda _: None).alias(n) for n, e in (("s", a + a), ("p", a * b))]).first()
    assert got.s == -2 and got.p == evaluate(a * b, lambda _: None)


def test_lerp_u8_rounds(spark):
    rows = spark.range(0, 256, 5).select(F.col("id").alias("a")).crossJoin(spark.range(0, 256, 17).select(F.col("id").alias("w")))
    v = lambda n: E.Expr("var", (), UInt(8), n)
    c = compile(E.lerp(v("a"), const(200, UInt(8)), v("w")), lambda e: F.col(e.data) if e.op == "var" else None)
    for r in rows.select("a", "w", c.alias("f")).collect():
        exact = (r.a * (255 - r.w) + 200 * r.w) / 255
        assert abs(r.f - exact) <= 0.5 + 1e-9


def test_erf(spark):
    import math

    c = compile(cast(Float(64), E.erf(E.Expr("var", (), Float(64), "v"))), lambda e: F.col(e.data) if e.op == "var" else None)
    for r in spark.range(-40, 41).select((F.col("id") / 10).alias("v")).select("v", c.alias("f")).collect():
        assert abs(r.f - math.erf(r.v)) < 2e-7


def test_matching_types():
    assert matched(UInt(8), UInt(16)) == UInt(16) and matched(Int(8), UInt(32)) == Int(32) and matched(Int(32), Float(32)) == Float(32)
    assert str(UInt(1)) == "bool" and Type("int", 8).min() == -128


def test_argmax_first_of_ties(spark):
    r, f, g = RDom((0, 100), (0, 100)), Func("f"), Func("g")
    value = r.x * (100 - r.x) + r.y * (80 - r.y)
    f[()] = argmax(value)
    g[()] = argmin(value)
    assert f.evaluate(spark) == (50, 40, 4100) and g.evaluate(spark) == (0, 99, -1881)


def test_shifted_box(spark):
    f = Func("f")
    f[x, y] = x * 10 + y
    assert {(r.x, r.y): r.f for r in f.realize(spark, (-3, 2), (5, 2)).collect()} == {(a, b): a * 10 + b for a in (-3, -2) for b in (5, 6)}


def small(spark, kind=UInt(8)):
    return Input(spark.range(24).selectExpr("id % 6 as x", "id div 6 as y", "(id * 37) % 50 as v"), ("x", "y"), {"v": kind}, {"x": (0, 6), "y": (0, 4)}, name="small")


def test_order_of_updates_kept(spark):
    g, f, r = small(spark, Int(32)), Func("f"), RDom((1, 5))
    f[x, y] = g[x, y]
    f[r.x, y] = f[r.x - 1, y] * 3 % 101 + f[r.x, y]
    want = {}
    for b in range(4):
        row = [(37 * (b * 6 + a)) % 50 for a in range(6)]
        for a in range(1, 6):
            row[a] = row[a - 1] * 3 % 101 + row[a]
        want |= {(a, b): v for a, v in enumerate(row)}
    assert {(r.x, r.y): r.f for r in f.realize(spark, 6, 4).collect()} == want


def test_box_reaches_the_input(spark):
    f = Func("f")
    f[x, y] = small(spark)[x, y] + small(spark)[x + 1, y]
    plan = f.realize(spark, (1, 2), (2, 1))._jdf.queryExecution().optimizedPlan().toString()
    assert "<= 3" in plan.replace("L", "") or "<= 3" in plan


@pytest.mark.parametrize("bad", [
    lambda g: Func("f").__setitem__((x, x), const(1)),
    lambda g: Func("f").__setitem__(x, y),
    lambda g: Func("f").__setitem__(x, RDom((0, 3)).x + 0),
    lambda g: g[x],
    lambda g: g[E.sqrt(x), y],
    lambda g: x / 0,
    lambda g: x % 0,
    lambda g: const(1, UInt(8)) + 256,
    lambda g: E.lerp(const(1, UInt(8)), const(1, UInt(16)), 0.5),
    lambda g: E.lerp(const(1, UInt(8)), const(2, UInt(8)), const(1, Int(8))),
    lambda g: E.lerp(const(1, UInt(8)), const(2, UInt(8)), 1.5),
    lambda g: select(x, x, x),
    lambda g: sum_(RDom((0, 2)).x + RDom((0, 3)).x),
    lambda g: bool(x < 1),
    lambda g: E.is_nan(x),
    lambda g: E.reinterpret(Int(8), x),
    lambda g: boundary.repeat_edge(g, [(0, None), None]),
    lambda g: boundary.repeat_edge(g, [(0, 1), (0, 1), (0, 1)]),
])
def test_rejected(spark, bad):
    with pytest.raises(GridError):
        bad(small(spark))


def test_rejected_updates(spark):
    f = Func("f")
    f[x, y] = x + y
    r = RDom((0, 3))
    with pytest.raises(GridError):
        f[r.x] = const(1)
    with pytest.raises(GridError):
        f[x, r.x] = const(1.0)
    with pytest.raises(GridError):
        f[x, r.x] = f[x + 1, r.x]
    g = Func("g")
    g[x, y] = f[x, y]
    with pytest.raises(GridError):
        f[x, y] = f[x, y] + 1
    with pytest.raises(GridError):
        small(spark)
        h = Func("h")
        h[x, y] = small(spark)[x + 5, y]
        h.realize(spark, 6, 4)
    with pytest.raises(GridError):
        k = Func("k")
        k[x] = x
        k.bound("x", 0, 5).realize(spark, 6)


def test_hiding_update_warns():
    f = Func("f")
    f[x] = x
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        f[x] = x + 1
    assert seen


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
