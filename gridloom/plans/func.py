"""Functions over integer coordinates, defined once and updated in order, evaluated over the box that is asked for.

A function without updates is inlined into its callers unless it is marked ``compute_root``. The calls that remain become
joins: all calls of one callee at constant offsets and equal strides share one join, fed by one aggregation of shifted
copies; other calls join on their computed arguments. Each callee is computed over the box that interval analysis says its callers need, and
inputs are filtered to that box before anything else. Updates are told apart by shape: sums, products, least and greatest
become aggregations by the target's coordinates; overwriting becomes "the last in order"; running sums become windows; what
is left is folded in order, one group of the pure coordinates at a time.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.expr import Expr, GridError, compile, const
from gridloom.functions.types import Int, Type, big
from gridloom.plans.evaluate import evaluate
from gridloom.plans.intervals import Box, bounds, hull


def Var(name: str) -> Expr:
    return Expr("var", (), Int(32), name)


class RDom:
    """A bounded domain, gone through with the first axis innermost. ``RDom((min, extent), ...)`` or ``RDom(input)``."""

    def __init__(self, *axes: tuple[int, int] | Input, name: str = "r"):
        self.source = axes[0] if len(axes) == 1 and isinstance(axes[0], Input) else None
        self.axes = list(self.source.box.values()) if self.source else list(axes)
        self.name, self.vars = name, [Expr("rvar", (), Int(32), (self, k)) for k in range(len(self.axes))]

    def __getattr__(self, name: str) -> Expr:
        if name in ("x", "y", "z", "w"):
            return self.vars["xyzw".index(name)]
        raise AttributeError(name)

    def __getitem__(self, k: int) -> Expr:
        return self.vars[k]

    def column(self, k: int) -> str:
        return f"_{self.name}{k}"

    def ranges(self) -> dict[object, tuple[int, int]]:
        return {(self, k): (a, a + n - 1) for k, (a, n) in enumerate(self.axes)}

    def over(self, df: DataFrame) -> DataFrame:
        """Every row of ``df`` with every point of the domain."""
        for k, (a, n) in enumerate(self.axes):
            df = df.withColumn(self.column(k), F.explode(F.sequence(F.lit(a), F.lit(a + n - 1)).cast("array<bigint>"))) if n > 0 else df.withColumn(self.column(k), F.lit(0).cast("bigint")).where("false")
        return df

    def order(self) -> list[Column]:
        return [F.col(self.column(k)) for k in reversed(range(len(self.axes)))]


@dataclass
class Input:
    """A table as a function: coordinate columns, value columns with their types, its box. Sites that it lacks hold ``fill``."""

    df: DataFrame
    coords: tuple[str, ...]
    values: dict[str, Type]
    box: Box
    fill: float = 0
    name: str = "input"

    def __post_init__(self) -> None:
        if tuple(self.box) != tuple(self.coords):
            raise GridError("the box must name the coordinates in order")

    def __getitem__(self, args: object) -> Expr | tuple[Expr, ...]:
        return _call(self, args)

    def width(self, axis: int = 0) -> int:
        return list(self.box.values())[axis][1]

    def minimum(self, axis: int = 0) -> int:
        return list(self.box.values())[axis][0]

    def kinds(self) -> list[Type]:
        return list(self.values.values())

    def dimensions(self) -> int:
        return len(self.coords)

    def within(self, box: list[tuple[int, int]]) -> DataFrame:
        """Coordinates as ``c0``, ... and values as ``v0``, ..., filtered to ``box``."""
        df = self.df
        for c, (a, n), (least, extent) in zip(self.coords, box, self.box.values(), strict=True):
            if a < least or a + n > least + extent:
                raise GridError(f"{self.name} is read over {c} from {a} to {a + n - 1}, outside its box from {least} to {least + extent - 1}")
            df = df.where(F.col(c).between(a, a + n - 1))
        return df.select(*[F.col(c).cast("bigint").alias(f"c{k}") for k, c in enumerate(self.coords)], *[F.col(v).cast(t.spark()).alias(f"v{k}") for k, (v, t) in enumerate(self.values.items())])


@dataclass
class Update:
    args: tuple[Expr, ...]
    values: tuple[Expr, ...]
    domain: RDom | None


class _Unset:
    """``f[args]`` before ``f`` is defined: ``f[args] += e`` and its like define it first."""

    def __init__(self, func: Func, args: tuple[Expr, ...]):
        self.func, self.args = func, args

    def _started(self, base: int, like: object) -> Expr:
        kind = const(like).kind
        names = [a if a.op == "var" else Var(f"_{k}") for k, a in enumerate(self.args)]
        self.func._define(tuple(names), (const(float(base) if kind.is_float else base, kind),))
        return _call(self.func, self.args)

    def __add__(self, e: object) -> Expr: return self._started(0, e) + e
    def __sub__(self, e: object) -> Expr: return self._started(0, e) - e
    def __mul__(self, e: object) -> Expr: return self._started(1, e) * e
    def __truediv__(self, e: object) -> Expr: return self._started(1, e) / e


@dataclass(eq=False)
class Func:
    name: str = "f"
    vars: tuple[str, ...] | None = None
    pure: tuple[Expr, ...] = ()
    updates: list[Update] = field(default_factory=list)
    root: bool = False
    used: bool = False
    limits: Box = field(default_factory=dict)

    def __getitem__(self, args: object) -> Expr | tuple[Expr, ...] | _Unset:
        args = _args(args)
        if self.vars is None:
            return _Unset(self, args)
        return _call(self, args)

    def __setitem__(self, args: object, value: object) -> None:
        args = _args(args)
        values = tuple(map(const, value)) if isinstance(value, tuple) else (const(value),)
        if self.vars is None:
            self._define(args, values)
        else:
            self._update(args, values)

    def _define(self, args: tuple[Expr, ...], values: tuple[Expr, ...]) -> None:
        if any(a.op != "var" for a in args) or len({a.data for a in args}) < len(args):
            raise GridError(f"the arguments of a pure definition must be distinct variables: {self.name}")
        names = tuple(a.data for a in args)
        for e in (n for v in values for n in v.walk()):
            if e.op == "rvar" and not _inside_reduction(values, e):
                raise GridError(f"a pure definition can't use a reduction variable: {self.name}")
        _closed(self, values, names)
        _freeze(values, self)
        self.vars, self.pure = names, values

    def _update(self, args: tuple[Expr, ...], values: tuple[Expr, ...]) -> None:
        if self.used:
            raise GridError(f"{self.name} is already in use and can't be redefined")
        if len(args) != len(self.vars):
            raise GridError(f"{self.name} has {len(self.vars)} dimensions, not {len(args)}")
        if len(values) != len(self.pure) or any(a.kind != b.kind for a, b in zip(values, self.pure, strict=True)):
            raise GridError(f"an update must have the types of the pure definition: {self.name}")
        if any(a.kind.is_float for a in args):
            raise GridError("coordinates must be whole numbers")
        domains = {n.data[0] for e in (*args, *values) for n in _outside_reductions(e) if n.op == "rvar"}
        if len(domains) > 1:
            raise GridError("a definition can go over one reduction domain only")
        pure = tuple(a.data if a.op == "var" else None for a in args)
        _closed(self, (*args, *values), tuple(p for p in pure if p))
        for call in _calls(values):
            if call.data[0] is self and any(p is not None and not (b.op == "var" and b.data == p) for p, b in zip(pure, call.args, strict=True)):
                raise GridError(f"a reference to itself must keep the pure variables in place: {self.name}")
        if not domains and all(pure) and not any(c.data[0] is self for c in _calls(values)):
            warnings.warn(f"an update hides all earlier definitions of {self.name}", stacklevel=3)
        _freeze((*args, *values), self)
        self.updates.append(Update(args, values, next(iter(domains), None)))

    def compute_root(self) -> Func:
        """Computed once over the box that all of a caller needs, not inlined."""
        self.root = True
        return self

    def bound(self, var: str, least: int, extent: int) -> Func:
        """Declares the box; to ask for more is an error."""
        self.limits[var] = (least, extent)
        return self

    def kinds(self) -> list[Type]:
        return [e.kind for e in self.pure]

    def dimensions(self) -> int:
        return len(self.vars)

    def realize(self, spark: SparkSession, *box: tuple[int, int] | int) -> DataFrame:
        """Coordinates (by the definition's variables) and values (by the name, numbered if several) over ``box``: sizes, or (min, extent)."""
        if self.vars is None:
            raise GridError(f"{self.name} has no definition")
        box = [(0, b) if isinstance(b, int) else b for b in box]
        if len(box) != len(self.vars):
            raise GridError(f"{self.name} has {len(self.vars)} dimensions, not {len(box)}")
        self.used = True
        df = computed(spark, self, box)
        names = [self.name] if len(self.pure) == 1 else [f"{self.name}_{k}" for k in range(len(self.pure))]
        return df.select(*[F.col(f"c{k}").alias(v) for k, v in enumerate(self.vars)], *[F.col(f"v{k}").alias(n) for k, n in enumerate(names)])

    def evaluate(self, spark: SparkSession) -> object:
        """The value of a function without coordinates."""
        row = self.realize(spark).first()
        return row[0] if len(self.pure) == 1 else tuple(row)


def _args(args: object) -> tuple[Expr, ...]:
    args = () if args is None else args if isinstance(args, tuple) else (args,)
    out = tuple(map(const, args))
    if any(a.kind.is_float for a in out):
        raise GridError("coordinates must be whole numbers")
    return out


def _call(callee: Func | Input, args: object) -> Expr | tuple[Expr, ...]:
    args = _args(args)
    if len(args) != callee.dimensions():
        raise GridError(f"{callee.name} has {callee.dimensions()} dimensions, not {len(args)}")
    got = tuple(Expr("call", args, kind, (callee, k)) for k, kind in enumerate(callee.kinds()))
    return got[0] if len(got) == 1 else got


def _calls(values: Iterable[Expr]) -> list[Expr]:
    return [n for v in values for n in v.walk() if n.op == "call"]


def _outside_reductions(e: Expr) -> Iterable[Expr]:
    yield e
    if e.op != "reduce":
        for a in e.args:
            yield from _outside_reductions(a)


def _inside_reduction(values: Iterable[Expr], rvar: Expr) -> bool:
    return all(n is not rvar for v in values for n in _outside_reductions(v))


def _closed(func: Func, values: Iterable[Expr], names: tuple[str, ...]) -> None:
    for n in (n for v in values for n in v.walk()):
        if n.op == "var" and n.data not in names:
            raise GridError(f"{n.data} isn't an argument of {func.name}")


def _freeze(values: Iterable[Expr], but: Func) -> None:
    for call in _calls(values):
        if isinstance(call.data[0], Func) and call.data[0] is not but:
            call.data[0].used = True


def _reduced(op: str, e: Expr, domain: RDom | None) -> tuple[Expr, RDom]:
    """Operand and domain of an inline reduction; the domain is found in the operand if it isn't given."""
    e = const(e)
    found = {n.data[0] for n in _outside_reductions(e) if n.op == "rvar"}
    if domain is None and len(found) != 1:
        raise GridError(f"{op} needs exactly one reduction domain")
    return e, domain or found.pop()


def sum_(e: Expr, domain: RDom | None = None) -> Expr:
    e, domain = _reduced("sum", e, domain)
    return Expr("reduce", (e,), e.kind, ("sum", domain, 0))


def product(e: Expr, domain: RDom | None = None) -> Expr:
    e, domain = _reduced("product", e, domain)
    return Expr("reduce", (e,), e.kind, ("product", domain, 0))


def maximum(e: Expr, domain: RDom | None = None) -> Expr:
    e, domain = _reduced("maximum", e, domain)
    return Expr("reduce", (e,), e.kind, ("max", domain, 0))


def minimum(e: Expr, domain: RDom | None = None) -> Expr:
    e, domain = _reduced("minimum", e, domain)
    return Expr("reduce", (e,), e.kind, ("min", domain, 0))


def _arg(op: str, e: Expr, domain: RDom | None) -> tuple[Expr, ...]:
    e, domain = _reduced(op, e, domain)
    n = len(domain.axes)
    return tuple(Expr("reduce", (e,), Int(32) if k < n else e.kind, (op, domain, k)) for k in range(n + 1))


def argmax(e: Expr, domain: RDom | None = None) -> tuple[Expr, ...]:
    """Coordinates of the first greatest value, then the value."""
    return _arg("argmax", e, domain)


def argmin(e: Expr, domain: RDom | None = None) -> tuple[Expr, ...]:
    return _arg("argmin", e, domain)


# ---- planning ----


def signature(e: Expr) -> str:
    """Equal for equal expressions."""
    data = e.data
    if e.op == "call":
        data = (id(data[0]), data[1])
    elif e.op == "rvar":
        data = (id(data[0]), data[1])
    elif e.op == "reduce":
        data = (data[0], id(data[1]), data[2])
    elif callable(data):
        data = id(data)
    return f"{e.op}<{e.kind}:{data!r}>({','.join(map(signature, e.args))})"


def substituted(e: Expr, by: dict[str, Expr]) -> Expr:
    if e.op == "var":
        return by.get(e.data, e)
    if not e.args:
        return e
    return Expr(e.op, tuple(substituted(a, by) for a in e.args), e.kind, e.data)


def inlined(e: Expr, keep: Func | None = None) -> Expr:
    """``e`` with every call of a function that is neither updated nor a root replaced by its definition."""
    args = tuple(inlined(a, keep) for a in e.args)
    if e.op == "call" and isinstance(f := e.data[0], Func) and f is not keep and not f.updates and not f.root:
        return inlined(substituted(f.pure[e.data[1]], dict(zip(f.vars, args, strict=True))), keep)
    return Expr(e.op, args, e.kind, e.data) if args else e


def sites(spark: SparkSession, box: list[tuple[int, int]], names: list[str]) -> DataFrame:
    """Every site of ``box``, generated in parallel."""
    total = 1
    for _, n in box:
        total *= max(0, n)
    df, below = spark.range(total), 1
    out = []
    for name, (a, n) in zip(names, box, strict=True):
        out.append((F.pmod(F.expr(f"id div {below}") if below > 1 else F.col("id"), F.lit(max(n, 1))) + a).cast("bigint").alias(name))
        below *= max(n, 1)
    return df.select(*out)


class Plan:
    """A DataFrame to which calls and reductions are attached as columns."""

    def __init__(self, spark: SparkSession, df: DataFrame, ranges: dict[object, tuple[int, int]], stage: tuple[Func, DataFrame] | None = None):
        self.spark, self.df, self.ranges, self.stage = spark, df, ranges, stage
        self.columns: dict[str, str] = {}

    def env(self, e: Expr) -> Column | None:
        if e.op == "var":
            return F.col(f"`{e.data}`")
        if e.op == "rvar":
            return F.col(e.data[0].column(e.data[1]))
        if e.op in ("call", "reduce"):
            name = self.columns.get(signature(e))
            return F.col(name) if name else None
        return None

    def column(self, e: Expr) -> Column:
        self.attach([e])
        return compile(e, self.env)

    def attach(self, exprs: Iterable[Expr]) -> None:
        """Calls first whose own arguments have no calls, then those around them."""
        while True:
            open_ = [n for e in exprs for n in _outside_reductions(e) if n.op in ("call", "reduce") and signature(n) not in self.columns]
            ready = [n for n in open_ if n.op == "reduce" or all(m is n or m.op not in ("call", "reduce") or signature(m) in self.columns for m in n.walk())]
            if not open_:
                return
            by_callee: dict[int, list[Expr]] = {}
            for n in {signature(n): n for n in ready}.values():
                if n.op == "reduce":
                    if signature(n) not in self.columns:
                        self.reduce([m for m in {signature(m): m for m in ready}.values() if m.op == "reduce" and m.data[1] is n.data[1]])
                else:
                    by_callee.setdefault(id(n.data[0]), []).append(n)
            for calls in by_callee.values():
                self.join(calls)

    def reduce(self, nodes: list[Expr]) -> None:
        """Inline reductions over one domain: grouped by all coordinates of this plan."""
        domain: RDom = nodes[0].data[1]
        keys = [c for c in self.df.columns if not c.startswith("_v")]
        inner = Plan(self.spark, domain.over(self.df.select(*keys)), self.ranges | domain.ranges(), self.stage)
        inner.attach([n.args[0] for n in nodes])
        aggregates, named = [], {}
        for n in nodes:
            op, _, part = n.data
            name = named.setdefault((op, signature(n.args[0])), f"_v{len(self.columns)}_{len(named)}")
            kind = n.args[0].kind
            value = compile(n.args[0], inner.env)
            if not any(a[0] == name for a in aggregates):
                aggregates.append((name, _aggregate(op, value, kind, domain).alias(name)))
            if op in ("argmax", "argmin"):
                self.columns[signature(n)] = f"{name}.{'value' if part == len(domain.axes) else f'at{part}'}"
            else:
                self.columns[signature(n)] = name
        got = inner.df.groupBy(*keys).agg(*[a for _, a in aggregates]) if keys else inner.df.agg(*[a for _, a in aggregates])
        rest = [c for c in self.df.columns if c.startswith("_v")]
        if not rest and all(n > 0 for _, n in domain.axes):
            self.df = got  # the reduction kept all coordinates: nothing to join back
        elif keys:
            self.df = self.df.join(got, keys, "left")
        else:
            self.df = self.df.crossJoin(got)  # one row on either side

    def join(self, calls: list[Expr]) -> None:
        callee = calls[0].data[0]
        if self.stage and callee is self.stage[0]:
            right = self.stage[1]
        else:
            need = None
            for call in calls:
                own = [bounds(a, self.ranges) for a in call.args]
                if any(b is None for b in own):
                    raise GridError(f"{callee.name} is read at a place that nothing bounds; clamp it")
                own = [(a, z - a + 1) for a, z in own]
                need = own if need is None else [hull(p, q) for p, q in zip(need, own, strict=True)]
            if isinstance(callee, Input):
                # Types bound a place more widely than the input is large: then all of it is needed, no more.
                limits = list(callee.box.values())
                direct = [all(a.op != "call" for a in x.walk()) for x in calls[0].args]
                need = [p if d else q for p, q, d in zip(need, limits, direct, strict=True)]
                right = callee.within(need)
            else:
                right = computed(self.spark, callee, need)
        width = len(callee.kinds())
        fill = callee.fill if isinstance(callee, Input) else None
        taps: dict[tuple[tuple[str, int], ...], list[tuple[Expr, tuple[int, ...]]]] = {}
        gathers: dict[str, list[Expr]] = {}
        for call in calls:
            places = [_place(a) for a in call.args]
            if places and all(places) and len({v for v, _, _ in places}) == len(places):
                taps.setdefault(tuple((v, s) for v, s, _ in places), []).append((call, tuple(d for _, _, d in places)))
            else:
                gathers.setdefault(",".join(map(signature, call.args)), []).append(call)
        for group in gathers.values():
            self._join_computed(group, right, fill)
        for axes, group in taps.items():
            self._join_taps(axes, group, right, width, fill)

    def _name(self, call: Expr) -> str:
        name = f"_v{len(self.columns)}"
        self.columns[signature(call)] = name
        return name

    def _join_computed(self, calls: list[Expr], right: DataFrame, fill: float | None) -> None:
        """A gather: the values of one computed place in one join. Spark broadcasts the table if it is small."""
        args = calls[0].args
        keys = [f"_k{k}" for k in range(len(args))]
        left = self.df.select("*", *[compile(a, self.env).cast("bigint").alias(k) for a, k in zip(args, keys, strict=True)])
        outs = [(self._name(call), call.data[1]) for call in calls]
        values = right.select(*[F.col(f"c{k}").alias(key) for k, key in enumerate(keys)], *[F.col(f"v{v}").alias(o) for o, v in outs])
        got = left.join(values, keys, "left") if keys else left.crossJoin(values)  # without coordinates: one row
        self.df = _filled(got.drop(*keys), [o for o, _ in outs], fill)

    def _join_taps(self, axes: tuple[tuple[str, int], ...], group: list[tuple[Expr, tuple[int, ...]]], right: DataFrame, width: int, fill: float | None) -> None:
        """Calls at constant offsets and equal strides: shifted copies, gathered by site in one aggregation, in one join."""
        names = [n for n, _ in axes]
        offsets = sorted({d for _, d in group})
        outs = [(self._name(call), offsets.index(d), call.data[1]) for call, d in group]
        strided = [(k, s) for k, (_, s) in enumerate(axes) if s > 1]

        def at_sites(df: DataFrame, moved: list[Column], rest: list[Column]) -> DataFrame:
            """Rows of ``df`` that some site reads, by site; between the strides none does."""
            for k, s in strided:
                df = df.where(F.pmod(moved[k], F.lit(s)) == 0)
            return df.select(*[(F.call_function("div", m, F.lit(s)) if s > 1 else m).alias(n) for m, (n, s) in zip(moved, axes, strict=True)], *rest)

        if len(offsets) == 1:
            near = at_sites(right, [F.col(f"c{k}") - d for k, d in enumerate(offsets[0])], [F.col(f"v{v}").alias(o) for o, _, v in outs])
        else:
            copies = F.explode(F.array(*[F.struct(*[F.lit(-d).cast("bigint").alias(f"d{k}") for k, d in enumerate(off)], F.lit(i).alias("tap")) for i, off in enumerate(offsets)])).alias("_t")
            shifted = at_sites(right.select("*", copies), [F.col(f"c{k}") + F.col(f"_t.d{k}") for k in range(len(axes))], [F.col("_t.tap").alias("_tap"), *[F.col(f"v{k}") for k in range(width)]])
            near = shifted.groupBy(*names).agg(*[F.max(F.when(F.col("_tap") == i, F.col(f"v{v}"))).alias(o) for o, i, v in outs])
        self.df = _filled(self.df.join(near, names, "left"), [o for o, _, _ in outs], fill)


def _filled(df: DataFrame, names: list[str], fill: float | None) -> DataFrame:
    return df if fill is None else df.withColumns({n: F.coalesce(n, F.lit(fill).cast(df.schema[n].dataType)) for n in names})


def _offset(e: Expr) -> tuple[str, int] | None:
    """Variable and constant of ``variable + constant``."""
    name = lambda v: v.data if v.op == "var" else v.data[0].column(v.data[1]) if v.op == "rvar" else None
    if name(e):
        return name(e), 0
    if e.op in ("+", "-") and name(e.args[0]) and e.args[1].op == "const":
        return name(e.args[0]), e.args[1].data if e.op == "+" else -e.args[1].data
    if e.op == "+" and name(e.args[1]) and e.args[0].op == "const":
        return name(e.args[1]), e.args[0].data
    return None


def _place(e: Expr) -> tuple[str, int, int] | None:
    """Variable, stride and constant of ``variable * stride + constant``, for strides above nothing."""
    if at := _offset(e):
        return at[0], 1, at[1]
    if e.op in ("+", "-") and e.args[1].op == "const" and (inner := _place(e.args[0])):
        return inner[0], inner[1], inner[2] + (e.args[1].data if e.op == "+" else -e.args[1].data)
    if e.op == "+" and e.args[0].op == "const" and (inner := _place(e.args[1])):
        return inner[0], inner[1], inner[2] + e.args[0].data
    if e.op == "*":
        factor, rest = e.args if e.args[0].op == "const" else e.args[::-1]
        if factor.op == "const" and factor.data > 0 and (inner := _place(rest)):
            return inner[0], inner[1] * factor.data, inner[2] * factor.data
    return None


def _aggregate(op: str, value: Column, kind: Type, domain: RDom) -> Column:
    if op == "sum":
        total = F.sum(value if kind.is_float else value.cast("decimal(38,0)") if kind.bits >= 32 else value.cast("bigint"))
        return total if kind.is_float else _fold_in(total, kind)
    if op == "product":
        if kind.is_float:
            return F.product(value)
        # Whole products wrap at each step; every order gives the same, so the folded list may come in any.
        from gridloom.functions.expr import _multiply

        return F.aggregate(F.collect_list(value.cast("bigint")), F.lit(1).cast("bigint"), lambda s, x: _multiply(s, x, kind))
    if op in ("max", "min"):
        return (F.max if op == "max" else F.min)(value)
    # The first in scan order wins ties: last axis outermost.
    sign = -1 if op == "argmax" else 1
    rank = F.struct(value.alias("value"), *[(c * sign).alias(f"o{k}") for k, c in zip(reversed(range(len(domain.axes))), domain.order(), strict=True)])
    best = (F.max if op == "argmax" else F.min)(rank)
    return F.struct(best["value"].alias("value"), *[(best[f"o{k}"] * sign).alias(f"at{k}") for k in range(len(domain.axes))])


def _fold_in(total: Column, kind: Type) -> Column:
    from gridloom.functions.types import wrap

    if kind.bits < 32:
        return wrap(total, kind)
    modulus = big(1 << kind.bits, 38)
    folded = F.pmod(total.cast("decimal(38,0)"), modulus)
    return wrap(folded if kind.bits == 64 else folded.cast("bigint"), kind)


def computed(spark: SparkSession, func: Func, box: list[tuple[int, int]]) -> DataFrame:
    """``c0``, ... and ``v0``, ... of ``func`` over ``box``."""
    for v, (a, n) in zip(func.vars, box, strict=True):
        if v in func.limits and (a < func.limits[v][0] or a + n > sum(func.limits[v])):
            raise GridError(f"{func.name} is bound to {func.limits[v]} in {v}; {(a, n)} is needed")
    asked, box = box, _with_updates(func, box)
    df = sites(spark, box, [f"{v}" for v in func.vars])
    plan = Plan(spark, df, {v: (a, a + n - 1) for v, (a, n) in zip(func.vars, box, strict=True)})
    values = [inlined(e) for e in func.pure]
    plan.attach(values)
    df = plan.df.select(*[F.col(f"`{v}`").alias(f"c{k}") for k, v in enumerate(func.vars)], *[_stored_value(compile(e, plan.env), e.kind).alias(f"v{k}") for k, e in enumerate(values)])
    for update in func.updates:
        df = updated(spark, func, update, df, box)
    for k, ((a, n), (b, m)) in enumerate(zip(asked, box, strict=True)):
        if (a, n) != (b, m):
            df = df.where(F.col(f"c{k}").between(a, a + n - 1))
    return df


def _stored_value(column: Column, kind: Type) -> Column:
    return column.cast("float").cast("double") if kind.is_float and kind.bits == 32 else column.cast(kind.spark())


def _with_updates(func: Func, box: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The box that the stages of ``func`` must hold so that the updates give ``box``."""
    for u in reversed(func.updates):
        ranges = {a.data: (lo, lo + n - 1) for a, (lo, n) in zip(u.args, box, strict=True) if a.op == "var"} | (u.domain.ranges() if u.domain else {})
        for args in [c.args for c in _calls(u.values) if c.data[0] is func] + ([u.args] if any(c.data[0] is func for c in _calls(u.values)) else []):
            own = [bounds(a, ranges) for a in args]
            box = [hull(b, (o[0], o[1] - o[0] + 1)) if o else b for b, o in zip(box, own, strict=True)]
    return box


_JOINED = {"+": "sum", "-": "sum", "*": "product", "/": "product", "max": "max", "min": "min"}


def updated(spark: SparkSession, func: Func, u: Update, df: DataFrame, box: list[tuple[int, int]]) -> DataFrame:
    """The next stage of ``func`` after one update."""
    names = [f"c{k}" for k in range(len(func.vars))]
    values = [inlined(e, func) for e in u.values]
    args = [inlined(a, func) for a in u.args]
    own = [c for c in _calls((*values, *args)) if c.data[0] is func]
    same = {signature(_self(func, u.args, k)) for k in range(len(values))}
    if not u.domain and all(a.op == "var" for a in args) and all(signature(c) in same for c in own):
        plan = Plan(spark, df.withColumnsRenamed(dict(zip(names, [a.data for a in args], strict=True))), {a.data: (lo, lo + n - 1) for a, (lo, n) in zip(args, box, strict=True)})
        plan.columns |= {signature(_self(func, u.args, k)): f"v{k}" for k in range(len(values))}
        plan.attach(values)
        new = [F.coalesce(_stored_value(compile(e, plan.env), e.kind), F.col(f"v{k}")).alias(f"v{k}") for k, e in enumerate(values)]
        return plan.df.select(*[F.col(f"`{a.data}`").alias(n) for a, n in zip(args, names, strict=True)], *new)

    pure = [(k, a.data) for k, a in enumerate(args) if a.op == "var"]
    ranges = {v: (box[k][0], sum(box[k]) - 1) for k, v in pure} | (u.domain.ranges() if u.domain else {})
    if u.domain and u.domain.source and not pure:
        scan = u.domain.source
        rows = scan.within(list(scan.box.values())).select(*[F.col(f"c{k}").alias(u.domain.column(k)) for k in range(len(scan.coords))], *[F.col(f"v{k}").alias(f"_s{k}") for k in range(len(scan.values))])
        plan = Plan(spark, rows, ranges, (func, df))
        plan.columns |= {signature(_self(scan, tuple(u.domain.vars), k)): f"_s{k}" for k in range(len(scan.values))}
    else:
        rows = sites(spark, [box[k] for k, _ in pure], [v for _, v in pure])
        plan = Plan(spark, u.domain.over(rows) if u.domain else rows, ranges, (func, df))

    joined = [_joined(e, func, u, k) for k, e in enumerate(values)]
    order = F.struct(*u.domain.order()) if u.domain else F.struct(F.lit(0))
    if all(joined):
        plan.attach([*args, *[rest for _, rest in joined]])
        amounts = [compile(rest, plan.env).alias(f"_a{k}") for k, (_, rest) in enumerate(joined)]
        keyed = plan.df.select(*[compile(a, plan.env).cast("bigint").alias(n) for a, n in zip(args, names, strict=True)], *amounts).where(" and ".join(f"_a{k} is not null" for k in range(len(joined))))
        totals = [_aggregate(_JOINED[op], F.col(f"_a{k}"), rest.kind, u.domain or RDom()).alias(f"_a{k}") for k, (op, rest) in enumerate(joined)]
        keyed = keyed.groupBy(*names).agg(*totals) if names else keyed.agg(*totals)
        both = df.join(keyed, names, "left") if names else df.crossJoin(keyed)
        merged = []
        for k, (op, rest) in enumerate(joined):
            pair = Expr(op, (Expr("var", (), rest.kind, f"v{k}"), Expr("var", (), rest.kind, f"_a{k}")), rest.kind)
            merged.append(F.coalesce(_stored_value(compile(pair, lambda e: F.col(e.data) if e.op == "var" else None), rest.kind), F.col(f"v{k}")).alias(f"v{k}"))
        return both.select(*names, *merged)
    if not own:
        plan.attach([*args, *values])
        cells = F.struct(*[_stored_value(compile(e, plan.env), e.kind).alias(f"n{k}") for k, e in enumerate(values)])
        keyed = plan.df.select(*[compile(a, plan.env).cast("bigint").alias(n) for a, n in zip(args, names, strict=True)], order.alias("_order"), cells.alias("_cells"))
        keyed = keyed.where(" and ".join(f"_cells.n{k} is not null" for k in range(len(values))))
        last = keyed.groupBy(*names).agg(F.max_by("_cells", "_order").alias("_cells")) if names else keyed.agg(F.max_by("_cells", "_order").alias("_cells"))
        both = df.join(last, names, "left") if names else df.crossJoin(last)
        return both.select(*names, *[F.coalesce(F.col(f"_cells.n{k}"), F.col(f"v{k}")).alias(f"v{k}") for k in range(len(values))])
    running = _running(values, func, u, args) if len(values) == 1 else None
    if running:
        axis, rest = running
        plan.attach([args[axis], rest])
        keys = [v for _, v in pure]
        steps = plan.df.select(*[F.col(f"`{v}`") for v in keys], compile(args[axis], plan.env).cast("bigint").alias("_at"), compile(rest, plan.env).alias("_step"))
        total = lambda c: F.sum(c if rest.kind.is_float else F.col(c).cast("decimal(38,0)"))
        # Sums run inside ranges as long as there are ranges, and go on with the sums of all ranges before, so no task sees all steps.
        length = max(1, math.isqrt(u.domain.axes[0][1]))
        steps = steps.withColumn("_range", F.expr(f"_at div {length}"))
        along = Window.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        ranges_ = steps.groupBy(*keys, "_range").agg(total("_step").alias("_sum"), F.min("_at").alias("_first"))
        over = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_range")
        ranges_ = ranges_.select(*keys, "_range", F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.first("_first").over(over).alias("_from"))
        steps = steps.withColumn("_inside", total("_step").over(along)).join(ranges_, [*keys, "_range"]).select(*keys, "_at", (F.col("_inside") + F.col("_before")).alias("_total"), "_from")
        start = df.select(*[F.col(f"c{k}").alias(v) for k, v in pure], (F.col(f"c{axis}") + 1).alias("_from"), F.col("v0").alias("_start"))
        steps = steps.join(start, [*keys, "_from"])
        sum_of = F.col("_total") + F.col("_start") if rest.kind.is_float else _fold_in(F.col("_total") + F.col("_start").cast("decimal(38,0)"), rest.kind)
        steps = steps.select(*[F.col(v).alias(f"c{k}") for k, v in pure], F.col("_at").alias(f"c{axis}"), _stored_value(sum_of, rest.kind).alias("_new"))
        return df.join(steps, names, "left").select(*names, F.coalesce("_new", "v0").alias("v0"))
    return _folded(func, u, df, plan, values, args, pure)


def _self(callee: Func | Input, args: tuple[Expr, ...], k: int) -> Expr:
    return Expr("call", args, callee.kinds()[k], (callee, k))


def _joined(e: Expr, func: Func, u: Update, k: int = 0) -> tuple[str, Expr] | None:
    """Operator and operand of ``f(args)[k] = f(args)[k] op rest`` if the order of such steps doesn't matter."""
    me = signature(_self(func, u.args, k))
    if e.op not in _JOINED or (e.op == "/" and not e.kind.is_float):
        return None
    for mine, rest in ((0, 1), (1, 0)):
        if signature(e.args[mine]) == me and not any(c.data[0] is func for c in _calls([e.args[rest]])) and (e.op not in ("-", "/") or mine == 0):
            return e.op, e.args[rest]
    return None


def _running(values: list[Expr], func: Func, u: Update, args: list[Expr]) -> tuple[int, Expr] | None:
    """Axis and step of ``f(.., r, ..) = f(.., r - 1, ..) + step`` over a domain of one axis."""
    e = values[0]
    moving = [k for k, a in enumerate(args) if a.op != "var"]
    if e.op != "+" or len(moving) != 1 or not u.domain or len(u.domain.axes) != 1:
        return None
    axis = moving[0]
    at = _offset(args[axis])
    for mine, rest in ((0, 1), (1, 0)):
        call = e.args[mine]
        if call.op == "call" and call.data[0] is func and at and (before := _offset(call.args[axis])) and before[0] == at[0] and before[1] == at[1] - 1 and not any(c.data[0] is func for c in _calls([e.args[rest]])):
            return axis, e.args[rest]
    return None


def _folded(func: Func, u: Update, df: DataFrame, plan: Plan, values: list[Expr], args: list[Expr], pure: list[tuple[int, str]]) -> DataFrame:
    """Any other recurrence: the steps of one group of the pure coordinates in order, groups in parallel."""
    outer = [c for e in (*args, *values) for c in _outside_reductions(e) if c.op in ("call", "reduce") and not (c.op == "call" and c.data[0] is func)]
    plan.attach(outer)
    plain = {signature(c): plan.columns[signature(c)] for c in outer}
    keys = [v for _, v in pure]
    steps = plan.df
    state = df.withColumnsRenamed({f"c{k}": v for k, v in pure})
    moving = [k for k in range(len(args)) if args[k].op != "var"]
    axes = [u.domain.column(k) for k in range(len(u.domain.axes))] if u.domain else []
    n = len(values)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cells = {tuple(int(left.at[i, f"c{k}"]) for k in moving): [left.at[i, f"v{k}"] for k in range(n)] for i in left.index}
        rows = right.sort_values(axes[::-1]) if axes else right
        for row in rows.to_dict("records"):
            def look(e: Expr, row: dict = row) -> object:
                if e.op == "var":
                    return row[e.data]
                if e.op == "rvar":
                    return row[e.data[0].column(e.data[1])]
                if e.op == "call" and e.data[0].name == func.name and signature_name(e) not in plain_names:
                    return cells[tuple(int(evaluate(e.args[k], look)) for k in moving)][e.data[1]]
                return row[plain_names[signature_name(e)]]

            at = tuple(int(evaluate(args[k], look)) for k in moving)
            new = [evaluate(e, look) for e in values]
            if at in cells and all(v is not None for v in new):
                cells[at] = new
        out = left.copy()
        for k in range(n):
            out[f"v{k}"] = [cells[tuple(int(left.at[i, f"c{j}"]) for j in moving)][k] for i in left.index]
        return out

    plain_names = {_portable(c): plain[signature(c)] for c in outer}
    signature_name = _portable
    func = _Named(func.name)  # workers need the name only
    values, args = [_light(e) for e in values], [_light(e) for e in args]
    groups = keys or ["_all"]
    if not keys:
        state, steps = state.withColumn("_all", F.lit(0)), steps.withColumn("_all", F.lit(0))
    got = state.groupBy(*groups).cogroup(steps.groupBy(*groups)).applyInPandas(run, state.schema)
    return got.select(*[F.col(v).alias(f"c{k}") if v else F.col(f"c{k}") for k, v in ((k, dict(pure).get(k)) for k in range(len(args)))], *[f"v{k}" for k in range(n)])


@dataclass(frozen=True)
class _Named:
    name: str

    def column(self, k: int) -> str:
        return f"_{self.name}{k}"


def _light(e: Expr) -> Expr:
    """``e`` without the DataFrames behind its calls and domains, to be sent to workers."""
    data = e.data
    if e.op == "call":
        data = (_Named(data[0].name), data[1])
    elif e.op == "rvar":
        data = (_Named(data[0].name), data[1])
    elif e.op == "reduce":
        data = (data[0], _Named(data[1].name), data[2])
    return Expr(e.op, tuple(map(_light, e.args)), e.kind, data)


def _portable(e: Expr) -> str:
    data = (e.data[0].name, e.data[1]) if e.op in ("call", "rvar") else (e.data[0], e.data[1].name, e.data[2]) if e.op == "reduce" else e.data
    return f"{e.op}<{e.kind}:{data!r}>({','.join(map(_portable, e.args))})"

