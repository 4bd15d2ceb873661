"""Queries over array views of the tables: access, boundaries, reductions, updates, scans, sorting, and whole programs.

The grid is ``lineitem`` as 64 columns by 7 lines of summed quantities; the series is ``events`` by hour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import expr as E
from gridloom.functions.expr import cast, const, select
from gridloom.functions.types import Float, Int, UInt
from gridloom.operators import boundary, linear
from gridloom.plans.func import Func, Input, RDom, Var, argmax, argmin, maximum, minimum, product, sum_

W, H = 64, 7
x, y, c = Var("x"), Var("y"), Var("c")
i16, i32, i64, u8, u16, f64 = Int(16), Int(32), Int(64), UInt(8), UInt(16), Float(64)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_G = f"""g AS (SELECT l_orderkey % {W} AS x, l_linenumber - 1 AS y, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY 1, 2),
d AS (SELECT x, y, coalesce(v, 0) AS v FROM range({W}) a(x) CROSS JOIN range({H}) b(y) LEFT JOIN g USING (x, y))"""
_G8 = _G.replace("coalesce(v, 0) AS v", "coalesce(v, 0) % 256 AS v")
_T = "e AS (SELECT (epoch_us(ts) // 3600000000 - 473352)::BIGINT AS t, sum((value * 100)::BIGINT)::BIGINT AS v FROM events GROUP BY 1), s AS (SELECT t, coalesce(v, 0) AS v FROM range(720) a(t) LEFT JOIN e USING (t))"


def grid(spark: SparkSession, sf_dir: str, kind=i32) -> Input:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.pmod("l_orderkey", F.lit(W)).alias("x"), (F.col("l_linenumber") - 1).alias("y")).agg(F.sum("l_quantity").cast("bigint").alias("v"))
    if kind != i32:
        df = df.withColumn("v", F.pmod("v", F.lit(256)))
    return Input(df, ("x", "y"), {"v": kind}, {"x": (0, W), "y": (0, H)}, name="grid")


def series(spark: SparkSession, sf_dir: str) -> Input:
    """720 hours from the first of January 2024."""
    hour = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) - 473352).alias("t")
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(hour).agg(F.sum(F.rint(F.col("value") * 100).cast("bigint")).alias("v"))
    return Input(df, ("t",), {"v": i32}, {"t": (0, 720)}, name="series")


def add(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _fixed(df: DataFrame, *names: str) -> DataFrame:
    """Reals to four places, as whole numbers."""
    return df.withColumns({n: F.floor(F.col(n) * 1e4 + 0.5).cast("bigint") for n in names})


def over_grid(value: Callable[[Input], object], name: str = "f", size: tuple[int, int] = (W, H), kind=i32) -> Callable:
    """A query: ``name(x, y) = value(grid)`` over ``size``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = Func(name)
        f[x, y] = value(grid(spark, sf_dir, kind))
        return f.realize(spark, *size)

    return run


def simple(name: str, value: Callable[[Input], object], sql: str, size: tuple[int, int] = (W, H), kind=i32) -> None:
    QUERIES[name] = over_grid(value, size=size, kind=kind)
    ORACLE_SQL[name] = f"WITH {_G} {sql}"


# ---- projection, access ----
simple("p01_pure_definition", lambda g: x * y + 1, f"SELECT x, y, x * y + 1 AS f FROM range({W}) a(x) CROSS JOIN range({H}) b(y)")
simple("p02_tuple", lambda g: (g[x, y] + 1, g[x, y] * 2), "SELECT x, y, v + 1 AS f_0, v * 2 AS f_1 FROM d")
simple("p03_point_call", lambda g: g[x, y] - 3, "SELECT x, y, v - 3 AS f FROM d")
simple("j01_aligned", lambda g: g[x, y] + cast(i32, g[x, y] > 800), "SELECT x, y, v + (v > 800)::INT AS f FROM d")
simple("j03_gather", lambda g: g[E.clamp(g[x, y] / 16, 0, W - 1), y], f"SELECT a.x, a.y, b.v AS f FROM d a JOIN d b ON b.x = least(a.v // 16, {W - 1}) AND b.y = a.y")
simple("j06_downsample", lambda g: g[x * 2, y] + g[x * 2 + 1, y], "SELECT x // 2 AS x, y, sum(v)::BIGINT AS f FROM d GROUP BY 1, 2", (W // 2, H))
simple("j07_upsample", lambda g: g[x / 2, y], "SELECT a.x, a.y, b.v AS f FROM d a JOIN d b ON b.x = a.x // 2 AND b.y = a.y")
simple("j08_torus", lambda g: g[(x + 5) % W, (y - 3) % H], f"SELECT a.x, a.y, b.v AS f FROM d a JOIN d b ON b.x = (a.x + 5) % {W} AND b.y = (a.y + {H} - 3) % {H}")
simple("j09_transpose", lambda g: g[y, x], "SELECT y AS x, x AS y, v AS f FROM d", (H, W))
simple("j10_flip", lambda g: g[W - 1 - x, y], f"SELECT {W - 1} - x AS x, y, v AS f FROM d")
simple("j13_lazy", lambda g: select(g[x, y] % 2 == 0, g[W - 1 - x, y], const(0)), f"SELECT a.x, a.y, CASE WHEN a.v % 2 = 0 THEN b.v ELSE 0 END AS f FROM d a JOIN d b ON b.x = {W - 1} - a.x AND b.y = a.y")
_AT = "FROM d a CROSS JOIN range(-1, 2) i(dx) CROSS JOIN range(-1, 2) j(dy) JOIN d b ON b.x = {x} AND b.y = {y}"
_CLAMP = {"x": f"greatest(least(a.x + dx, {W - 1}), 0)", "y": f"greatest(least(a.y + dy, {H - 1}), 0)"}
_EDGE = _AT.format(**_CLAMP)


@add("j02_stencil", f"WITH {_G} SELECT a.x, a.y, sum(b.v)::BIGINT AS f {_AT.format(x='a.x + dx', y='a.y + dy')} WHERE a.x BETWEEN 1 AND {W - 2} AND a.y BETWEEN 1 AND {H - 2} GROUP BY 1, 2")
def _stencil(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    f[x, y] = sum((g[x + i, y + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (-1, -1)), g[x - 1, y - 1])
    return f.realize(spark, (1, W - 2), (1, H - 2))


@add("j04_outer", f"WITH {_G} SELECT a.x AS x, b.x AS y, a.v * b.v AS f FROM d a JOIN d b ON a.y = 0 AND b.y = 1")
def _outer(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    f[x, y] = cast(i64, g[x, 0]) * cast(i64, g[y, 1])
    return f.realize(spark, W, W)


@add("j05_contraction", f"WITH {_G} SELECT a.y AS x, b.y AS y, sum(a.v * b.v)::BIGINT AS f FROM d a JOIN d b USING (x) GROUP BY 1, 2")
def _contraction(spark, sf_dir):
    g, f, r = grid(spark, sf_dir), Func("f"), RDom((0, W))
    f[x, y] = sum_(cast(Int(64), g[r.x, x]) * g[r.x, y])
    return f.realize(spark, H, H)


@add("j11_tile", f"WITH {_G} SELECT x % 8 AS xi, x // 8 AS xo, y, v AS f FROM d")
def _tile(spark, sf_dir):
    g, f, xi, xo = grid(spark, sf_dir), Func("f"), Var("xi"), Var("xo")
    f[xi, xo, y] = g[xo * 8 + xi, y]
    return f.realize(spark, 8, W // 8, H)


@add("j12_channels", f"WITH {_G} SELECT x, y, c, CASE c WHEN 0 THEN v WHEN 1 THEN v // 2 ELSE 255 - v % 256 END AS f FROM d CROSS JOIN range(3) t(c)")
def _channels(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    f[x, y, c] = select(c == 0, g[x, y], c == 1, g[x, y] / 2, 255 - g[x, y] % 256)
    return f.realize(spark, W, H, 3)


@add("j14_bilinear", f"WITH {_G} SELECT a.x, a.y, floor((a.v * 0.75 * 0.5 + b.v * 0.25 * 0.5 + c.v * 0.75 * 0.5 + e.v * 0.25 * 0.5) * 1e4 + 0.5)::BIGINT AS f FROM d a JOIN d b ON b.x = a.x + 1 AND b.y = a.y JOIN d c ON c.x = a.x AND c.y = a.y + 1 JOIN d e ON e.x = a.x + 1 AND e.y = a.y + 1")
def _bilinear(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    top = E.lerp(cast(f64, g[x, y]), cast(f64, g[x + 1, y]), cast(f64, 0.25))
    low = E.lerp(cast(f64, g[x, y + 1]), cast(f64, g[x + 1, y + 1]), cast(f64, 0.25))
    f[x, y] = E.lerp(top, low, cast(f64, 0.5))
    return _fixed(f.realize(spark, W - 1, H - 1), "f")


@add("j15_tap_window", f"WITH {_G} SELECT a.x, a.y, sum(b.v)::BIGINT AS f FROM d a CROSS JOIN range(3) r(k) JOIN d b ON b.x = least(a.v % 61 + k, {W - 1}) AND b.y = a.y GROUP BY 1, 2")
def _taps(spark, sf_dir):
    g, f, r = grid(spark, sf_dir), Func("f"), RDom((0, 3))
    f[x, y] = sum_(g[E.clamp(g[x, y] % 61 + r.x, 0, W - 1), y])
    return f.realize(spark, W, H)


@add("j16_merge_sorted", "SELECT row_number() OVER (ORDER BY k) - 1 AS x, k AS f FROM (SELECT c_custkey * 3 AS k FROM customer UNION ALL SELECT s_suppkey * 7 + 1 FROM supplier)")
def _merge(spark, sf_dir):
    from gridloom.operators.ordering import indexed

    both = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") * 3).alias("f")).unionAll(spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") * 7 + 1).alias("f")))
    return indexed(both, "x", "f").select("x", "f")


# ---- boundary conditions ----
def _bounded(name: str, make: Callable[[Input], Func], sql: str) -> None:
    @add(name, f"WITH {_G} {sql}")
    def run(spark, sf_dir):
        f, b = Func("f"), make(grid(spark, sf_dir))
        f[x, y] = b[x, y]
        return f.realize(spark, (-9, W + 20), (-9, H + 20))


_OUT = f"FROM range(-9, {W + 11}) a(x) CROSS JOIN range(-9, {H + 11}) b(y)"


def _mapped(m: str) -> str:
    return f"SELECT a.x, b.y, d.v AS f {_OUT} JOIN d ON d.x = {m.format(c='a.x', n=W)} AND d.y = {m.format(c='b.y', n=H)}"


_bounded("b1_repeat_edge", boundary.repeat_edge, _mapped("greatest(least({c}, {n} - 1), 0)"))
_bounded("b2_constant_exterior", lambda g: boundary.constant_exterior(g, -7), f"SELECT a.x, b.y, coalesce(d.v, -7) AS f {_OUT} LEFT JOIN d ON d.x = a.x AND d.y = b.y")
_bounded("b3_repeat_image", boundary.repeat_image, _mapped("(({c} % {n}) + {n}) % {n}"))
_bounded("b4_mirror_image", boundary.mirror_image, _mapped("least(({c} % (2 * {n}) + 2 * {n}) % (2 * {n}), 2 * {n} - 1 - ({c} % (2 * {n}) + 2 * {n}) % (2 * {n}))"))
_bounded("b5_mirror_interior", boundary.mirror_interior, _mapped("{n} - 1 - abs(({c} % (2 * {n} - 2) + 2 * {n} - 2) % (2 * {n} - 2) - ({n} - 1))"))


@add("b6_unbounded_axis", f"WITH {_G} SELECT a.x, d.y, d.v AS f FROM range(-5, {W + 5}) a(x) JOIN d ON d.x = greatest(least(a.x, {W - 1}), 0)")
def _one_axis(spark, sf_dir):
    f, b = Func("f"), boundary.repeat_edge(grid(spark, sf_dir), [(0, W), None])
    f[x, y] = b[x, y]
    return f.realize(spark, (-5, W + 10), H)


# ---- inline reductions ----
def _by_line(name: str, value: Callable[[Input, RDom], object], sql: str) -> None:
    @add(name, f"WITH {_G} SELECT y, {sql} FROM d GROUP BY y")
    def run(spark, sf_dir):
        g, f, r = grid(spark, sf_dir), Func("f"), RDom((0, W))
        f[y] = value(g, r)
        return f.realize(spark, H)


_by_line("a01_sum", lambda g, r: sum_(g[r.x, y]), "sum(v)::BIGINT AS f")
_by_line("a02_product", lambda g, r: product(g[r.x, y] % 3 + 1), "")
_by_line("a03_maximum", lambda g, r: maximum(g[r.x, y]), "max(v) AS f")
_by_line("a04_minimum", lambda g, r: minimum(g[r.x, y]), "min(v) AS f")
_by_line("a05_argmax", lambda g, r: argmax(g[r.x, y] / 64), "")
_by_line("a06_argmin", lambda g, r: argmin(g[r.x, y] / 64), "")
ORACLE_SQL["a05_argmax"] = f"WITH {_G} SELECT y, x AS f_0, v // 64 AS f_1 FROM d QUALIFY row_number() OVER (PARTITION BY y ORDER BY v // 64 DESC, x) = 1"
ORACLE_SQL["a06_argmin"] = f"WITH {_G} SELECT y, x AS f_0, v // 64 AS f_1 FROM d QUALIFY row_number() OVER (PARTITION BY y ORDER BY v // 64, x) = 1"
ORACLE_SQL["a02_product"] = f"WITH RECURSIVE {_G}, r AS (SELECT y, 0 AS k, 1::BIGINT AS f FROM range({H}) b(y) UNION ALL SELECT r.y, k + 1, ((f * (d.v % 3 + 1)) % 4294967296)::BIGINT FROM r JOIN d ON d.y = r.y AND d.x = k) SELECT y, CASE WHEN f >= 2147483648 THEN f - 4294967296 ELSE f END AS f FROM r WHERE k = {W}"


@add("a07_free_variables", f"WITH {_G} SELECT x, y, (SELECT sum(b.v * k)::BIGINT FROM range(3) r(k) JOIN d b ON b.x = (d.x + k) % {W} AND b.y = d.y) + x AS f FROM d")
def _free(spark, sf_dir):
    g, f, r = grid(spark, sf_dir), Func("f"), RDom((0, 3))
    f[x, y] = sum_(g[(x + r.x) % W, y] * r.x) + x
    return f.realize(spark, W, H)


@add("a22_two_stage_sum", f"WITH {_G} SELECT sum(v)::BIGINT AS f FROM d")
def _two_stage(spark, sf_dir):
    g, part, f, r1, r2 = grid(spark, sf_dir), Func("part"), Func("f"), RDom((0, 16), (0, H)), RDom((0, 4), name="q")
    part[x] = sum_(g[x * 16 + r1.x, r1.y])
    part.compute_root()
    f[()] = sum_(part[r2.x])
    return f.realize(spark)


@add("a29_local_statistics", f"WITH {_G} SELECT a.x, a.y, sum(b.v)::BIGINT AS f_0, (9 * sum(b.v * b.v) - sum(b.v) * sum(b.v))::BIGINT AS f_1, min(b.v) AS f_2, max(b.v) AS f_3 {_EDGE} GROUP BY 1, 2")
def _local(spark, sf_dir):
    f, b, r = Func("f"), boundary.repeat_edge(grid(spark, sf_dir)), RDom((-1, 3), (-1, 3))
    v = b[x + r.x, y + r.y]
    total, squares = cast(Int(64), sum_(v)), sum_(cast(Int(64), v) * v)
    f[x, y] = (sum_(v), 9 * squares - total * total, minimum(v), maximum(v))
    return f.realize(spark, W, H)


@add("a33_domain_3d", "SELECT x, (SELECT sum(i * j * k)::BIGINT FROM range(1, 4) a(i) CROSS JOIN range(2) b(j) CROSS JOIN range(-1, 3) e(k)) + 24 * x AS f FROM range(5) i(x)")
def _domain(spark, sf_dir):
    f, r = Func("f"), RDom((1, 3), (0, 2), (-1, 4))
    f[x] = sum_(r.x * r.y * r.z + x)
    return f.realize(spark, 5)


# ---- updates ----
_HIST = f"h AS (SELECT v % 256 AS x, count(*) AS n FROM d GROUP BY 1), b AS (SELECT x, coalesce(n, 0) AS n FROM range(256) a(x) LEFT JOIN h USING (x))"


def histogram(g: Input) -> Func:
    h, r = Func("hist"), RDom(g)
    h[x] = const(0)
    h[cast(i32, g[r.x, r.y]) % 256] += 1
    return h


@add("a12_histogram", f"WITH {_G}, {_HIST} SELECT x, n AS hist FROM b")
def _histogram(spark, sf_dir):
    return histogram(grid(spark, sf_dir)).realize(spark, 256)


@add("a32_domain_of_input", f"WITH {_G} SELECT x, sum(v)::BIGINT AS f FROM d GROUP BY 1")
def _of_input(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    r = RDom(g)
    f[x] = const(0)
    f[r.x] += g[r.x, r.y]
    return f.realize(spark, W)


def _accumulated(name: str, step: Callable, sql: str, start: object = 5) -> None:
    @add(name, f"WITH {_G} SELECT y, {sql} AS f FROM d GROUP BY y")
    def run(spark, sf_dir):
        g, f, r = grid(spark, sf_dir), Func("f"), RDom((0, W))
        f[y] = const(start) if not isinstance(start, float) else cast(f64, start)
        f[y] = step(f[y], g[r.x, y])
        out = f.realize(spark, H)
        return _fixed(out, "f") if isinstance(start, float) else out


_accumulated("a09_add", lambda f, v: f + v, "5 + sum(v)::BIGINT")
_accumulated("a10_subtract", lambda f, v: f - v, "5 - sum(v)::BIGINT")
_accumulated("a11_multiply", lambda f, v: f * cast(f64, 1.0 + cast(f64, v % 5) / 16.0), "", 2.0)
ORACLE_SQL["a11_multiply"] = f"WITH {_G} SELECT y, floor(2 * product(1 + (v % 5)::DOUBLE / 16.0) * 1e4 + 0.5)::BIGINT AS f FROM d GROUP BY y"
_accumulated("a11b_divide", lambda f, v: f / cast(f64, 1.0 + cast(f64, v % 5) / 64.0), "", 1e6)
ORACLE_SQL["a11b_divide"] = f"WITH {_G} SELECT y, floor(1e6 / product(1 + (v % 5)::DOUBLE / 64.0) * 1e4 + 0.5)::BIGINT AS f FROM d GROUP BY y"


@add("a13_scatter_last_wins", f"WITH {_G}, w AS (SELECT v % 50 AS x, v AS n FROM d QUALIFY row_number() OVER (PARTITION BY v % 50 ORDER BY y DESC, x DESC) = 1) SELECT a.x, coalesce(n, -1) AS f FROM range(50) a(x) LEFT JOIN w USING (x)")
def _scatter(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    r = RDom(g)
    f[x] = const(-1)
    f[g[r.x, r.y] % 50] = g[r.x, r.y]
    return f.realize(spark, 50)


@add("a13b_shifted_recurrence", "SELECT x, y, CASE WHEN x >= -10 AND x < 10 THEN (x + 11) * 100 ELSE 0 END + y AS f FROM range(-11, 12) a(x) CROSS JOIN range(4) b(y)")
def _shifted(spark, sf_dir):
    f, r = Func("f"), RDom((-10, 20))
    f[x, y] = cast(i32, y)
    f[r.x, y] = f[r.x - 1, y] + 100
    return f.realize(spark, (-11, 23), 4)


@add("a14_prefix_scan", f"WITH {_T} SELECT t, sum(v) OVER (ORDER BY t)::BIGINT AS f FROM s")
def _scan(spark, sf_dir):
    s, f, r, t = series(spark, sf_dir), Func("f"), RDom((0, 720)), Var("t")
    f[t] = cast(i64, const(0))
    f[r.x] = f[r.x - 1] + cast(i64, s[r.x])
    return f.realize(spark, 720)


@add("a23_parallel_prefix", f"WITH {_T} SELECT t, sum(v) OVER (ORDER BY t)::BIGINT AS f FROM s")
def _blocked_scan(spark, sf_dir):
    from gridloom.operators.ordering import blocked_scan

    return blocked_scan(series(spark, sf_dir), 24, "f")


@add("a15_linear_recurrence", f"WITH RECURSIVE {_G}, r AS (SELECT x, 0 AS y, v::DOUBLE AS f FROM d WHERE y = 0 UNION ALL SELECT r.x, r.y + 1, 0.75 * f + 0.25 * d.v FROM r JOIN d ON d.x = r.x AND d.y = r.y + 1) SELECT x, y, floor(f * 1e4 + 0.5)::BIGINT AS f FROM r")
def _iir(spark, sf_dir):
    g, f, r = grid(spark, sf_dir), Func("f"), RDom((1, H - 1))
    f[x, y] = cast(f64, g[x, y])
    f[x, r.x] = cast(f64, 0.75) * f[x, r.x - 1] + cast(f64, 0.25) * f[x, r.x]
    return _fixed(f.realize(spark, W, H), "f")


@add("a16_compaction", f"WITH {_T} SELECT row_number() OVER (ORDER BY t) - 1 AS x, t AS f FROM s WHERE v % 5 = 0 OR v % 7 = 0")
def _compaction(spark, sf_dir):
    from gridloom.operators.ordering import compact

    s = series(spark, sf_dir)
    return compact(s, (F.col("v") % 5 == 0) | (F.col("v") % 7 == 0), "x", "f")


@add("a17_fibonacci", "WITH RECURSIVE r AS (SELECT 0 AS x, 1::BIGINT AS f, 1::BIGINT AS n UNION ALL SELECT x + 1, n, f + n FROM r WHERE x < 39) SELECT x::BIGINT AS x, f FROM r")
def _fibonacci(spark, sf_dir):
    f, r = Func("f"), RDom((2, 38))
    f[x] = const(1)
    f[r.x] = f[r.x - 1] + f[r.x - 2]
    return f.realize(spark, 40)


@add("a18_multi_pass", f"WITH {_G}, p AS (SELECT x, y, v + y AS a FROM d), q AS (SELECT y, sum(a)::BIGINT AS b FROM p GROUP BY y) SELECT x, y, CASE WHEN x = 3 THEN b * 2 ELSE a * 2 END AS f FROM p JOIN q USING (y)")
def _passes(spark, sf_dir):
    g, f, first, r = grid(spark, sf_dir), Func("f"), Func("first"), RDom((0, W))
    first[x, y] = g[x, y] + y
    first.compute_root()
    f[x, y] = first[x, y]
    f[3, y] = const(0)
    f[3, y] = f[3, y] + first[r.x, y]
    f[x, y] = f[x, y] * 2
    return f.realize(spark, W, H)


@add("a19_newton", "WITH RECURSIVE r AS (SELECT o_orderkey, o_totalprice AS p, 0 AS k, greatest(o_totalprice, 1.0)::DOUBLE AS f FROM orders UNION ALL SELECT o_orderkey, p, k + 1, f - (f * f - p) / (2 * f) FROM r WHERE k < 20) SELECT o_orderkey, floor(f * 1e4 + 0.5)::BIGINT AS f FROM r WHERE k = 20")
def _newton(spark, sf_dir):
    p = F.col("o_totalprice")
    step = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.greatest(p, F.lit(1.0)), lambda f, _: f - (f * f - p) / (f * 2))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.floor(step * 1e4 + 0.5).cast("bigint").alias("f"))


@add("a21_tuple_reduction", f"WITH {_G} SELECT y, sum(v)::BIGINT AS f_0, sum(v * v)::BIGINT AS f_1 FROM d GROUP BY y")
def _pair(spark, sf_dir):
    g, f, r = grid(spark, sf_dir), Func("f"), RDom((0, W))
    f[y] = (cast(i64, const(0)), cast(i64, const(0)))
    a, b = f[y]
    v = cast(i64, g[r.x, y])
    f[y] = (a + v, b + v * v)
    return f.realize(spark, H)


@add("a24_zero_dimensions", f"WITH {_G} SELECT sum(v)::BIGINT + 3 AS f FROM d")
def _zero(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    r = RDom(g)
    f[()] = const(3)
    f[()] = f[()] + g[r.x, r.y]
    return f.realize(spark)


@add("a25_in_place", f"WITH {_G} SELECT x, y, CASE WHEN v % 3 = 0 THEN -v ELSE v END AS f FROM d")
def _in_place(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    f[x, y] = g[x, y]
    f[x, y] = select(f[x, y] % 3 == 0, -f[x, y], E.undef(i32))
    return f.realize(spark, W, H)


@add("a26_lists", "SELECT x, string_agg(k::VARCHAR, ',' ORDER BY k) AS f FROM range(1, 100) a(x) JOIN range(1, 100) b(k) ON x % k = 0 GROUP BY x")
def _lists(spark, sf_dir):
    every = F.sequence(F.lit(1), F.lit(99))
    return spark.range(1, 100).select(F.col("id").alias("x"), F.array_join(F.filter(every, lambda k: F.col("id") % k == 0), ",").alias("f"))


@add("a27_equalize", f"WITH q AS (SELECT l_quantity::BIGINT AS v FROM lineitem), h AS (SELECT v, count(*) AS n FROM q GROUP BY v), c AS (SELECT v, sum(n) OVER (ORDER BY v) AS s FROM h) SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS v, (s * 255 // (SELECT count(*) FROM lineitem))::BIGINT AS f FROM lineitem JOIN c ON c.v = l_quantity::BIGINT")
def _equalize(spark, sf_dir):
    from gridloom.operators.ordering import equalized

    return equalized(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("v")), "v", 256, "f")


@add("a28_summed_area", f"WITH {_G} SELECT a.x, a.y, sum(b.v)::BIGINT AS f FROM d a JOIN d b ON b.x <= a.x AND b.y <= a.y GROUP BY 1, 2")
def _area(spark, sf_dir):
    g, f, along, down = grid(spark, sf_dir), Func("f"), RDom((1, W - 1)), RDom((1, H - 1), name="q")
    f[x, y] = g[x, y]
    f[along.x, y] = f[along.x - 1, y] + g[along.x, y]
    rows = Func("rows")
    rows[x, y] = f[x, y]
    rows.compute_root()
    out = Func("f")
    out[x, y] = rows[x, y]
    out[x, down.x] = out[x, down.x - 1] + rows[x, down.x]
    return out.realize(spark, W, H)


# ---- order ----
@add("o1_sort", "SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS x, c_custkey AS f FROM customer")
def _sort(spark, sf_dir):
    from gridloom.operators.ordering import indexed

    return indexed(spark.read.parquet(f"{sf_dir}/customer.parquet"), "x", "c_acctbal", "c_custkey").select("x", F.col("c_custkey").alias("f"))


@add("o2_bitonic", f"WITH {_G} SELECT y, string_agg(v::VARCHAR, ',' ORDER BY v) AS f FROM d GROUP BY y")
def _rows_sorted(spark, sf_dir):
    g = grid(spark, sf_dir)
    dense = Func("v")
    dense[x, y] = g[x, y]
    return dense.realize(spark, W, H).groupBy("y").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("f"))


@add("o4_crop", f"WITH {_G} SELECT x, y, v AS f FROM d WHERE x BETWEEN 10 AND 19 AND y BETWEEN 2 AND 4")
def _crop(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    f[x, y] = g[x, y]
    return f.realize(spark, (10, 10), (2, 3))


@add("o5_top_one", "SELECT o_custkey, o_orderkey AS at, o_totalprice AS f FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _top(spark, sf_dir):
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(best).select("o_custkey", (-F.col("b.k")).alias("at"), F.col("b.o_totalprice").alias("f"))


@add("o6_sliding_sum", f"WITH {_T} SELECT t, sum(v) OVER (ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS f FROM s")
def _sliding(spark, sf_dir):
    t, f = Var("t"), Func("f")
    b, r = boundary.constant_exterior(series(spark, sf_dir), 0), RDom((-1, 3))
    f[t] = sum_(b[t + r.x])
    return f.realize(spark, 720)


QUERIES["o7_running"], ORACLE_SQL["o7_running"] = _scan, ORACLE_SQL["a14_prefix_scan"]


@add("o8_concat", f"WITH {_G} SELECT x, y, v AS f FROM d UNION ALL SELECT x + {W}, y, v * 2 FROM d")
def _concat(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    f[x, y] = select(x < W, g[E.clamp(x, 0, W - 1), y], g[E.clamp(x - W, 0, W - 1), y] * 2)
    return f.realize(spark, 2 * W, H)


# ---- programs ----
def blur(g: Input) -> Func:
    b, across, f = boundary.repeat_edge(g), Func("across"), Func("f")
    across[x, y] = (b[x - 1, y] + b[x, y] + b[x + 1, y]) / 3
    across.compute_root()
    f[x, y] = (across[x, y - 1] + across[x, y] + across[x, y + 1]) / 3
    return f


_CX = f"c AS (SELECT a.x, a.y, sum(b.v)::BIGINT // 3 AS v FROM d a CROSS JOIN range(-1, 2) i(dx) JOIN d b ON b.x = {_CLAMP['x']} AND b.y = a.y GROUP BY 1, 2)"


@add("w01_blur", f"WITH {_G}, {_CX} SELECT a.x, a.y, sum(b.v)::BIGINT // 3 AS f FROM c a CROSS JOIN range(-1, 2) j(dy) JOIN c b ON b.x = a.x AND b.y = {_CLAMP['y']} GROUP BY 1, 2")
def _blur(spark, sf_dir):
    return blur(grid(spark, sf_dir)).realize(spark, W, H)


@add("w06_hot_pixels", f"WITH {_G} SELECT x, y, greatest(least(v, hi), lo) AS f FROM (SELECT a.x, a.y, any_value(a.v) AS v, max(b.v) AS hi, min(b.v) AS lo FROM d a CROSS JOIN (VALUES (-2, 0), (2, 0), (0, -2), (0, 2)) o(dx, dy) JOIN d b ON b.x = {_CLAMP['x']} AND b.y = {_CLAMP['y']} GROUP BY 1, 2)")
def _hot(spark, sf_dir):
    b, f = boundary.repeat_edge(grid(spark, sf_dir)), Func("f")
    near = [b[x - 2, y], b[x + 2, y], b[x, y - 2], b[x, y + 2]]
    high, low = near[0], near[0]
    for n in near[1:]:
        high, low = E.maximum_of(high, n), E.minimum_of(low, n)
    f[x, y] = E.clamp(b[x, y], low, high)
    return f.realize(spark, W, H)


@add("w10_haar", f"WITH {_G} SELECT a.x // 2 AS x, a.y, floor((a.v + b.v) / 2.0::DOUBLE * 1e4 + 0.5)::BIGINT AS f_0, floor((a.v - b.v) / 2.0::DOUBLE * 1e4 + 0.5)::BIGINT AS f_1 FROM d a JOIN d b ON a.x % 2 = 0 AND b.x = a.x + 1 AND a.y = b.y")
def _haar(spark, sf_dir):
    b, f = boundary.repeat_edge(grid(spark, sf_dir)), Func("f")
    left, right = cast(f64, b[2 * x, y]), cast(f64, b[2 * x + 1, y])
    f[x, y] = ((left + right) / 2.0, (left - right) / 2.0)
    return _fixed(f.realize(spark, W // 2, H), "f_0", "f_1")


@add("w10_haar_inverse", f"WITH {_G} SELECT x, y, v AS f FROM d")
def _haar_back(spark, sf_dir):
    g, low, f = grid(spark, sf_dir), Func("low"), Func("f")
    low[x, y] = ((cast(f64, g[2 * x, y]) + cast(f64, g[2 * x + 1, y])) / 2.0, (cast(f64, g[2 * x, y]) - cast(f64, g[2 * x + 1, y])) / 2.0)
    low.compute_root()
    a, b = low[x / 2, y]
    f[x, y] = cast(i32, select(x % 2 == 0, a + b, a - b))
    return f.realize(spark, W, H)


@add("w19_erode", f"WITH {_G} SELECT a.x, a.y, min(b.v) AS f FROM d a CROSS JOIN range(-2, 3) i(dx) CROSS JOIN range(-2, 3) j(dy) JOIN d b ON b.x = {_CLAMP['x']} AND b.y = {_CLAMP['y']} GROUP BY 1, 2")
def _erode(spark, sf_dir):
    b, f, r = boundary.repeat_edge(grid(spark, sf_dir)), Func("f"), RDom((-2, 5), (-2, 5))
    f[x, y] = minimum(b[x + r.x, y + r.y])
    return f.realize(spark, W, H)


_CROSS = _AT.format(x=_CLAMP["x"], y=_CLAMP["y"])


@add("w20_edges", f"WITH {_G8} SELECT x, y, greatest(least(CASE WHEN gx * gx + gy * gy > 32767 THEN gx * gx + gy * gy - 65536 ELSE gx * gx + gy * gy END, 255), 0)::BIGINT AS f FROM (SELECT a.x, a.y, floor(sum(b.v * dx) / 2.0::DOUBLE)::BIGINT AS gx, floor(sum(b.v * dy) / 2.0::DOUBLE)::BIGINT AS gy {_CROSS} WHERE abs(dx) + abs(dy) = 1 GROUP BY 1, 2)")
def _edges(spark, sf_dir):
    b, f = boundary.repeat_edge(grid(spark, sf_dir, u8)), Func("f")
    at = lambda i, j: cast(i16, b[x + i, y + j])
    gx, gy = (at(1, 0) - at(-1, 0)) / 2, (at(0, 1) - at(0, -1)) / 2
    f[x, y] = cast(u8, E.clamp(gx * gx + gy * gy, 0, 255))
    return f.realize(spark, W, H)


@add("w21_unsharp", f"WITH {_G8}, t AS (SELECT x, y, floor(pow(v / 256::DOUBLE, 1.8::DOUBLE) * 256)::BIGINT AS v FROM d) SELECT a.x, a.y, greatest(least(sum(b.v * CASE WHEN dx = 0 AND dy = 0 THEN 9 ELSE -2 END), 255), 0)::BIGINT AS f {_CROSS.replace('FROM d', 'FROM t').replace('JOIN d b', 'JOIN t b')} WHERE abs(dx) + abs(dy) <= 1 GROUP BY 1, 2")
def _unsharp(spark, sf_dir):
    tone, curved, f, i = Func("tone"), Func("curved"), Func("f"), Var("i")
    tone[i] = cast(i16, E.power(cast(f64, i) / 256.0, 1.8) * 256.0)
    tone.compute_root()
    b = boundary.repeat_edge(grid(spark, sf_dir, u8))
    curved[x, y] = tone[cast(i32, b[x, y])]
    f[x, y] = cast(u8, E.clamp(9 * curved[x, y] - 2 * (curved[x - 1, y] + curved[x + 1, y] + curved[x, y - 1] + curved[x, y + 1]), 0, 255))
    return f.realize(spark, W, H)


# The constant and the weights of red, green and blue of the three channels.
YCC = ((16, 0.257, 0.504, 0.098), (128, 0.439, -0.368, -0.071), (128, -0.148, -0.291, 0.439))
_YCC = ", ".join(f"trunc(({a}::DOUBLE / 255 + ({r}::DOUBLE * r + {g}::DOUBLE * g + {b}::DOUBLE * b)) * 255)::BIGINT AS f_{k}" for k, (a, r, g, b) in enumerate(YCC))


@add("w22_ycc", f"SELECT l_orderkey, l_linenumber, {_YCC} FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT * 5 / 255::DOUBLE AS r, l_suppkey % 256 / 255::DOUBLE AS g, l_partkey % 256 / 255::DOUBLE AS b FROM lineitem)")
def _ycc(spark, sf_dir):
    r, g, b = (cast(f64, E.Expr("var", (), i32, n)) / 255.0 for n in "rgb")
    parts = [cast(u8, (const(a, f64) / 255.0 + (wr * r + wg * g + wb * b)) * 255.0) for a, wr, wg, wb in YCC]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("bigint") * 5).alias("r"), F.pmod("l_suppkey", F.lit(256)).alias("g"), F.pmod("l_partkey", F.lit(256)).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", *[E.compile(e, lambda n: F.col(n.data) if n.op == "var" else None).alias(f"f_{k}") for k, e in enumerate(parts)])


@add("w23_mandelbrot", "WITH RECURSIVE r AS (SELECT x, y, (x - 40) / 20.0::DOUBLE AS cr, (y - 20) / 16.0::DOUBLE AS ci, 0::DOUBLE AS a, 0::DOUBLE AS b, 0 AS k, 0 AS f FROM range(60) p(x) CROSS JOIN range(40) q(y) UNION ALL SELECT x, y, cr, ci, CASE WHEN a * a + b * b < 4 THEN a * a - b * b + cr ELSE a END, CASE WHEN a * a + b * b < 4 THEN 2 * a * b + ci ELSE b END, k + 1, f + (a * a + b * b < 4)::INT FROM r WHERE k < 32) SELECT x, y, f::BIGINT AS f FROM r WHERE k = 32")
def _mandelbrot(spark, sf_dir):
    from gridloom.plans.func import sites

    z0 = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).cast("bigint").alias("n"))
    cr, ci = (F.col("x") - 40) / 20.0, (F.col("y") - 20) / 16.0

    def step(z, _):
        on = z["a"] * z["a"] + z["b"] * z["b"] < 4
        return F.struct(F.when(on, z["a"] * z["a"] - z["b"] * z["b"] + cr).otherwise(z["a"]).alias("a"), F.when(on, z["a"] * 2 * z["b"] + ci).otherwise(z["b"]).alias("b"), (z["n"] + on.cast("bigint")).alias("n"))

    return sites(spark, [(0, 60), (0, 40)], ["x", "y"]).select("x", "y", F.aggregate(F.sequence(F.lit(1), F.lit(32)), z0, step)["n"].alias("f"))


_LIFE = "SELECT a.x, a.y, CASE WHEN sum(b.v) - any_value(a.v) = 3 OR (any_value(a.v) = 1 AND sum(b.v) - any_value(a.v) = 2) THEN 1 ELSE 0 END::BIGINT AS v FROM {t} a CROSS JOIN range(-1, 2) i(dx) CROSS JOIN range(-1, 2) j(dy) JOIN {t} b ON b.x = (a.x + dx + 64) % 64 AND b.y = (a.y + dy + 7) % 7 GROUP BY 1, 2"


@add("w25_life", f"WITH {_G}, l0 AS (SELECT x, y, (v % 3 = 0)::BIGINT AS v FROM d), l1 AS ({_LIFE.format(t='l0')}), l2 AS ({_LIFE.format(t='l1')}) SELECT x, y, v AS f FROM l2")
def _life(spark, sf_dir):
    g, now = grid(spark, sf_dir), Func("start")
    now[x, y] = cast(i32, g[x, y] % 3 == 0)
    now.compute_root()
    for _ in range(2):
        wrapped, after = boundary.repeat_image(now, [(0, W), (0, H)]), Func("f")
        n = sum((wrapped[x + i, y + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) not in ((0, 0), (-1, -1))), wrapped[x - 1, y - 1])
        after[x, y] = cast(i32, (n == 3) | ((wrapped[x, y] == 1) & (n == 2)))
        now = after.compute_root()
    return now.realize(spark, W, H)


@add("w26_pyramid", f"WITH {_G}, p AS (SELECT x // 2 AS x, y, sum(v)::BIGINT // 2 AS v FROM d GROUP BY 1, 2) SELECT x // 2 AS x, y, sum(v)::BIGINT // 2 AS f FROM p GROUP BY 1, 2")
def _pyramid(spark, sf_dir):
    now = grid(spark, sf_dir)
    for _ in range(2):
        f = Func("f")
        f[x, y] = (now[2 * x, y] + now[2 * x + 1, y]) / 2
        now = f.compute_root()
    return now.realize(spark, W // 4, H)


@add("w29_convolution", f"WITH {_G} SELECT a.x, a.y, sum(b.v * (2 - abs(dx)) * (2 - abs(dy)))::BIGINT AS f {_EDGE} GROUP BY 1, 2")
def _convolution(spark, sf_dir):
    b, f, r = boundary.repeat_edge(grid(spark, sf_dir)), Func("f"), RDom((-1, 3), (-1, 3))
    kernel = Input(spark.createDataFrame([(i, j, (2 - abs(i)) * (2 - abs(j))) for i in (-1, 0, 1) for j in (-1, 0, 1)], "i long, j long, w long"), ("i", "j"), {"w": i32}, {"i": (-1, 3), "j": (-1, 3)}, name="kernel")
    f[x, y] = sum_(b[x + r.x, y + r.y] * kernel[r.x, r.y])
    return f.realize(spark, W, H)


@add("w31_spread", f"WITH {_G8} SELECT a.x, a.y, max(b.v) - min(b.v) AS f FROM d a CROSS JOIN range(-2, 3) i(dx) CROSS JOIN range(-2, 3) j(dy) JOIN d b ON b.x = {_CLAMP['x']} AND b.y = {_CLAMP['y']} GROUP BY 1, 2")
def _spread(spark, sf_dir):
    b, f, r = boundary.repeat_edge(grid(spark, sf_dir, u8)), Func("f"), RDom((-2, 5), (-2, 5))
    f[x, y] = maximum(b[x + r.x, y + r.y]) - minimum(b[x + r.x, y + r.y])
    return f.realize(spark, W, H)


# ---- linear algebra over embeddings ----
def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))


_M = "m AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS a FROM embeddings)"


@add("w12_axpy", f"WITH {_M} SELECT vec_id, k::BIGINT AS k, floor((2.5 * a + k) * 1e4 + 0.5)::BIGINT AS f FROM m")
def _axpy(spark, sf_dir):
    out = linear.axpy(_vectors(spark, sf_dir), "v", 2.5, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: k.cast("double")))
    return _fixed(out.select("vec_id", F.posexplode("v").alias("k", "f")).withColumn("k", F.col("k").cast("bigint")), "f")


@add("w13_dot", f"WITH {_M} SELECT vec_id, floor(sum(a * a) * 1e4 + 0.5)::BIGINT AS f FROM m GROUP BY 1")
def _dot(spark, sf_dir):
    return _fixed(_vectors(spark, sf_dir).select("vec_id", linear.dot(F.col("v"), F.col("v")).alias("f")), "f")


@add("w14_asum", f"WITH {_M} SELECT vec_id, floor(sum(abs(a)) * 1e4 + 0.5)::BIGINT AS f FROM m GROUP BY 1")
def _asum(spark, sf_dir):
    return _fixed(_vectors(spark, sf_dir).select("vec_id", linear.asum(F.col("v")).alias("f")), "f")


@add("w15_gemv", f"WITH {_M} SELECT vec_id, floor(sum(a * (k % 5 - 2)) * 1e4 + 0.5)::BIGINT AS f FROM m GROUP BY 1")
def _gemv(spark, sf_dir):
    vector = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (k % 5 - 2).cast("double"))
    return _fixed(_vectors(spark, sf_dir).select("vec_id", linear.dot(F.col("v"), vector).alias("f")), "f")


@add("w15_gemv_transposed", f"WITH {_M} SELECT k::BIGINT AS k, floor(sum(a * (vec_id % 7)) * 1e4 + 0.5)::BIGINT AS f FROM m GROUP BY 1")
def _gemv_t(spark, sf_dir):
    return _fixed(linear.gemv_transposed(_vectors(spark, sf_dir), "v", (F.col("vec_id") % 7).cast("double"), "k", "f"), "f")


@add("w15_gemv_scaled", f"WITH {_M} SELECT vec_id, floor((1.5::DOUBLE * sum(a * (k % 5 - 2)) + 0.5::DOUBLE * (vec_id % 11)) * 1e4 + 0.5)::BIGINT AS f FROM m GROUP BY 1")
def _gemv_scaled(spark, sf_dir):
    vector = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (k % 5 - 2).cast("double"))
    rows = _vectors(spark, sf_dir).withColumn("y", (F.col("vec_id") % 11).cast("double"))
    return _fixed(linear.gemv(rows, "v", vector, "f", 1.5, 0.5, F.col("y")).select("vec_id", "f"), "f")


@add("w17_gemm", f"WITH {_M} SELECT p.k::BIGINT AS i, q.k::BIGINT AS j, floor(sum(p.a * q.a) * 1e4 + 0.5)::BIGINT AS f FROM m p JOIN m q USING (vec_id) GROUP BY 1, 2")
def _gemm(spark, sf_dir):
    return _fixed(linear.gram(_vectors(spark, sf_dir), "v", "i", "j", "f"), "f")


def _right(k: object, j: object) -> object:
    return (k * 3 + j * 5) % 7 - 3


def _gemm_of(turned_left: bool, turned_right: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        # op(A) is vectors by 64 and op(B) 64 by 8, however they are held.
        left = _vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("c", "a")).select("vec_id", F.col("c").cast("bigint").alias("c"), "a")
        left = left.toDF(*(("k", "i") if turned_left else ("i", "k")), "a")
        cells = spark.range(512).select(F.expr("id div 8").alias("k"), (F.col("id") % 8).alias("j"))
        right = cells.select("k", "j", _right(F.col("k"), F.col("j")).cast("double").alias("a")).toDF(*(("j", "k") if turned_right else ("k", "j")), "a")
        added = _vectors(spark, sf_dir).select(F.col("vec_id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")).withColumn("j", F.col("j").cast("bigint")).withColumn("c", ((F.col("i") + F.col("j")) % 5).cast("double"))
        return _fixed(linear.gemm(left, right, "f", 1.5, 0.5, added, turned_left, turned_right), "f")

    return run


for _a in (False, True):
    for _b in (False, True):
        add(f"w17_gemm_{'t' if _a else 'n'}{'t' if _b else 'n'}", f"WITH {_M} SELECT vec_id AS i, j, floor((1.5::DOUBLE * sum(a * ((k * 3 + j * 5) % 7 - 3)) + 0.5::DOUBLE * ((vec_id + j) % 5)) * 1e4 + 0.5)::BIGINT AS f FROM m CROSS JOIN range(8) r(j) GROUP BY vec_id, j")(_gemm_of(_a, _b))


@add("w18_fft_c2c", f"WITH {_M}, z AS (SELECT vec_id, k, a AS re, (k % 3 - 1) * a AS im FROM m) SELECT vec_id, w::BIGINT AS w, floor(sum(re * cos(2 * pi() * w * k / 64) + im * sin(2 * pi() * w * k / 64)) * 1e4 + 0.5)::BIGINT AS re, floor(sum(im * cos(2 * pi() * w * k / 64) - re * sin(2 * pi() * w * k / 64)) * 1e4 + 0.5)::BIGINT AS im FROM z CROSS JOIN range(64) q(w) GROUP BY 1, 2")
def _c2c(spark, sf_dir):
    return _fixed(linear.spectrum(_complex(spark, sf_dir), "vec_id", "re", "im", 64), "re", "im")


@add("w18_fft_inverse", f"WITH {_M} SELECT vec_id, k::BIGINT AS w, floor(a * 1e4 + 0.5)::BIGINT AS re, floor((k % 3 - 1) * a * 1e4 + 0.5)::BIGINT AS im FROM m")
def _c2c_back(spark, sf_dir):
    there = linear.spectrum(_complex(spark, sf_dir), "vec_id", "re", "im", 64)
    back = linear.spectrum(linear.gathered(there, "vec_id", "w", "re", "im"), "vec_id", "re", "im", 64, inverse=True)
    # The values are the table's again, in the precision that it holds them.
    held = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema["embedding"].dataType.elementType
    return _fixed(back.withColumns({n: F.col(n).cast(held).cast("double") for n in ("re", "im")}), "re", "im")


def _complex(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.col("v").alias("re"), F.transform("v", lambda a, k: a * (k % 3 - 1)).alias("im"))


@add("w18_dft", f"WITH {_M} SELECT vec_id, w::BIGINT AS w, floor(sum(a * cos(2 * pi() * w * k / 64)) * 1e4 + 0.5)::BIGINT AS re, floor(-sum(a * sin(2 * pi() * w * k / 64)) * 1e4 + 0.5)::BIGINT AS im FROM m CROSS JOIN range(64) z(w) GROUP BY 1, 2")
def _dft(spark, sf_dir):
    return _fixed(linear.dft(_vectors(spark, sf_dir), "vec_id", "v", 64), "re", "im")
