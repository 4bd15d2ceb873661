"""Queries for the short forms."""

from __future__ import annotations

from gridloom.functions import expr as E
from gridloom.functions.expr import cast, const, select
from gridloom.operators import linear
from gridloom.plans.func import Func, RDom, sum_
from gridloom.plans.short import c_add, c_conj, c_expj, c_mul, c_scale, c_select, lam, param, rest
from gridloom.programs.arrays import _G, _M, H, W, _fixed, _vectors, add, f64, grid, i32, x, y


@add("p05_lambda", f"WITH {_G} SELECT x, y, v * 3 + 1 AS f FROM d")
def _lambda(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    f[x, y] = lam(x, y, g[x, y] * 3)[x, y] + 1
    return f.realize(spark, W, H)


@add("p06_implicit", f"WITH {_G} SELECT x AS _0, y AS _1, v * 2 AS f FROM d")
def _implicit(spark, sf_dir):
    return rest(grid(spark, sf_dir), lambda v: v * 2).realize(spark, W, H)


@add("p06_partial", f"WITH {_G} SELECT x, y AS _0, v - 1 AS f FROM d")
def _partial(spark, sf_dir):
    return rest(grid(spark, sf_dir), lambda v: v - 1, x).realize(spark, W, H)


@add("p11_tuple_select", f"WITH {_G} SELECT x, y, CASE WHEN v % 2 = 0 THEN v ELSE -1 END AS f_0, CASE WHEN v % 2 = 0 THEN x ELSE y END AS f_1 FROM d")
def _tuples(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    f[x, y] = E.tuple_select(g[x, y] % 2 == 0, (g[x, y], x), (const(-1), y))
    return f.realize(spark, W, H)


@add("p14_undef", f"WITH {_G} SELECT x, count(*) FILTER (v % 2 = 0) AS f FROM d GROUP BY x")
def _undef(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    r = RDom(g)
    f[x] = const(0)
    f[r.x] += select(g[r.x, r.y] % 2 == 0, const(1), E.undef(i32))
    return f.realize(spark, W)


@add("p17_param", f"WITH {_G} SELECT x, y, v * 7 AS f FROM d")
def _param(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    f[x, y] = g[x, y] * param(i32, 7, 0, 10)
    return f.realize(spark, W, H)


@add("p19_box_as_values", f"WITH {_G} SELECT x, y, v * {W} - 0 + {H} AS f FROM d")
def _box(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    f[x, y] = g[x, y] * g.width(0) - g.minimum(1) + g.width(1)
    return f.realize(spark, W, H)


@add("p20_scalar", f"WITH {_G} SELECT x, y, v + 42 AS f FROM d")
def _scalar(spark, sf_dir):
    g, s, f = grid(spark, sf_dir), Func("s"), Func("f")
    s[()] = const(42)
    s.compute_root()
    f[x, y] = g[x, y] + s[()]
    return f.realize(spark, W, H)


@add("w12_scal", f"WITH {_M} SELECT vec_id, k::BIGINT AS k, floor(a * -1.5 * 1e4 + 0.5)::BIGINT AS f FROM m")
def _scal(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode(linear.scal(F.col("v"), -1.5)).alias("k", "f"))
    return _fixed(rows.withColumn("k", F.col("k").cast("bigint")), "f")


@add("w18b_complex", f"WITH {_G}, z AS (SELECT x, y, v / 1024.0::DOUBLE AS a, y::DOUBLE / 4 AS b FROM d), p AS (SELECT x, y, a * cos(b) AS pr, a * sin(b) AS pi, a, b FROM z) SELECT x, y, floor(CASE WHEN x % 2 = 0 THEN (pr * pr + pi * pi) * 0.5 + a ELSE a END * 1e4 + 0.5)::BIGINT AS f_0, floor(CASE WHEN x % 2 = 0 THEN b ELSE -b END * 1e4 + 0.5)::BIGINT AS f_1 FROM p")
def _complex(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    a, b = cast(f64, g[x, y]) / 1024.0, cast(f64, y) / 4.0
    turned = c_mul((a, const(0.0, f64)), c_expj(b))
    f[x, y] = c_select(x % 2 == 0, c_add(c_scale(c_mul(turned, c_conj(turned)), 0.5), (a, b)), c_conj((a, b)))
    return _fixed(f.realize(spark, W, H), "f_0", "f_1")


@add("w18c_dft_of_lines", f"WITH {_G} SELECT w.w AS x, d.y, floor(sum(v * cos(2 * pi() * ((w.w * d.x) % {W}) / {W})) * 1e2 + 0.5)::BIGINT AS f_0, floor(sum(v * sin(2 * pi() * ((w.w * d.x) % {W}) / {W})) * 1e2 + 0.5)::BIGINT AS f_1 FROM d CROSS JOIN range({W}) w(w) GROUP BY 1, 2")
def _dft(spark, sf_dir):
    import math

    from pyspark.sql import functions as F

    g, f, r = grid(spark, sf_dir), Func("f"), RDom((0, W))
    angle = cast(f64, x * r.x % W) * (2 * math.pi / W)
    v = cast(f64, g[r.x, y])
    f[x, y] = (sum_(v * E.cos(angle)), sum_(v * E.sin(angle)))
    return f.realize(spark, W, H).withColumns({n: F.floor(F.col(n) * 1e2 + 0.5).cast("bigint") for n in ("f_0", "f_1")})
