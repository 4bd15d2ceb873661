"""Image programs over the grid: pyramids, resizing, bilateral grids, demosaicing, wavelets, simulations, filters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions import expr as E
from gridloom.functions.expr import cast, const, select
from gridloom.operators import boundary, linear
from gridloom.plans.func import Func, Input, RDom, Var, sum_
from gridloom.programs.arrays import _AT, _CLAMP, _EDGE, _G, H, W, _fixed, add, f64, grid, i32, u8, x, y


def real(g: Input) -> Func:
    f = Func("real")
    f[x, y] = cast(f64, g[x, y])
    return f


def downsampled(f: Func, name: str) -> Func:
    """(1 3 3 1) / 8 along x, at every other site."""
    out = Func(name)
    out[x, y] = (f[2 * x - 1, y] + 3.0 * f[2 * x, y] + 3.0 * f[2 * x + 1, y] + f[2 * x + 2, y]) / 8.0
    return out.compute_root()


def upsampled(f: Func, name: str) -> Func:
    """A quarter of the further and three quarters of the nearer site."""
    out = Func(name)
    out[x, y] = 0.25 * f[x / 2 - 1 + 2 * (x % 2), y] + 0.75 * f[x / 2, y]
    return out.compute_root()


_DOWN = "(SELECT a.x, a.y, (sum(b.v * CASE WHEN k IN (0, 3) THEN 1 ELSE 3 END) / 8)::DOUBLE AS v FROM (SELECT x, y FROM range(-2, 34) p(x) CROSS JOIN range(7) q(y)) a CROSS JOIN range(4) r(k) JOIN d b ON b.x = greatest(least(2 * a.x - 1 + k, 63), 0) AND b.y = a.y GROUP BY 1, 2)"


@add("w03_laplacian_level", f"WITH {_G}, s AS {_DOWN} SELECT a.x, a.y, floor((a.v - 0.25 * n.v - 0.75 * m.v) * 1e4 + 0.5)::BIGINT AS f FROM d a JOIN s n ON n.x = a.x // 2 - 1 + 2 * (a.x % 2) AND n.y = a.y JOIN s m ON m.x = a.x // 2 AND m.y = a.y")
def _laplacian(spark, sf_dir):
    f, g = Func("f"), real(boundary.repeat_edge(grid(spark, sf_dir)))
    f[x, y] = g[x, y] - upsampled(downsampled(g, "down"), "up")[x, y]
    return _fixed(f.realize(spark, W, H), "f")


@add("w04_interpolate", f"WITH {_G}, p AS (SELECT x, y, CASE WHEN v % 2 = 0 THEN v ELSE 0 END::DOUBLE AS v, (v % 2 = 0)::INT::DOUBLE AS w FROM d), s AS (SELECT x // 2 AS x, y, sum(v) / 2 AS v, sum(w) / 2 AS w FROM p GROUP BY 1, 2) SELECT p.x, p.y, floor(CASE WHEN p.w + (1 - p.w) * s.w = 0 THEN 0 ELSE (p.v + (1 - p.w) * s.v) / (p.w + (1 - p.w) * s.w) END * 1e4 + 0.5)::BIGINT AS f FROM p JOIN s ON s.x = p.x // 2 AND s.y = p.y")
def _interpolate(spark, sf_dir):
    g, f, fine, coarse = grid(spark, sf_dir), Func("f"), Func("fine"), Func("coarse")
    known = select(g[x, y] % 2 == 0, const(1.0, f64), const(0.0, f64))
    fine[x, y] = (cast(f64, g[x, y]) * known, known)
    fine.compute_root()
    (a, wa), (b, wb) = fine[2 * x, y], fine[2 * x + 1, y]
    coarse[x, y] = ((a + b) / 2.0, (wa + wb) / 2.0)
    coarse.compute_root()
    (v, w), (cv, cw) = fine[x, y], coarse[x / 2, y]
    weight = w + (1.0 - w) * cw
    f[x, y] = select(weight == 0.0, const(0.0, f64), (v + (1.0 - w) * cv) / weight)
    return _fixed(f.realize(spark, W, H), "f")


def kernel(name: str, t: E.Expr) -> tuple[E.Expr, float]:
    """The weight at a distance, and half the width."""
    t = E.absolute(t)
    one, zero = const(1.0, f64), const(0.0, f64)
    if name == "box":
        return select(t <= 0.5, one, zero), 0.5
    if name == "linear":
        return select(t < 1.0, 1.0 - t, zero), 1.0
    if name == "cubic":
        a = -0.5
        return select(t < 1.0, (a + 2) * t * t * t - (a + 3) * t * t + 1.0, t < 2.0, a * t * t * t - 5 * a * t * t + 8 * a * t - 4 * a, zero), 2.0
    sinc = lambda v: select(v == 0.0, one, E.sin(v * math.pi) / (v * math.pi))
    return select(t < 3.0, sinc(t) * sinc(t / 3.0), zero), 3.0


_KERNELS = {
    "box": ("CASE WHEN abs(t) <= 0.5 THEN 1 ELSE 0 END", 0.5),
    "linear": ("greatest(1 - abs(t), 0)", 1.0),
    "cubic": ("CASE WHEN abs(t) < 1 THEN 1.5 * abs(t) ** 3 - 2.5 * t * t + 1 WHEN abs(t) < 2 THEN -0.5 * abs(t) ** 3 + 2.5 * t * t - 4 * abs(t) + 2 ELSE 0 END", 2.0),
    "lanczos": ("CASE WHEN t = 0 THEN 1 WHEN abs(t) < 3 THEN sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) ELSE 0 END", 3.0),
}
SCALE = 2.0


def _resize(name: str) -> None:
    sql, half = _KERNELS[name]
    taps = int(2 * half + 1)

    @add(f"w05_resize_{name}", f"WITH {_G}, o AS (SELECT x, y, ((x + 0.5) / {SCALE})::DOUBLE AS c FROM range({2 * W}) a(x) CROSS JOIN range({H}) b(y)), k AS (SELECT x, y, c, (floor(c - {half} + 0.5) + k)::BIGINT AS s FROM o CROSS JOIN range({taps}) r(k)), w AS (SELECT x, y, s, c - s - 0.5 AS t FROM k), z AS (SELECT x, y, s, ({sql})::DOUBLE AS n FROM w) SELECT z.x, z.y, floor(sum(n * v) / sum(n) * 1e3 + 0.5)::BIGINT AS f FROM z JOIN d ON d.x = greatest(least(s, {W - 1}), 0) AND d.y = z.y GROUP BY 1, 2")
    def run(spark, sf_dir):
        g, f, r, weights = grid(spark, sf_dir), Func("f"), RDom((0, taps)), Func("weights")
        center = (cast(f64, x) + 0.5) / SCALE
        begin = cast(i32, E.floor(center - half + 0.5))
        s = begin + r.x
        w = kernel(name, center - cast(f64, s) - 0.5)[0]
        value = cast(f64, g[E.clamp(s, 0, W - 1), y])
        f[x, y] = sum_(w * value) / sum_(w)
        out = f.realize(spark, 2 * W, H)
        return out.withColumn("f", F.floor(F.col("f") * 1e3 + 0.5).cast("bigint"))


for _name in _KERNELS:
    _resize(_name)


CELL, LEVELS = 8, 10
_FIVE = "(VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1))"
_CELLS = f"""l AS (SELECT x, y, (v % 1024) / 1024::DOUBLE AS v FROM d),
h AS (SELECT bx, b, trunc(l.v * {LEVELS} + 0.5)::BIGINT AS z, sum(l.v) AS s, count(*) AS n FROM range(-2, 12) p(bx) CROSS JOIN range(-2, 5) q(b) CROSS JOIN range({CELL}) i(dx) CROSS JOIN range({CELL}) j(dy) JOIN l ON l.x = greatest(least(bx * {CELL} + dx - {CELL // 2}, {W - 1}), 0) AND l.y = greatest(least(b * {CELL} + dy - {CELL // 2}, {H - 1}), 0) GROUP BY 1, 2, 3),
k AS (SELECT bx + t.o AS bx, b + u.o AS b, z + m.o AS z, sum(s * t.w * u.w * m.w) AS s, sum(n * t.w * u.w * m.w)::DOUBLE AS n FROM h CROSS JOIN {_FIVE} t(o, w) CROSS JOIN {_FIVE} u(o, w) CROSS JOIN {_FIVE} m(o, w) GROUP BY 1, 2, 3),
c AS (SELECT x, y, l.v * {LEVELS} - trunc(l.v * {LEVELS}) AS zf, (x % {CELL}) / {CELL}::DOUBLE AS xf, (y % {CELL}) / {CELL}::DOUBLE AS yf, trunc(l.v * {LEVELS})::BIGINT AS z FROM l),
o AS (SELECT x, y, x // {CELL} + i AS bx, y // {CELL} + j AS b, z + e AS z, (CASE i WHEN 0 THEN 1 - xf ELSE xf END) * (CASE j WHEN 0 THEN 1 - yf ELSE yf END) * (CASE e WHEN 0 THEN 1 - zf ELSE zf END) AS w FROM c CROSS JOIN range(2) p(i) CROSS JOIN range(2) q(j) CROSS JOIN range(2) r(e))"""


@add("w02_bilateral_grid", f"WITH {_G}, {_CELLS} SELECT o.x, o.y, floor(sum(w * s) / sum(w * n) * 1e4 + 0.5)::BIGINT AS f FROM o JOIN k USING (bx, b, z) GROUP BY 1, 2")
def _bilateral(spark, sf_dir):
    """Sums and counts of cells of place and brightness, five taps along each axis, read between the cells' centres."""
    b, cells, number, f = boundary.repeat_edge(grid(spark, sf_dir)), Func("cells"), Func("number"), Func("f")
    bx, by, z, r = Var("bx"), Var("b"), Var("z"), RDom((0, CELL), (0, CELL))
    bright = lambda i, j: cast(f64, b[i, j] % 1024) / 1024.0
    value = bright(bx * CELL + r.x - CELL // 2, by * CELL + r.y - CELL // 2)
    level = E.clamp(cast(i32, value * float(LEVELS) + 0.5), 0, LEVELS)
    cells[bx, by, z] = const(0.0, f64)
    cells[bx, by, level] += value
    number[bx, by, z] = const(0.0, f64)
    number[bx, by, level] += const(1.0, f64)

    def blurred(name, at):
        """``at(k)`` gives the values ``k`` sites on."""
        out, taps = Func(name), [at(k) for k in range(-2, 3)]
        out[bx, by, z] = tuple(t[0] + 4.0 * t[1] + 6.0 * t[2] + 4.0 * t[3] + t[4] for t in zip(*taps, strict=True))
        return out.compute_root()

    deep = blurred("deep", lambda k: (cells[bx, by, z + k], number[bx, by, z + k]))
    wide = blurred("wide", lambda k: deep[bx + k, by, z])
    high = blurred("high", lambda k: wide[bx, by + k, z])
    place = bright(x, y) * float(LEVELS)
    zi = E.clamp(cast(i32, place), 0, LEVELS)
    xf, yf, zf = cast(f64, x % CELL) / float(CELL), cast(f64, y % CELL) / float(CELL), place - cast(f64, zi)
    flat = lambda part, k: E.lerp(*[E.lerp(high[x / CELL, y / CELL + j, zi + k][part], high[x / CELL + 1, y / CELL + j, zi + k][part], xf) for j in (0, 1)], yf)
    total, count = (E.lerp(flat(part, 0), flat(part, 1), zf) for part in (0, 1))
    f[x, y] = total / count
    return _fixed(f.realize(spark, W, H), "f")


# The four taps of the Daubechies wavelet.
DAUBECHIES = ((1 + math.sqrt(3)) / (4 * math.sqrt(2)), (3 + math.sqrt(3)) / (4 * math.sqrt(2)), (3 - math.sqrt(3)) / (4 * math.sqrt(2)), (1 - math.sqrt(3)) / (4 * math.sqrt(2)))
_D = DAUBECHIES


_LOW = f"CASE k WHEN 0 THEN {_D[0]!r} WHEN 1 THEN {_D[1]!r} WHEN 2 THEN {_D[2]!r} ELSE {_D[3]!r} END::DOUBLE"
_HIGH = f"CASE k WHEN 0 THEN {_D[3]!r} WHEN 1 THEN {-_D[2]!r} WHEN 2 THEN {_D[1]!r} ELSE {-_D[0]!r} END::DOUBLE"
_TAPS = f"t AS (SELECT a.x, a.y, sum(b.v * {_LOW}) AS lo, sum(b.v * {_HIGH}) AS hi FROM (SELECT x, y FROM range({W // 2}) p(x) CROSS JOIN range({H}) q(y)) a CROSS JOIN range(4) r(k) JOIN d b ON b.x = greatest(least(2 * a.x + k - 1, {W - 1}), 0) AND b.y = a.y GROUP BY 1, 2)"


def daubechies(spark, sf_dir) -> Func:
    b, f = boundary.repeat_edge(grid(spark, sf_dir)), Func("f")
    at = [cast(f64, b[2 * x + k, y]) for k in (-1, 0, 1, 2)]
    f[x, y] = (at[0] * _D[0] + at[1] * _D[1] + at[2] * _D[2] + at[3] * _D[3], at[0] * _D[3] - at[1] * _D[2] + at[2] * _D[1] - at[3] * _D[0])
    return f


@add("w11_daubechies", f"WITH {_G}, {_TAPS} SELECT x, y, floor(lo * 1e3 + 0.5)::BIGINT AS f_0, floor(hi * 1e3 + 0.5)::BIGINT AS f_1 FROM t")
def _daubechies(spark, sf_dir):
    out = daubechies(spark, sf_dir).realize(spark, W // 2, H)
    return out.withColumns({n: F.floor(F.col(n) * 1e3 + 0.5).cast("bigint") for n in ("f_0", "f_1")})


@add("w11_daubechies_inverse", f"WITH {_G}, {_TAPS} SELECT 2 * a.x + p AS x, a.y, floor(CASE p WHEN 0 THEN {_D[2]!r}::DOUBLE * a.lo + {_D[1]!r}::DOUBLE * a.hi + {_D[0]!r}::DOUBLE * b.lo + {_D[3]!r}::DOUBLE * b.hi ELSE {_D[3]!r}::DOUBLE * a.lo - {_D[0]!r}::DOUBLE * a.hi + {_D[1]!r}::DOUBLE * b.lo - {_D[2]!r}::DOUBLE * b.hi END * 1e3 + 0.25)::BIGINT AS f FROM t a JOIN t b ON b.y = a.y AND b.x = least(a.x + 1, {W // 2 - 1}) CROSS JOIN range(2) o(p)")
def _daubechies_back(spark, sf_dir):
    there, f = daubechies(spark, sf_dir).compute_root(), Func("f")
    a, z = there[x / 2, y], there[E.minimum_of(x / 2 + 1, W // 2 - 1), y]
    even = a[0] * _D[2] + a[1] * _D[1] + z[0] * _D[0] + z[1] * _D[3]
    f[x, y] = select(x % 2 == 0, even, a[0] * _D[3] - a[1] * _D[0] + z[0] * _D[1] - z[1] * _D[2])
    # Whole numbers come back but for rounding, so the digits are cut a quarter above the last one.
    return f.realize(spark, W, H).withColumn("f", F.floor(F.col("f") * 1e3 + 0.25).cast("bigint"))


@add("w16_ger", "SELECT s_suppkey, p.p_size AS p_size, s_nationkey * p.p_size AS f FROM supplier CROSS JOIN (SELECT DISTINCT p_size FROM part) p")
def _ger(spark, sf_dir):
    left = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    right = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size").distinct()
    return linear.ger(left, right, "s_nationkey", "p_size", "f").select("s_suppkey", "p_size", "f")


@add("w24_reaction_diffusion", f"WITH {_G}, b AS (SELECT a.x, a.y, any_value(a.v)::DOUBLE / 4096 AS u, sum(b.v * CASE WHEN dx = 0 AND dy = 0 THEN -4 ELSE 1 END)::DOUBLE / 4096 AS l {_AT.format(**{'x': '(a.x + dx + 64) % 64', 'y': '(a.y + dy + 7) % 7'})} WHERE abs(dx) + abs(dy) <= 1 GROUP BY 1, 2) SELECT x, y, floor((u + 0.1 * l - u * u * 0.05 + 0.01) * 1e4 + 0.5)::BIGINT AS f FROM b")
def _reaction(spark, sf_dir):
    b, f = boundary.repeat_image(grid(spark, sf_dir)), Func("f")
    at = lambda i, j: cast(f64, b[x + i, y + j]) / 4096.0
    spread = at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1) - 4.0 * at(0, 0)
    f[x, y] = at(0, 0) + 0.1 * spread - at(0, 0) * at(0, 0) * 0.05 + 0.01
    return _fixed(f.realize(spark, W, H), "f")


@add("w27_iir_blur", f"WITH RECURSIVE {_G}, p AS (SELECT x, 0 AS y, v::DOUBLE AS f FROM d WHERE y = 0 UNION ALL SELECT p.x, p.y + 1, 0.75 * f + 0.25 * d.v FROM p JOIN d ON d.x = p.x AND d.y = p.y + 1), q AS (SELECT x, {H - 1} AS y, f FROM p WHERE y = {H - 1} UNION ALL SELECT q.x, q.y - 1, 0.75 * q.f + 0.25 * p.f FROM q JOIN p ON p.x = q.x AND p.y = q.y - 1) SELECT x, y, floor(f * 1e4 + 0.5)::BIGINT AS f FROM q")
def _iir(spark, sf_dir):
    g, f, r = grid(spark, sf_dir), Func("f"), RDom((1, H - 1))
    f[x, y] = cast(f64, g[x, y])
    f[x, r.x] = cast(f64, 0.75) * f[x, r.x - 1] + cast(f64, 0.25) * f[x, r.x]
    back = H - 1 - r.x
    f[x, back] = cast(f64, 0.75) * f[x, back + 1] + cast(f64, 0.25) * f[x, back]
    return _fixed(f.realize(spark, W, H), "f")


@add("w28_vignette", f"WITH {_G} SELECT a.x, a.y, floor(a.v * (1 - ((b.x - 32) * (b.x - 32) + (b.y - 3) * (b.y - 3)) / 2048.0)::DOUBLE * 1e4 + 0.5)::BIGINT AS f FROM d b JOIN d a ON a.x = b.x AND a.y = b.y")
def _vignette(spark, sf_dir):
    g, f = grid(spark, sf_dir), Func("f")
    dx, dy = x - 32, y - 3
    f[x, y] = E.extern(lambda v, s: v * (1 - s / 2048.0), f64, cast(f64, g[x, y]), cast(f64, dx * dx + dy * dy))
    return _fixed(f.realize(spark, W, H), "f")


@add("w30_some_tiles", f"WITH {_G}, t AS (SELECT x // 8 AS tx, max(v) % 2 = 0 AS hot FROM d GROUP BY 1) SELECT x, y, CASE WHEN hot THEN 2 * v ELSE v END AS f FROM d JOIN t ON tx = x // 8")
def _tiles(spark, sf_dir):
    from gridloom.plans.func import maximum

    g, hot, f, r = grid(spark, sf_dir), Func("hot"), Func("f"), RDom((0, 8), (0, H))
    hot[x] = cast(i32, maximum(g[x * 8 + r.x, r.y]) % 2 == 0)
    hot.compute_root()
    f[x, y] = select(hot[x / 8] == 1, 2 * g[x, y], g[x, y])
    return f.realize(spark, W, H)


@add("w33_deinterleave", f"WITH {_G} SELECT x // 2 AS x, y, x % 2 AS c, v AS f FROM d")
def _deinterleave(spark, sf_dir):
    g, f, c = grid(spark, sf_dir), Func("f"), Var("c")
    f[x, y, c] = g[2 * x + c, y]
    return f.realize(spark, W // 2, H, 2)


@add("w34_tiled_blur", f"WITH {_G}, c AS (SELECT a.x, a.y, sum(b.v)::BIGINT // 3 AS v FROM d a CROSS JOIN range(-1, 2) i(dx) JOIN d b ON b.x = {_CLAMP['x']} AND b.y = a.y GROUP BY 1, 2), e AS (SELECT a.x, a.y, sum(b.v)::BIGINT // 3 AS v FROM c a CROSS JOIN range(-1, 2) j(dy) JOIN c b ON b.x = a.x AND b.y = {_CLAMP['y']} GROUP BY 1, 2) SELECT x, y, v * 2 + 1 AS f FROM e")
def _tiled_blur(spark, sf_dir):
    from gridloom.programs.arrays import blur

    f, inner = Func("f"), blur(grid(spark, sf_dir))
    f[x, y] = inner[x, y] * 2 + 1
    return f.realize(spark, W, H)


@add("u1_extern_function", "SELECT o_orderkey, (o_custkey % 97) * 3 + 1 AS f FROM orders")
def _extern(spark, sf_dir):
    from gridloom.operators.extern import vectorized

    triple = vectorized(lambda v: v * 3 + 1, i32)
    e = triple(E.Expr("var", (), i32, "k"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.pmod("o_custkey", F.lit(97)).alias("k"))
    return rows.select("o_orderkey", E.compile(e, lambda n: F.col(n.data) if n.op == "var" else None).alias("f"))


@add("u2_extern_stage", f"WITH {_G} SELECT y, string_agg(v::VARCHAR, ',' ORDER BY v DESC) AS f FROM d WHERE y > 1 GROUP BY y")
def _stage(spark, sf_dir):
    """A whole-array function of a user: it gets one line of the grid at a time, over the box that it asked for."""
    import pandas as pd

    g, f = grid(spark, sf_dir), Func("f")
    f[x, y] = g[x, y]

    def sort(line: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"y": [line["y"].iloc[0]], "f": [",".join(map(str, sorted(line["f"], reverse=True)))]})

    return f.realize(spark, W, (2, H - 2)).groupBy("y").applyInPandas(sort, "y bigint, f string")


@add("io1_image_round_trip", f"WITH {_G} SELECT x, y, 0::BIGINT AS c, v % 256 AS v FROM d")
def _images(spark, sf_dir):
    """The grid written as a PNG in memory and read back."""
    from pyspark.sql.types import StructType

    from gridloom.sources import images

    g, f = grid(spark, sf_dir, u8), Func("v")
    f[x, y] = g[x, y]
    sites = f.realize(spark, W, H).select(F.lit("grid").alias("path"), "x", "y", F.lit(0).cast("bigint").alias("c"), "v")

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for raw in batch["content"]:
                image = images.decode(bytes(raw))
                at = np.indices(image.shape)
                yield pd.DataFrame({"x": at[1].ravel(), "y": at[0].ravel(), "c": at[2].ravel(), "v": image.astype(np.int64).ravel()})

    return images.encoded(sites).mapInPandas(run, StructType.fromDDL("x bigint, y bigint, c bigint, v bigint"))


@add("t1_hourly", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, sum((value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2")
def _hourly(spark, sf_dir):
    from gridloom.streaming.frames import hourly

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return hourly(events).withColumn("hour", F.col("hour").cast("timestamp_ntz"))
