"""Raw sensor data to colours, over the grid as a mosaic: green-red and red sites in even lines, blue and green-blue in odd ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.functions import expr as E
from gridloom.functions.expr import cast, select
from gridloom.operators import boundary
from gridloom.plans.func import Func, Var
from gridloom.programs.arrays import _G, H, W, add, c, f64, grid, i16, i32, u8, x, y

# Colour matrices measured at 3200 and 7000 kelvin, rows red, green, blue, the last column added.
MATRIX_3200 = ((1.6697, -0.2693, -0.4004, -42.4346), (-0.3576, 1.0615, 1.5949, -37.1158), (-0.2175, -1.8751, 6.9640, -26.6970))
MATRIX_7000 = ((2.2997, -0.4478, 0.1706, -39.0923), (-0.3826, 1.5906, -0.2080, -25.4311), (-0.0888, -0.7344, 2.2832, -20.0826))
KELVIN, GAMMA, CONTRAST = 3700.0, 2.0, 50.0


def mean(a: E.Expr, b: E.Expr) -> E.Expr:
    """Of two whole numbers, rounded up."""
    return (a + b + 1) / 2


def mosaic(raw: Func) -> Func:
    """The four sites of each 2 x 2 cell, without values that no neighbour of their colour reaches."""
    near = [raw[x - 2, y], raw[x + 2, y], raw[x, y - 2], raw[x, y + 2]]
    high = E.maximum_of(E.maximum_of(near[0], near[1]), E.maximum_of(near[2], near[3]))
    low = E.minimum_of(E.minimum_of(near[0], near[1]), E.minimum_of(near[2], near[3]))
    calm, cell = Func("calm"), Func("cell")
    calm[x, y] = E.clamp(raw[x, y], low, high)
    calm.compute_root()
    cell[x, y] = tuple(calm[2 * x + i, 2 * y + j] for j in (0, 1) for i in (0, 1))
    return cell.compute_root()


def _gentler(a: tuple[E.Expr, E.Expr], b: tuple[E.Expr, E.Expr]) -> E.Expr:
    """The mean of the pair ``a`` if it differs less than ``b``, else that of ``b``."""
    return select(E.absd(*a) < E.absd(*b), mean(*a), mean(*b))


def demosaic(cell: Func) -> Func:
    """Red, green and blue at every site: green along the gentler direction, the others by their difference to green."""
    gr, r, b, gb = (lambda i=0, j=0, k=k: cell[x + i, y + j][k] for k in range(4))
    greens = Func("greens")
    # Across, green-red sites lie beside red and green-blue ones beside blue; upright it is the other way round.
    greens[x, y] = (
        _gentler((gr(1), gr()), (gb(0, -1), gb())),
        _gentler((gb(-1), gb()), (gr(0, 1), gr())),
    )
    greens.compute_root()
    at_r, at_b = (lambda i=0, j=0, k=k: greens[x + i, y + j][k] for k in range(2))

    def told(green, theirs, colour, p, q):
        """The mean of ``colour`` at two places, and what green departs by from its own mean there."""
        return green - mean(theirs(*p), theirs(*q)) + mean(colour(*p), colour(*q))

    def diagonal(green, theirs, colour, rising, falling):
        steps = [E.absd(colour(*p), colour(*q)) for p, q in (rising, falling)]
        return select(steps[0] < steps[1], told(green, theirs, colour, *rising), told(green, theirs, colour, *falling))

    here, all_ = (0, 0), Func("all")
    all_[x, y] = (
        told(gr(), at_r, r, (-1, 0), here), r(), diagonal(at_b(), at_r, r, (here, (-1, 1)), ((-1, 0), (0, 1))), told(gb(), at_r, r, here, (0, 1)),
        gr(), at_r(), at_b(), gb(),
        told(gr(), at_b, b, here, (0, -1)), diagonal(at_r(), at_b, b, (here, (1, -1)), ((1, 0), (0, -1))), b(), told(gb(), at_b, b, here, (1, 0)),
    )
    all_.compute_root()
    return _sited(all_)


def _sited(cells: Func) -> Func:
    """From 12 values a cell (red, green, blue; four sites each) to three a site."""
    out, got = Func("rgb"), cells[x / 2, y / 2]
    of = [got[4 * k : 4 * k + 4] for k in range(3)]
    across, down = x % 2 == 0, y % 2 == 0
    out[x, y] = tuple(select(down, select(across, v[0], v[1]), select(across, v[2], v[3])) for v in of)
    return out.compute_root()


def matrix(kelvin: float) -> list[list[int]]:
    """Between the two measured ones by the inverse temperature, in 256ths."""
    at = (1 / kelvin - 1 / 3200) / (1 / 7000 - 1 / 3200)
    return [[int((p * at + q * (1 - at)) * 256) for p, q in zip(*rows, strict=True)] for rows in zip(MATRIX_3200, MATRIX_7000, strict=True)]


def corrected(rgb: tuple[E.Expr, ...], kelvin: float = KELVIN) -> tuple[E.Expr, ...]:
    return tuple(cast(i16, (m[3] + m[0] * rgb[0] + m[1] * rgb[1] + m[2] * rgb[2]) / 256) for m in matrix(kelvin))


def curve(gamma: float = GAMMA, contrast: float = CONTRAST) -> Func:
    """A table of 8-bit values for 0 to 1024: gamma, then a parabola on either side of the middle."""
    i, out = Var("i"), Func("curve")
    g = E.power(E.clamp(cast(f64, i) / 1024.0, 0.0, 1.0), 1.0 / gamma)
    b = 2.0 - 2.0 ** (contrast / 100.0)
    a = 2.0 - 2.0 * b
    z = select(g > 0.5, 1.0 - (a * (1.0 - g) * (1.0 - g) + b * (1.0 - g)), a * g * g + b * g)
    out[i] = cast(u8, E.clamp(z * 256.0, 0.0, 255.0))
    return out.compute_root()


def _sql_matrix(r: str, g: str, b: str) -> list[str]:
    """The corrected channels in SQL, from the measured matrices."""
    at = f"((1 / {KELVIN}::DOUBLE - 1 / 3200::DOUBLE) / (1 / 7000::DOUBLE - 1 / 3200::DOUBLE))"
    entry = lambda p, q: f"trunc(({p}::DOUBLE * {at} + {q}::DOUBLE * (1 - {at})) * 256)"
    rows = [[entry(p, q) for p, q in zip(*m, strict=True)] for m in zip(MATRIX_3200, MATRIX_7000, strict=True)]
    whole = [f"floor(({m[3]} + {m[0]} * {r} + {m[1]} * {g} + {m[2]} * {b}) / 256)::BIGINT" for m in rows]
    return [f"((({e}) + 32768) & 65535) - 32768" for e in whole]


def _sql_curve(v: str) -> str:
    g = f"pow(greatest(least(({v}) / 1024.0::DOUBLE, 1), 0), 1 / {GAMMA}::DOUBLE)"
    b = f"(2 - pow(2::DOUBLE, {CONTRAST}::DOUBLE / 100))"
    a = f"(2 - 2 * {b})"
    z = f"CASE WHEN {g} > 0.5 THEN 1 - ({a} * (1 - {g}) * (1 - {g}) + {b} * (1 - {g})) ELSE {a} * {g} * {g} + {b} * {g} END"
    return f"trunc(greatest(least(({z}) * 256, 255), 0))::BIGINT"


def _join(table: str, *offsets: tuple[str, int, int]) -> str:
    return " ".join(f"JOIN {table} {n} ON {n}.x = o.x + {i} AND {n}.y = o.y + {j}" for n, i, j in offsets)


_W2, _H2 = W // 2 + 3, H // 2 + 4
_MOSAIC = f"""{_G}, s AS (SELECT p.x, q.y, d.v FROM range(-8, {W + 12}) p(x) CROSS JOIN range(-8, {H + 12}) q(y) JOIN d ON d.x = greatest(least(p.x, {W - 1}), 0) AND d.y = greatest(least(q.y, {H - 1}), 0)),
h AS (SELECT o.x, o.y, greatest(least(o.v, greatest(w.v, e.v, n.v, z.v)), least(w.v, e.v, n.v, z.v)) AS v FROM s o {_join('s', ('w', -2, 0), ('e', 2, 0), ('n', 0, -2), ('z', 0, 2))}),
k AS (SELECT o.x, o.y, a.v AS gr, b.v AS r, c.v AS b, e.v AS gb FROM (SELECT x, y FROM range(-2, {_W2}) p(x) CROSS JOIN range(-2, {_H2}) q(y)) o JOIN h a ON a.x = 2 * o.x AND a.y = 2 * o.y JOIN h b ON b.x = 2 * o.x + 1 AND b.y = 2 * o.y JOIN h c ON c.x = 2 * o.x AND c.y = 2 * o.y + 1 JOIN h e ON e.x = 2 * o.x + 1 AND e.y = 2 * o.y + 1)"""
_M = lambda p, q: f"(({p} + {q} + 1) // 2)"
_T = lambda g, f, v, p, q: f"{g} - {_M(f'{p}.{f}', f'{q}.{f}')} + {_M(f'{p}.{v}', f'{q}.{v}')}"
_DIAGONAL = lambda g, f, v, p, q, s, t: f"CASE WHEN abs({p}.{v} - {q}.{v}) < abs({s}.{v} - {t}.{v}) THEN {_T(g, f, v, p, q)} ELSE {_T(g, f, v, s, t)} END"
_RGB = f"""{_MOSAIC}, m AS (SELECT o.x, o.y, o.gr, o.r, o.b, o.gb,
CASE WHEN abs(e.gr - o.gr) < abs(n.gb - o.gb) THEN {_M('e.gr', 'o.gr')} ELSE {_M('n.gb', 'o.gb')} END AS g_r,
CASE WHEN abs(w.gb - o.gb) < abs(z.gr - o.gr) THEN {_M('w.gb', 'o.gb')} ELSE {_M('z.gr', 'o.gr')} END AS g_b
FROM k o {_join('k', ('w', -1, 0), ('e', 1, 0), ('n', 0, -1), ('z', 0, 1))}),
t AS (SELECT o.x, o.y, o.gr, o.r, o.b, o.gb, o.g_r, o.g_b, {_T('o.gr', 'g_r', 'r', 'o', 'w')} AS r_gr, {_T('o.gr', 'g_b', 'b', 'o', 'n')} AS b_gr, {_T('o.gb', 'g_r', 'r', 'o', 'z')} AS r_gb, {_T('o.gb', 'g_b', 'b', 'o', 'e')} AS b_gb,
{_DIAGONAL('o.g_b', 'g_r', 'r', 'o', 'sw', 'w', 'z')} AS r_b, {_DIAGONAL('o.g_r', 'g_b', 'b', 'o', 'ne', 'e', 'n')} AS b_r
FROM m o {_join('m', ('w', -1, 0), ('e', 1, 0), ('n', 0, -1), ('z', 0, 1), ('sw', -1, 1), ('ne', 1, -1))}),
rgb AS (SELECT 2 * x + i AS x, 2 * y + j AS y, CASE 2 * j + i WHEN 0 THEN r_gr WHEN 1 THEN r WHEN 2 THEN r_b ELSE r_gb END AS r, CASE 2 * j + i WHEN 0 THEN gr WHEN 1 THEN g_r WHEN 2 THEN g_b ELSE gb END AS g, CASE 2 * j + i WHEN 0 THEN b_gr WHEN 1 THEN b_r WHEN 2 THEN b ELSE b_gb END AS b
FROM t CROSS JOIN range(2) p(i) CROSS JOIN range(2) q(j) WHERE 2 * x + i BETWEEN 0 AND {W - 1} AND 2 * y + j BETWEEN 0 AND {H - 1})"""


def colours(spark: SparkSession, sf_dir: str) -> Func:
    return demosaic(mosaic(boundary.repeat_edge(grid(spark, sf_dir))))


@add("w07_demosaic", f"WITH {_RGB} SELECT x, y, r AS f_0, g AS f_1, b AS f_2 FROM rgb")
def _demosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, rgb = Func("f"), colours(spark, sf_dir)
    f[x, y] = rgb[x, y]
    return f.realize(spark, W, H)


_CORRECTED = _sql_matrix("(v % 1024)", "(v // 2 % 1024)", "(v // 4 % 1024)")


@add("w08_color_correction", f"WITH {_G} SELECT x, y, {', '.join(f'{e} AS f_{k}' for k, e in enumerate(_CORRECTED))} FROM d")
def _correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, f = grid(spark, sf_dir), Func("f")
    v = g[x, y]
    f[x, y] = corrected((v % 1024, v / 2 % 1024, v / 4 % 1024))
    return f.realize(spark, W, H)


@add("w09_tone_curve", f"WITH {_G} SELECT x, y, {_sql_curve('v % 1025')} AS f FROM d")
def _curved(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, f, table = grid(spark, sf_dir), Func("f"), curve()
    f[x, y] = table[g[x, y] % 1025]
    return f.realize(spark, W, H)


@add("w06_w09_camera_raw", f"WITH {_RGB}, m3 AS (SELECT x, y, {', '.join(f'{e} AS v{k}' for k, e in enumerate(_sql_matrix('r', 'g', 'b')))} FROM rgb) SELECT x, y, c, {_sql_curve('CASE c WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END')} AS f FROM m3 CROSS JOIN range(3) r(c)")
def _camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row; the table's ends stand for what lies beyond them."""
    bright, f, rgb, table = Func("bright"), Func("f"), colours(spark, sf_dir), curve()
    bright[x, y] = corrected(rgb[x, y])
    bright.compute_root()
    got = bright[x, y]
    value = select(c == 0, got[0], c == 1, got[1], got[2])
    f[x, y, c] = table[E.clamp(cast(i32, value), 0, 1024)]
    return f.realize(spark, W, H, 3)
