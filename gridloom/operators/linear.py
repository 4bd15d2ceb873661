"""Linear algebra over rows that hold vectors: what is contracted inside a row never leaves it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def asum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))


def scal(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * by)


def axpy(df: DataFrame, x: str, alpha: float, y: Column) -> DataFrame:
    return df.withColumn(x, F.zip_with(F.col(x), y, lambda a, b: a * alpha + b))


def gemv_transposed(df: DataFrame, row: str, weight: Column, index: str, name: str) -> DataFrame:
    """The weighted sum of all rows: each task adds up its own before the sums, as many as a row is long, are shuffled."""
    cells = df.select(weight.alias("_w"), F.posexplode(row).alias(index, "_a"))
    return cells.groupBy(F.col(index).cast("bigint").alias(index)).agg(F.sum(F.col("_w") * F.col("_a")).alias(name))


def gram(df: DataFrame, row: str, i: str, j: str, name: str) -> DataFrame:
    """Products of all pairs of columns: pairs are made inside each row and pre-aggregated, rows are never joined."""
    pairs = df.select(F.posexplode(row).alias(i, "_a"), F.col(row)).select(i, "_a", F.posexplode(row).alias(j, "_b"))
    return pairs.groupBy(F.col(i).cast("bigint").alias(i), F.col(j).cast("bigint").alias(j)).agg(F.sum(F.col("_a") * F.col("_b")).alias(name))


def ger(left: DataFrame, right: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """The outer product of two short vectors held as rows."""
    return left.crossJoin(right).withColumn(name, F.col(a) * F.col(b))


def gemv(df: DataFrame, row: str, vector: Column, name: str, alpha: float = 1.0, beta: float = 0.0, added: Column | None = None) -> DataFrame:
    """alpha A x + beta y with a row of A in each row of ``df``: nothing is shuffled."""
    out = dot(F.col(row), vector) * alpha
    return df.withColumn(name, out if added is None else out + added * beta)


def gemm(left: DataFrame, right: DataFrame, name: str, alpha: float = 1.0, beta: float = 0.0, added: DataFrame | None = None, turned_left: bool = False, turned_right: bool = False) -> DataFrame:
    """alpha op(A) op(B) + beta C from cells (i, k, a), (k, j, a) and (i, j, c), where op may turn a matrix over.

    Joined on the contracted axis, partial sums before the shuffle. ``turned_left`` says that A is held as (k, i), ``turned_right`` that B is held as (j, k).
    """
    a = left.select(F.col("k" if turned_left else "i").alias("i"), F.col("i" if turned_left else "k").alias("k"), "a")
    b = right.select(F.col("j" if turned_right else "k").alias("k"), F.col("k" if turned_right else "j").alias("j"), F.col("a").alias("b"))
    out = a.join(b, "k").groupBy("i", "j").agg((F.sum(F.col("a") * F.col("b")) * alpha).alias(name))
    if added is None:
        return out
    whole = added.join(out, ["i", "j"], "full").select("i", "j", (F.coalesce(name, F.lit(0.0)) + F.coalesce("c", F.lit(0.0)) * beta).alias(name))
    return whole


def _turns(n: int) -> tuple[Column, Column]:
    """Cosines and sines of the n-th parts of a turn, as constants."""
    exact = lambda f, k: round(f(2 * math.pi * k / n), 17)
    return tuple(F.array(*(F.lit(exact(f, k)) for k in range(n))) for f in (math.cos, math.sin))


def spectrum(df: DataFrame, key: str, re: str, im: str, n: int, inverse: bool = False) -> DataFrame:
    """The discrete Fourier transform, or its inverse, of rows of complex numbers, as ``key``, ``w``, ``re``, ``im``: inside each row."""
    cos, sin = _turns(n)
    sign, scale = (-1.0, 1.0 / n) if inverse else (1.0, 1.0)
    rows = df.select(key, F.arrays_zip(F.col(re).alias("a"), F.col(im).alias("b")).alias("_z"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("w"))
    turn = lambda table, k: F.get(table, F.pmod(F.col("w") * k, F.lit(n)))
    total = lambda f: F.aggregate(F.transform("_z", f), F.lit(0.0), lambda s, x: s + x) * scale
    real = total(lambda z, k: z["a"] * turn(cos, k) + z["b"] * turn(sin, k) * sign)
    imaginary = total(lambda z, k: z["b"] * turn(cos, k) - z["a"] * turn(sin, k) * sign)
    return rows.select(key, F.col("w").cast("bigint").alias("w"), real.alias("re"), imaginary.alias("im"))


def gathered(df: DataFrame, key: str, index: str, *columns: str) -> DataFrame:
    """Arrays of ``columns`` in the order of ``index``, a row for each ``key``; as long as one transform."""
    cells = F.array_sort(F.collect_list(F.struct(index, *columns)))
    return df.groupBy(key).agg(cells.alias("_c")).select(key, *[F.col("_c").getField(c).alias(c) for c in columns])


def dft(df: DataFrame, key: str, row: str, n: int) -> DataFrame:
    """The discrete Fourier transform of rows of real numbers."""
    return spectrum(df.select(key, row, F.transform(row, lambda a: a * 0.0).alias("_zero")), key, row, "_zero", n)
