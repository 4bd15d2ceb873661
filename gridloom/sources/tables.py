"""Tables, numpy arrays and constants as inputs; functions as tables, arrays and debug taps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.types import Float, Int, Type, UInt
from gridloom.plans.func import Func, Input

_KINDS = {"int8": Int(8), "int16": Int(16), "int32": Int(32), "int64": Int(64), "uint8": UInt(8), "uint16": UInt(16), "uint32": UInt(32), "float32": Float(32), "float64": Float(64), "bool": UInt(1)}


def from_table(df: DataFrame, coords: tuple[str, ...], values: dict[str, Type], box: dict[str, tuple[int, int]] | None = None, **more: object) -> Input:
    """A table as an input. Without a box, one aggregation over the coordinates finds it."""
    if box is None:
        row = df.agg(*[f(c).alias(f"{n}_{c}") for c in coords for n, f in (("a", F.min), ("z", F.max))]).first()
        box = {c: (row[f"a_{c}"], row[f"z_{c}"] - row[f"a_{c}"] + 1) if row[f"a_{c}"] is not None else (0, 0) for c in coords}
    return Input(df, tuple(coords), values, box, **more)


def from_numpy(spark: SparkSession, array: np.ndarray, coords: tuple[str, ...], name: str = "array") -> Input:
    """An array of the driver as an input; the first coordinate is the last axis, which lies side by side."""
    places = np.indices(array.shape)[::-1]
    data = {c: p.ravel() for c, p in zip(coords, places, strict=True)}
    data["v"] = array.ravel().astype("int64" if array.dtype.kind in "iu" else array.dtype)
    df = spark.createDataFrame(pd.DataFrame(data))
    return Input(df, tuple(coords), {"v": _KINDS[array.dtype.name]}, {c: (0, n) for c, n in zip(coords, array.shape[::-1], strict=True)}, name=name)


def to_numpy(df: DataFrame, coords: tuple[str, ...], value: str) -> np.ndarray:
    """A realized box as an array on the driver: for boxes that fit there."""
    rows = df.select(*coords, value).toPandas()
    low = {c: rows[c].min() for c in coords}
    out = np.zeros([int(rows[c].max() - low[c] + 1) for c in reversed(coords)], rows[value].to_numpy().dtype)
    out[tuple((rows[c] - low[c]).to_numpy() for c in reversed(coords))] = rows[value]
    return out


def realize_into(func: Func, spark: SparkSession, path: str, *box: tuple[int, int] | int) -> DataFrame:
    """The box written as Parquet, clustered by its outermost coordinate, and read back."""
    got = func.realize(spark, *box)
    outer = func.vars[-1] if func.vars else None
    (got.repartitionByRange(outer).sortWithinPartitions(*reversed(func.vars)) if outer else got).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def update_box(spark: SparkSession, func: Func, path: str, *box: tuple[int, int] | int) -> DataFrame:
    """A table of sites at ``path`` with the box replaced by ``func``'s values: what it holds elsewhere stays. Returned, not written."""
    new, old = func.realize(spark, *box), spark.read.parquet(path)
    return old.join(new.select(*func.vars), list(func.vars), "left_anti").unionByName(new)


def tap(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` for later inspection and goes on from what was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def watched(df: DataFrame, name: str, condition: str = "true", value: str | None = None) -> DataFrame:
    """Counts (and sums) rows that meet a condition as they pass, without touching them; read by an Observation or a listener."""
    parts = [F.count_if(F.expr(condition)).alias("rows")]
    if value:
        parts.append(F.sum(F.when(F.expr(condition), F.col(value))).alias("total"))
    return df.observe(name, *parts)
