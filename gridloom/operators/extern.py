"""Functions of the user: of columns, of vectors of values, of whole lines of a grid."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, LongType

from gridloom.functions.expr import Expr, GridError, extern
from gridloom.functions.types import Type


def vectorized(fn: Callable[..., pd.Series], kind: Type, *takes: Type) -> Callable[..., Expr]:
    """``fn`` over pandas Series, one to five of them, as a function of expressions. Values travel in Arrow batches."""
    spark_kind = DoubleType() if kind.is_float else BooleanType() if kind.is_bool else LongType()

    def one(a: pd.Series) -> pd.Series:
        return fn(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return fn(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return fn(a, b, c)

    def four(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return fn(a, b, c, d)

    def five(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
        return fn(a, b, c, d, e)

    # The names of the types are strings in this module, so they are given as they are.
    forms = [one, two, three, four, five]
    for form in forms:
        form.__annotations__ = dict.fromkeys(form.__annotations__, pd.Series)

    def call(*args: Expr) -> Expr:
        if not 1 <= len(args) <= 5 or (takes and tuple(a.kind for a in args) != takes):
            raise GridError(f"an external function of {list(map(str, takes)) or '1 to 5 values'} can't take {[str(a.kind) for a in args]}")
        return extern(lambda *columns: pandas_udf(forms[len(columns) - 1], spark_kind)(*columns), kind, *args)

    return call


def stage(df: DataFrame, by: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` over the sites of one line at a time; lines in parallel. What box it gets is what ``df`` was realized over."""
    return df.groupBy(by).applyInPandas(fn, schema)


def register(df: DataFrame, name: str, fn: Callable[..., pd.Series], schema: str) -> None:
    """A function of the user under a name for SQL."""
    df.sparkSession.udf.register(name, pandas_udf(fn, schema))


