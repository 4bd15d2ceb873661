"""Scalar types of fixed width, how operands are matched, and how a Spark column is brought into a type.

Integers up to 32 bits are computed in bigint and wrapped to their width where an operation may leave it, so Spark's ANSI
checks stay on and never fire. 64-bit sums and products are computed in decimals and folded back. Floats are computed in
double; ``Float(32)`` values are rounded to single precision when they are cast or stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Type:
    code: str  # int, uint, float
    bits: int

    @property
    def is_float(self) -> bool:
        return self.code == "float"

    @property
    def is_bool(self) -> bool:
        return self.code == "uint" and self.bits == 1

    @property
    def is_int(self) -> bool:
        return not self.is_float

    def min(self) -> int | float:
        """The least value: also the identity of a maximum."""
        return 0 if self.code == "uint" else -(1 << self.bits - 1) if self.code == "int" else float("-inf")

    def max(self) -> int | float:
        return (1 << self.bits) - 1 if self.code == "uint" else (1 << self.bits - 1) - 1 if self.code == "int" else float("inf")

    def holds(self, value: int) -> bool:
        return self.is_float or self.min() <= value <= self.max()

    def spark(self) -> str:
        if self.is_float:
            return "double"
        return "boolean" if self.is_bool else "decimal(20,0)" if (self.code, self.bits) == ("uint", 64) else "bigint"

    def __str__(self) -> str:
        return "bool" if self.is_bool else f"{self.code}{self.bits}"


def Int(bits: int) -> Type:
    return Type("int", bits)


def UInt(bits: int) -> Type:
    return Type("uint", bits)


def Float(bits: int) -> Type:
    return Type("float", bits)


Bool = UInt(1)


def big(value: int, digits: int = 38) -> Column:
    """A whole number too large for bigint."""
    return F.lit(str(value)).cast(f"decimal({digits},0)")


def wrap(column: Column, kind: Type) -> Column:
    """A whole number of any size folded into ``kind`` as two's complement."""
    if kind.bits == 64:
        folded = F.pmod(column.cast("decimal(38,0)"), big(1 << 64, 38))
        if kind.code == "uint":
            return folded.cast("decimal(20,0)")
        return F.when(folded >= big(1 << 63, 38), folded - big(1 << 64, 38)).otherwise(folded).cast("bigint")
    low = column.bitwiseAND(F.lit((1 << kind.bits) - 1))
    half = F.lit(1 << kind.bits - 1)
    return low if kind.code == "uint" else low.bitwiseXOR(half) - half


def convert(column: Column, had: Type, to: Type) -> Column:
    """A cast: integers keep their low bits, floats go toward zero, narrower floats are rounded."""
    if had == to:
        return column
    if to.is_bool:
        return column != 0
    if had.is_bool:
        return convert(column.cast("bigint"), Int(64), to) if to.is_int else column.cast("int").cast("double")
    if to.is_float:
        return column.cast("double") if to.bits == 64 else column.cast("float").cast("double")
    if had.is_float:
        whole = F.when(column < 0, F.ceil(column)).otherwise(F.floor(column))
        return wrap(whole, to)
    fits = to.min() <= had.min() and had.max() <= to.max()
    if fits:
        return column.cast(to.spark()) if had.spark() != to.spark() else column
    if had.bits == 64 and had.code == "uint" and to.bits < 64:
        return wrap(F.pmod(column.cast("decimal(38,0)"), big(1 << 32, 38)).cast("bigint"), to)
    return wrap(column, to)


def matched(a: Type, b: Type) -> Type:
    """The type in which two operands meet."""
    if a == b:
        return a
    if a.is_float and b.is_float:
        return a if a.bits >= b.bits else b
    if a.is_float or b.is_float:
        return a if a.is_float else b
    bits = max(a.bits, b.bits)
    return UInt(bits) if a.code == b.code == "uint" else Int(bits)
