"""A query for each scalar operation: over two whole numbers and two reals taken from ``orders``, row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import expr as E
from gridloom.functions.expr import Expr, cast, compile
from gridloom.functions.types import Float, Int, Type, UInt

# Whole numbers of either sign (b is never zero) and reals, the same in Spark and in the oracle's SQL.
_COLUMNS = {
    "a": "pmod(o_orderkey * 7919, 511) - 255",
    "b": "pmod(o_custkey * 104729, 61) * 2 - 61",
    "p": "round(o_totalprice) / 4096.0",
    "q": "(pmod(o_orderkey, 199) - 99) / 64.0",
}
_ORACLE = {
    "a": "(o_orderkey * 7919) % 511 - 255",
    "b": "((o_custkey * 104729) % 61) * 2 - 61",
    "p": "round(o_totalprice)::DOUBLE / 4096.0",
    "q": "((o_orderkey % 199) - 99)::DOUBLE / 64.0",
}
_KINDS = {"a": Int(64), "b": Int(64), "p": Float(64), "q": Float(64)}


def _v(name: str, kind: Type | None = None) -> Expr:
    e = Expr("var", (), _KINDS[name], name)
    return cast(kind, e) if kind else e


def _fixed(c: Column) -> Column:
    """Reals to six places, as whole numbers, with words for what isn't finite."""
    return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(F.floor(c * 1e6 + 0.5).cast("bigint").cast("string"))


def _fixed_sql(s: str) -> str:
    return f"CASE WHEN isnan({s}) THEN 'nan' WHEN {s} = 'inf'::DOUBLE THEN 'inf' WHEN {s} = '-inf'::DOUBLE THEN '-inf' ELSE floor(({s}) * 1e6 + 0.5)::BIGINT::VARCHAR END"


def _wrap_sql(s: str, bits: int, signed: bool) -> str:
    m = 1 << bits
    low = f"((({s}) % {m} + {m}) % {m})"
    return f"({low} - CASE WHEN {low} >= {m >> 1} THEN {m} ELSE 0 END)" if signed else low


_MOD = "((a % abs(b) + abs(b)) % abs(b))"
i8, i16, i32, u8, u16, u32, f32, f64 = Int(8), Int(16), Int(32), UInt(8), UInt(16), UInt(32), Float(32), Float(64)
A, B, P, Q = _v("a"), _v("b"), _v("p"), _v("q")


def _i(n: str, k: Type) -> Expr:
    return _v(n, k)


#: name -> (expression, SQL for the same)
SCALARS: dict[str, tuple[Expr, str]] = {
    "s01_add_wraps": (_i("a", i8) + _i("b", i8), _wrap_sql(f"{_wrap_sql('a', 8, True)} + {_wrap_sql('b', 8, True)}", 8, True)),
    "s02_sub_wraps": (_i("a", u8) - _i("b", u8), _wrap_sql(f"{_wrap_sql('a', 8, False)} - {_wrap_sql('b', 8, False)}", 8, False)),
    "s02_negate": (-_i("a", i8), _wrap_sql("-a", 8, True)),
    "s03_mul_wraps": (_i("a", i16) * _i("a", i16) * _i("b", i16), _wrap_sql("a * a * b", 16, True)),
    "s03_mul_u32": (_i("a", u32) * _i("b", u32), _wrap_sql("a * b", 32, False)),
    "s04_div_int": (_i("a", i32) / _i("b", i32), f"(a - {_MOD}) // b"),
    "s05_div_float": (P / Q, "CASE WHEN q = 0 THEN CASE WHEN p > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE p / q END"),
    "s06_mod_int": (_i("a", i32) % _i("b", i32), _MOD),
    "s07_mod_float": (Q % P, "q - p * floor(q / p)"),
    "s08_max": (E.maximum_of(A, B), "greatest(a, b)"),
    "s09_min": (E.minimum_of(A, B), "least(a, b)"),
    "s10_clamp": (E.clamp(A, -60, 50), "greatest(least(a, 50), -60)"),
    "s11_abs": (E.absolute(_i("a", i16)), "abs(a)"),
    "s11_abs_least": (E.absolute(_i("a", i8)), f"abs({_wrap_sql('a', 8, True)})"),
    "s12_absd": (E.absd(_i("a", i16), _i("b", i16)), "abs(a - b)"),
    "s13_sin": (E.sin(P), "sin(p)"),
    "s14_asin": (E.asin(Q / 2.0), "CASE WHEN abs(q / 2) <= 1 THEN asin(q / 2) ELSE 'nan'::DOUBLE END"),
    "s15_cos": (E.cos(P), "cos(p)"),
    "s16_acos": (E.acos(Q / 2.0), "CASE WHEN abs(q / 2) <= 1 THEN acos(q / 2) ELSE 'nan'::DOUBLE END"),
    "s17_tan": (E.tan(Q), "tan(q)"),
    "s18_atan": (E.atan(P), "atan(p)"),
    "s19_atan2": (E.atan2(Q, P), "atan2(q, p)"),
    "s20_sinh": (E.sinh(Q), "(exp(q) - exp(-q)) / 2"),
    "s21_asinh": (E.asinh(Q), "asinh(q)"),
    "s22_cosh": (E.cosh(Q), "cosh(q)"),
    "s23_acosh": (E.acosh(P + 1.0), "acosh(p + 1)"),
    "s24_tanh": (E.tanh(Q), "tanh(q)"),
    "s25_atanh": (E.atanh(Q / 2.0), "atanh(q / 2)"),
    "s26_sqrt": (E.sqrt(P), "sqrt(p)"),
    "s27_hypot": (E.hypot(P, Q), "sqrt(p * p + q * q)"),
    "s28_exp": (E.exp(Q), "exp(q)"),
    "s29_log": (E.log(Q), "CASE WHEN q < 0 THEN 'nan'::DOUBLE WHEN q = 0 THEN '-inf'::DOUBLE ELSE ln(nullif(greatest(q, 0), 0)) END"),
    "s30_pow": (E.power(P, Q), "pow(p, q)"),
    "s30_pow_whole": (E.power(Q, 5), "q * q * q * q * q"),
    "s32_fast_log": (cast(f64, E.fast_log(P + 1.0)), "ln(p + 1)"),
    "s33_fast_exp": (cast(f64, E.fast_exp(Q)), "exp(q)"),
    "s35_fast_inverse": (E.fast_inverse(P + 1.0), "1 / (p + 1)"),
    "s36_fast_inverse_sqrt": (E.fast_inverse_sqrt(P + 1.0), "1 / sqrt(p + 1)"),
    "s37_floor": (E.floor(Q * 3.0), "floor(q * 3)"),
    "s38_ceil": (E.ceil(Q * 3.0), "ceil(q * 3)"),
    "s39_round": (E.round_(Q * 8.0), "round_even(q * 8, 0)"),
    "s40_trunc": (E.trunc(Q * 3.0), "trunc(q * 3)"),
    "s41_fract": (E.fract(Q * 3.0), "q * 3 - trunc(q * 3)"),
    "s42_is_nan": (E.is_nan(E.log(Q)), "q < 0"),
    "s43_and": (_i("a", i32) & _i("b", i32), "a & b"),
    "s44_or": (_i("a", i32) | _i("b", i32), "a | b"),
    "s45_xor": (_i("a", i32) ^ _i("b", i32), "xor(a, b)"),
    "s46_not": (~_i("a", u8), f"255 - {_wrap_sql('a', 8, False)}"),
    "s47_shift_left": (_i("a", i16) << (_i("b", i16) & 7), _wrap_sql("a * (1 << (b & 7)::INT)", 16, True)),
    "s48_shift_right": (_i("a", i16) >> (_i("b", i16) & 7), "a >> (b & 7)::INT"),
    "s48_shift_right_u": (_i("a", u16) >> (_i("b", u16) & 7), f"{_wrap_sql('a', 16, False)} >> (b & 7)::INT"),
    "s49_popcount": (E.popcount(_i("a", i8)), f"bit_count({_wrap_sql('a', 8, False)}::BIGINT)"),
    "s50_leading_zeros": (E.count_leading_zeros(_i("b", u16)), f"16 - length(ltrim(bin({_wrap_sql('b', 16, False)}::BIGINT), '0'))"),
    "s51_trailing_zeros": (E.count_trailing_zeros(E.absolute(_i("b", i16)) * 4), "2"),
    "s52_lerp_u8": (E.lerp(_i("a", u8), _i("b", u8), cast(u8, A * 3)), f"(({_wrap_sql('a', 8, False)} * (255 - {_wrap_sql('a * 3', 8, False)}) + {_wrap_sql('b', 8, False)} * {_wrap_sql('a * 3', 8, False)}) * 2 + 255) // 510"),
    "s52_lerp_float": (E.lerp(P, Q, cast(f64, 0.25)), "p * 0.75 + q * 0.25"),
    "s52_lerp_bool": (cast(i32, E.lerp(A > 0, B > 0, cast(u8, A))), f"CASE WHEN {_wrap_sql('a', 8, False)} > 127 THEN (b > 0)::INT ELSE (a > 0)::INT END"),
    "s54_random_int": (E.random_uint(7, 3, 0, cast(u32, A)), "(random(random(random(random(7) + 3) + 0) + {u}))"),
    "s53_random_float": (cast(f64, E.random_float(9, cast(u32, B))), "((random(random(9) + {w}) >> 9)::DOUBLE / 8388608)"),
    "s55_memoize_tag": (E.memoize_tag(A + B, 1), "a + b"),
    "s56_type_limits": (E.clamp(A, i8.min(), i8.max()), "greatest(least(a, 127), -128)"),
    "s57_fast_integer_divide": (E.fast_integer_divide(_i("a", u16), cast(u16, E.absolute(B))), f"{_wrap_sql('a', 16, False)} // abs(b)"),
    "s58_float16": (cast(Float(16), Q), "q"),
    "p07_cast_int": (cast(i8, cast(i32, Q * 100.0)), _wrap_sql("trunc(q * 100)::BIGINT", 8, True)),
    "p07_cast_float32": (cast(f64, cast(f32, P)), "p::FLOAT::DOUBLE"),
    "p08_reinterpret_int": (E.reinterpret(u8, _i("a", i8)), _wrap_sql("a", 8, False)),
    "p08_reinterpret_float": (E.reinterpret(f32, cast(u32, (A + 300) * 100003 + 1040000000)), "(1 + ((((a + 300) * 100003 + 1040000000) % 8388608)::DOUBLE / 8388608)) * pow(2.0, ((a + 300) * 100003 + 1040000000) // 8388608 - 127)"),
    "p09_select": (E.select(A > B, A, B + 1), "CASE WHEN a > b THEN a ELSE b + 1 END"),
    "p10_select_many": (E.select(A < -100, A, A < 0, B, A < 100, A + B, A - B), "CASE WHEN a < -100 THEN a WHEN a < 0 THEN b WHEN a < 100 THEN a + b ELSE a - b END"),
    "p12_compare": (cast(i32, A < B) + cast(i32, A <= B) * 2 + cast(i32, A == B) * 4 + cast(i32, A != B) * 8 + cast(i32, A > B) * 16 + cast(i32, A >= B) * 32, "(a < b)::INT + (a <= b)::INT * 2 + (a = b)::INT * 4 + (a <> b)::INT * 8 + (a > b)::INT * 16 + (a >= b)::INT * 32"),
    "p13_logic": (cast(i32, ((A > 0) & (B > 0)) | ~(A > B)), "((a > 0 AND b > 0) OR NOT (a > b))::INT"),
    "p15_likely": (E.likely(A * 2), "a * 2"),
    "p16_let": ((A + B) * (A + B), "(a + b) * (a + b)"),
}
_C0, _C1, _C2 = E.RANDOM


def _expand(sql: str) -> str:
    """The hash written out: one level of arithmetic for each ``random(...)``, innermost first."""
    sql = sql.replace("{u}", _wrap_sql("a", 32, False)).replace("{w}", _wrap_sql("b", 32, False))
    while "random(" in sql:
        start = sql.rindex("random(")
        depth, end = 0, start + 6
        while True:
            depth += (sql[end] == "(") - (sql[end] == ")")
            end += 1
            if not depth:
                break
        x = f"(({sql[start + 7 : end - 1]}) % 4294967296)"
        sql = f"{sql[:start]}((((({_C2}::HUGEINT * {x} + {_C1}) % 4294967296) * {x} + {_C0}) % 4294967296)::BIGINT){sql[end:]}"
    return sql


def _result(e: Expr, c: Column) -> Column:
    return _fixed(c) if e.kind.is_float else c.cast("bigint")


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    e, _ = SCALARS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", *[F.expr(s).cast("double" if _KINDS[n].is_float else "bigint").alias(n) for n, s in _COLUMNS.items()])
        return orders.select("o_orderkey", _result(e, compile(e, lambda x: F.col(x.data) if x.op == "var" else None)).alias("value"))

    return run


def oracle(name: str) -> str:
    e, sql = SCALARS[name]
    value = _fixed_sql(_expand(sql)) if e.kind.is_float else f"({_expand(sql)})::BIGINT"
    return f"WITH o AS (SELECT o_orderkey, {', '.join(f'{s} AS {n}' for n, s in _ORACLE.items())} FROM orders) SELECT o_orderkey, {value} AS value FROM o"


QUERIES = {name: query(name) for name in SCALARS}
ORACLE_SQL = {name: oracle(name) for name in SCALARS}
