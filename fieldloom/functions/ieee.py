"""Arithmetic with IEEE results on Spark columns, whatever the session's ANSI setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def fdiv(a, b) -> Column:
    """a / b; a zero divisor gives a signed infinity or NaN."""
    a, b = col(a).cast("double"), col(b).cast("double")
    zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).otherwise(F.lit(NAN))
    return F.when(b == 0, F.when(F.isnan(a), F.lit(NAN)).otherwise(zero)).otherwise(a / b)


def frem(a, b) -> Column:
    """a % b with the dividend's sign; NaN for a zero divisor."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b == 0, F.lit(NAN)).otherwise(a % b)


def idiv(a, b) -> Column:
    """Integer quotient, truncated toward zero."""
    return F.call_function("div", col(a).cast("bigint"), col(b).cast("bigint"))


def irem(a, b) -> Column:
    """Integer remainder with the dividend's sign."""
    return col(a).cast("bigint") % col(b).cast("bigint")


def _log(x, f) -> Column:
    x = col(x).cast("double")
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(f(x))


def log(x) -> Column:
    return _log(x, F.ln)


def log2(x) -> Column:
    return _log(x, F.log2)


def log10(x) -> Column:
    return _log(x, F.log10)


def exp2(x) -> Column:
    return F.pow(F.lit(2.0), col(x).cast("double"))


def fmin(a, b) -> Column:
    """The smaller; NaN yields to a number."""
    a, b = col(a), col(b)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


def fmax(a, b) -> Column:
    """The greater; NaN yields to a number."""
    a, b = col(a), col(b)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def compare(op: str, a, b, floats: bool = True) -> Column:
    """An ordered comparison: any NaN makes it false, ``!=`` too."""
    a, b = col(a), col(b)
    out = {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()
    return out & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double")) if floats else out


#: The unary and binary functions of the kernel language.
MATH = {
    "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2,
    "exp": F.exp, "exp2": exp2, "log": log, "log2": log2, "log10": log10, "floor": F.floor, "ceil": F.ceil, "abs": F.abs, "fabs": F.abs,
    "min": fmin, "max": fmax, "pow": F.pow,
}
