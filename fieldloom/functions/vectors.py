"""Vectors of any arity as array columns, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.ieee import col, fdiv


def vector(*components) -> Column:
    return F.array(*[col(c).cast("double") for c in components])


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _zip(a: Column, b, f) -> Column:
    if isinstance(b, Column):
        return F.zip_with(a, b, f)
    return F.transform(a, lambda x: f(x, F.lit(b)))


def add(a: Column, b) -> Column:
    return _zip(a, b, lambda x, y: x + y)


def sub(a: Column, b) -> Column:
    return _zip(a, b, lambda x, y: x - y)


def mul(a: Column, b) -> Column:
    return _zip(a, b, lambda x, y: x * y)


def div(a: Column, b) -> Column:
    return _zip(a, b, fdiv)


def scale(a: Column, factor: Column) -> Column:
    """Each component times a scalar column."""
    return F.transform(a, lambda x: x * factor)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm_sqr(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(norm_sqr(a))


def normalized(a: Column) -> Column:
    """a over its norm; NaN for a zero vector."""
    n = norm(a)
    return F.transform(a, lambda x: fdiv(x, n))


def cross(a: Column, b: Column) -> Column:
    """Of two three-component vectors."""
    x, y = [F.get(a, F.lit(i)) for i in range(3)], [F.get(b, F.lit(i)) for i in range(3)]
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])
