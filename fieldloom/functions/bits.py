"""Hashes, low-discrepancy sequences and Morton codes on BIGINT columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.ieee import idiv

#: Fixed values of the integer hash.
HASH_XOR, HASH_MULTIPLIER = 61, 668265261


def let(c: Column, f) -> Column:
    """``f(c)`` with c computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def wrap32(x: Column) -> Column:
    """The low 32 bits, signed."""
    return F.shiftright(F.shiftleft(x.cast("bigint"), 32), 32)


def pixel_hash(x: Column) -> Column:
    """A non-negative integer hash in 32-bit wrapping arithmetic."""
    xor = lambda v, k: v.bitwiseXOR(F.shiftright(v, k))
    x = let(wrap32(x), lambda v: xor(v, 16).bitwiseXOR(F.lit(HASH_XOR).cast("bigint")))
    x = let(x, lambda v: wrap32(v + F.shiftleft(v, 3)))
    x = let(x, lambda v: wrap32(xor(v, 4) * F.lit(HASH_MULTIPLIER).cast("bigint")))
    return let(x, lambda v: F.abs(xor(v, 15)))


def halton(index: Column, base: int, digits: int = 20) -> Column:
    """The radical inverse of index + 1, exact for indices under ``base ** digits``."""
    digit = lambda n: lambda k: (idiv(n, F.pow(F.lit(float(base)), k).cast("bigint")) % base).cast("double") / F.pow(F.lit(float(base)), k + 1)
    return let(index.cast("bigint") + 1, lambda n: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(digits - 1)), digit(n)), F.lit(0.0), lambda a, x: a + x))


def spread3(x: Column) -> Column:
    """The low 10 bits, two zeros between each."""
    x = x.cast("bigint").bitwiseAND(F.lit(1023).cast("bigint"))
    parts = [F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1).cast("bigint")), 3 * k) for k in range(10)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def morton(x: Column, y: Column, z: Column) -> Column:
    """30-bit Morton code of coordinates in [0, 1], clamped to 0..1023 a side."""
    q = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1023.0), c * 1024.0)).cast("bigint")
    return F.shiftleft(spread3(q(x)), 2).bitwiseOR(F.shiftleft(spread3(q(y)), 1)).bitwiseOR(spread3(q(z)))


def clz32(x: Column) -> Column:
    """Leading zeros of a non-negative 32-bit integer; 32 for 0."""
    return F.when(x <= 0, 32).otherwise(32 - F.length(F.bin(x.cast("bigint"))))


def common_prefix(a: Column, i: Column, b: Column, j: Column) -> Column:
    """Length of the common prefix of two 32-bit codes; equal codes go on with their indices."""
    return F.when(a == b, F.lit(32) + clz32(i.bitwiseXOR(j))).otherwise(clz32(a.bitwiseXOR(b)))
