"""Scalar types of fields, their promotion, and wrapping casts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Scalar:
    """A field's element type. Unsigned ones are held in the next wider signed Spark type (u64 as a decimal)."""

    name: str
    spark: T.DataType
    numpy: np.dtype
    bits: int
    kind: str  # i, u or f

    @property
    def rank(self) -> int:
        """Position in the promotion order: 8, 16, 32, 64 bits of integers, then floats."""
        return (4 if self.kind == "f" else 0) + self.bits.bit_length()

    def __repr__(self) -> str:
        return self.name


def _make(name: str, spark: T.DataType) -> Scalar:
    full = {"i": "int", "u": "uint", "f": "float"}[name[0]] + name[1:]
    return Scalar(name, spark, np.dtype(full), int(name[1:]), name[0])


i8, i16, i32, i64 = _make("i8", T.ByteType()), _make("i16", T.ShortType()), _make("i32", T.IntegerType()), _make("i64", T.LongType())
u8, u16, u32, u64 = _make("u8", T.ShortType()), _make("u16", T.IntegerType()), _make("u32", T.LongType()), _make("u64", T.DecimalType(20, 0))
f32, f64 = _make("f32", T.FloatType()), _make("f64", T.DoubleType())
ALL = {t.name: t for t in (i8, i16, i32, i64, u8, u16, u32, u64, f32, f64)}


def of_numpy(dtype) -> Scalar:
    """The type of a numpy dtype; ``TypeError`` for others than the ten scalars."""
    for t in ALL.values():
        if t.numpy == np.dtype(dtype):
            return t
    raise TypeError(f"no scalar type for {dtype}")


def of_spark(kind: T.DataType) -> Scalar:
    for t in (i8, i16, i32, i64, f32, f64, u64):
        if t.spark == kind:
            return t
    raise TypeError(f"no scalar type for {kind.simpleString()}")


def of_literal(x, wide_floats: bool = False) -> Scalar:
    """Python integers are i32, or i64 beyond 31 bits; floats are f32 unless a field beside them is f64."""
    if isinstance(x, bool) or isinstance(x, (int, np.integer)):
        return i32 if -(2**31) <= int(x) < 2**31 else i64
    if isinstance(x, (float, np.floating)):
        return f64 if wide_floats else f32
    raise TypeError(f"no scalar type for {type(x).__name__}")


def promote(a: Scalar, b: Scalar) -> Scalar:
    """The higher rank holds unchanged; of equal rank and different sign, the next wider signed type (i64 at most)."""
    if a == b:
        return a
    if a.rank != b.rank:
        return max(a, b, key=lambda t: t.rank)
    return ALL[f"i{min(64, 2 * a.bits)}"]


def cast(c: Column, to: Scalar, source: Scalar | None = None) -> Column:
    """Integers wrap, floats truncate toward zero (NULL beyond 64 bits); no session setting changes it."""
    if to.kind == "f":
        return c.cast(to.spark)
    if source is not None and source.kind == "f":
        c = c.try_cast("bigint")
    if to == u64:
        wide = c.cast("decimal(20,0)")
        return F.when(wide < 0, wide + F.lit(2**64).cast("decimal(20,0)")).otherwise(wide).cast(to.spark)
    wide = c.cast("bigint")
    if to == i64:
        return wide
    if to.kind == "u":
        return wide.bitwiseAND(F.lit(2**to.bits - 1).cast("bigint")).cast(to.spark)
    return F.shiftright(F.shiftleft(wide, 64 - to.bits), 64 - to.bits).cast(to.spark)
