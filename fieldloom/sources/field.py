"""Fields: n-dimensional arrays as DataFrames keyed by a complete linear index 0 .. n-1.

A field is immutable; operations return new fields. ``shape`` is driver metadata, the data column is ``val``
(or an array column for vector fields). ``writable`` is kept for imported fields, whose writes are refused.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import types as ty
from fieldloom.functions.types import Scalar


def _shape(shape) -> tuple[int, ...]:
    return (int(shape),) if isinstance(shape, (int, np.integer)) else tuple(int(s) for s in shape)


@dataclass(frozen=True)
class Field:
    df: DataFrame  # idx BIGINT, val
    dtype: Scalar
    shape: tuple[int, ...]
    components: int = 0  # of a vector field
    writable: bool = True

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    def __len__(self) -> int:
        return self.shape[0] if self.shape else 1

    def _with(self, val: Column, dtype: Scalar | None = None) -> Field:
        return replace(self, df=self.df.select("idx", val.alias("val")), dtype=dtype or self.dtype, writable=True)

    def map(self, f, dtype: Scalar | None = None) -> Field:
        """A new field of ``f(val)``."""
        t = dtype or self.dtype
        return self._with(ty.cast(f(F.col("val")), t, ty.f64 if t.kind == "f" else None), t)

    def fill(self, value, n: int | None = None) -> Field:
        """All elements, or the first n, set to a value."""
        self._check_writable()
        v = F.lit(value).cast(self.dtype.spark)
        return self._with(v if n is None else F.when(F.col("idx") < n, v).otherwise(F.col("val")))

    def _check_writable(self) -> None:
        if not self.writable:
            raise ValueError("the field is read-only")

    def astype(self, dtype: Scalar) -> Field:
        return self._with(ty.cast(F.col("val"), dtype, self.dtype), dtype)

    def reshape(self, *shape) -> Field:
        """The same data under another shape of the same size; one dimension may be -1."""
        new = _shape(shape[0] if len(shape) == 1 and not isinstance(shape[0], int) else shape)
        if new.count(-1) == 1:
            rest = -math.prod(new)
            new = tuple(self.size // rest if s == -1 else s for s in new)
        if math.prod(new) != self.size:
            raise ValueError(f"cannot reshape {self.shape} to {new}")
        return replace(self, shape=new)

    def copy(self, n: int | None = None) -> Field:
        """A writable copy, of the first n elements if given."""
        if n is None:
            return replace(self, writable=True)
        if not 0 <= n <= self.size:
            raise ValueError(f"{n} is not a number of elements of {self.shape}")
        return replace(self, df=self.df.where(F.col("idx") < n), shape=(n,), writable=True)

    def with_copied(self, src: Field, n: int | None = None, offset: int = 0) -> Field:
        """This field with the first n elements of ``src`` (all if not given) in the places from ``offset`` on, converted to its type.

        Elements beyond either end are left out.
        """
        self._check_writable()
        m = src.size if n is None else min(n, src.size)
        new = src.df.where(F.col("idx") < m).select((F.col("idx") + offset).alias("idx"), ty.cast(F.col("val"), self.dtype, src.dtype).alias("__new"), F.lit(True).alias("__hit"))
        both = self.df.join(new, "idx", "left")
        return replace(self, df=both.select("idx", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("val")).alias("val")))

    def index(self, *subscripts: Column | int) -> Column:
        """The row-major linear index of subscripts."""
        out = F.lit(0).cast("bigint")
        for s, d in zip(subscripts, self.shape, strict=True):
            out = out * d + (s if isinstance(s, Column) else F.lit(s))
        return out

    def unpacked(self, *names: str) -> DataFrame:
        """The data with its subscripts as columns."""
        return self.df.select("idx", *[c.alias(n) for n, c in zip(names, unpack(F.col("idx"), self.shape), strict=True)], "val")

    # host exchange: for results of a size that the driver holds
    def to_numpy(self) -> np.ndarray:
        rows = self.df.orderBy("idx").select("val").toArrow().column("val").to_pylist()
        if self.components:
            return np.array(rows, self.dtype.numpy).reshape(*self.shape, self.components)
        return np.array([int(x) if self.dtype == ty.u64 else x for x in rows], self.dtype.numpy).reshape(self.shape)

    def from_numpy(self, a: np.ndarray) -> Field:
        """The array's values as this field's; shapes must agree."""
        self._check_writable()
        if tuple(a.shape) != self.shape:
            raise ValueError(f"shape {tuple(a.shape)} is not {self.shape}")
        return field_like(self.df.sparkSession, a.astype(self.dtype.numpy), self.dtype)

    def __dlpack__(self, *, stream=None, max_version=None, dl_device=None, copy=None):
        """The values on the host. A read-only field is exported as such, for which a consumer must ask for version 1 or later;
        a consumer that wants no copy is refused, as a distributed field has none to share."""
        if stream is not None:
            raise ValueError("host memory has no stream")
        if dl_device is not None and tuple(dl_device) != self.__dlpack_device__():
            raise BufferError("fields are exported to host memory only")
        if copy is False:
            raise BufferError("a field's values are always copied")
        a = self.to_numpy()
        if not self.writable:
            a.flags.writeable = False
        return a.__dlpack__(max_version=max_version)

    def __dlpack_device__(self):
        return (1, 0)

    # reductions: one partial and one final aggregate
    def _one(self, c: Column) -> float:
        return self.df.agg(c.alias("x")).first()["x"]

    def sum(self) -> float:
        return float(self._one(F.sum(F.col("val").cast("double"))) or 0.0)

    def _nan_or(self, c: Column) -> float:
        r = self.df.agg(F.max(F.isnan(F.col("val").cast("double"))).alias("nan"), c.alias("x")).first()
        if r["x"] is None:
            raise ValueError("an empty field has no extremes")
        return math.nan if r["nan"] else float(r["x"])

    def min(self) -> float:
        return self._nan_or(F.min("val"))

    def max(self) -> float:
        return self._nan_or(F.max("val"))

    def mean(self) -> float:
        return self.sum() / self.size


def unpack(idx: Column, shape: Sequence[int]) -> list[Column]:
    """Row-major subscripts of a linear index."""
    out, stride = [], 1
    for d in reversed(shape):
        out.append((F.call_function("div", idx, F.lit(stride).cast("bigint")) if stride > 1 else idx) % d)
        stride *= d
    return out[::-1]


def _generated(spark: SparkSession, dtype: Scalar, shape, val: Column) -> Field:
    shape = _shape(shape)
    return Field(spark.range(math.prod(shape)).select(F.col("id").alias("idx"), val.alias("val")), dtype, shape)


def full(spark: SparkSession, dtype: Scalar, shape, value) -> Field:
    return _generated(spark, dtype, shape, ty.cast(F.lit(value), dtype, ty.of_literal(value)))


def zeros(spark: SparkSession, dtype: Scalar, shape) -> Field:
    return full(spark, dtype, shape, 0)


def ones(spark: SparkSession, dtype: Scalar, shape) -> Field:
    return full(spark, dtype, shape, 1)


def field(spark: SparkSession, dtype: Scalar = ty.f32, shape=()) -> Field:
    """A new field of zeros."""
    return zeros(spark, dtype, shape)


def arange(spark: SparkSession, n: int, dtype: Scalar = ty.i32) -> Field:
    return _generated(spark, dtype, n, ty.cast(F.col("id"), dtype, ty.i64))


iota = arange


def vector_field(spark: SparkSession, n: int, dtype: Scalar, shape) -> Field:
    """Zero vectors of n components."""
    shape = _shape(shape)
    val = F.array_repeat(F.lit(0).cast(dtype.spark), n)
    return Field(spark.range(math.prod(shape)).select(F.col("id").alias("idx"), val.alias("val")), dtype, shape, n)


def field_like(spark: SparkSession, a, dtype: Scalar | None = None) -> Field:
    """A field of an array's values, type and shape."""
    a = np.asarray(a)
    dtype = dtype or ty.of_numpy(a.dtype)
    flat = np.ascontiguousarray(a.astype(dtype.numpy)).reshape(-1)
    held = flat.astype({"u8": np.int16, "u16": np.int32, "u32": np.int64}.get(dtype.name, flat.dtype))
    val = pa.array([int(x) for x in held], pa.decimal128(20, 0)) if dtype == ty.u64 else pa.array(held)
    table = pa.table({"idx": pa.array(np.arange(len(flat), dtype=np.int64)), "val": val})
    schema = T.StructType([T.StructField("idx", T.LongType()), T.StructField("val", dtype.spark)])
    return Field(spark.createDataFrame(table, schema), dtype, tuple(a.shape))


def from_dlpack(spark: SparkSession, source, writable: bool = False, copy: bool | None = None) -> Field:
    """A field of what exports DLPack on the host; read-only unless asked, or if the exporter is to copy. Values are copied once, to Arrow."""
    a = np.from_dlpack(source) if copy is None else np.from_dlpack(source, copy=copy)
    writable = writable or copy is True
    if not a.flags.c_contiguous:
        raise ValueError("only C-contiguous arrays are taken")
    return replace(field_like(spark, a), writable=writable)


def of_frame(df: DataFrame, val: str, order: Sequence[str] | str, dtype: Scalar | None = None, n: int | None = None) -> Field:
    """A field of a column. ``order``: the column that already is a dense index, or the columns to number rows by."""
    from fieldloom.operators.scan import dense_index

    if isinstance(order, str):
        rows = df.select(F.col(order).cast("bigint").alias("idx"), F.col(val).alias("val"))
    else:
        rows = dense_index(df.select(*{*order, val}), list(order)).select("idx", F.col(val).alias("val"))
    dtype = dtype or ty.of_spark(rows.schema["val"].dataType)
    return Field(rows.select("idx", F.col("val").cast(dtype.spark)), dtype, (n if n is not None else rows.count(),))


def concat(fields: Sequence[Field]) -> Field:
    """One-dimensional fields of one type, end to end."""
    if not fields:
        raise ValueError("nothing to concatenate")
    if len({f.dtype for f in fields}) > 1:
        raise TypeError("fields of different types")
    out, at = None, 0
    for f in fields:
        part = f.df.select((F.col("idx") + at).alias("idx"), "val")
        out = part if out is None else out.unionByName(part)
        at += f.size
    return Field(out, fields[0].dtype, (at,))


def to_tuples(df: DataFrame, n: int, key: str = "idx", val: str = "val") -> DataFrame:
    """Interleaved components to one array a tuple: (idx, val array)."""
    by = F.call_function("div", F.col(key), F.lit(n).cast("bigint")).alias("idx")
    return df.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(key, val))), lambda x: x[val]).alias("val"))


def from_tuples(df: DataFrame, n: int, key: str = "idx", val: str = "val") -> DataFrame:
    """Arrays of n components to interleaved elements."""
    return df.select(F.col(key).alias("t"), F.posexplode(val).alias("k", "val")).select((F.col("t") * n + F.col("k")).alias("idx"), "val")


def tuples_of(f: Field, n_components: int | None = None, name: str = "val") -> DataFrame:
    """A field as rows (idx, ``name`` array) of tuples. A second dimension is the number of components; of a flat field of
    interleaved values it must be given."""
    if n_components is None:
        if len(f.shape) > 2:
            raise ValueError(f"a field of shape {f.shape} has no order of tuples; give the components or reshape it")
        n_components = f.shape[1] if len(f.shape) == 2 else 1
    elif n_components < 1:
        raise ValueError(f"{n_components} components")
    elif len(f.shape) == 2 and f.shape[1] != n_components:
        raise ValueError(f"{n_components} components of a field of shape {f.shape}")
    elif f.size % n_components:
        raise ValueError(f"{f.size} values are no tuples of {n_components}")
    return to_tuples(f.df, n_components).withColumnRenamed("val", name)


def field_of_tuples(df: DataFrame, dtype: Scalar, val: str = "val", flatten: bool = False) -> Field:
    """Rows (idx, array) of tuples as a field of shape (tuples, components); one component, or ``flatten``, gives a flat one."""
    sizes = df.agg(F.count("*").alias("n"), F.min(F.size(val)).alias("lo"), F.max(F.size(val)).alias("hi")).first()
    if sizes["n"] and sizes["lo"] != sizes["hi"]:
        raise ValueError("tuples of different lengths")
    n, m = sizes["n"], sizes["hi"] or 1
    flat = from_tuples(df, m, "idx", val).select("idx", F.col("val").cast(dtype.spark).alias("val"))
    return Field(flat, dtype, (n * m,) if flatten or m == 1 else (n, m))


def last(f: Field) -> float:
    return f.df.where(F.col("idx") == f.size - 1).first()["val"]


