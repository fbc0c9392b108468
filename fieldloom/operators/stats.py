"""Statistics of columns: whole-column aggregates, keyed (atomic-style) aggregates, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first(df: DataFrame, n: int | None, idx: str) -> DataFrame:
    return df if n is None else df.where(F.col(idx) < n)


def _d(val: str) -> Column:
    return F.col(val).cast("double")


def describe(df: DataFrame, val: str = "val") -> DataFrame:
    """sum, min, max, mean in one pass."""
    return df.agg(F.sum(_d(val)).alias("sum"), F.min(_d(val)).alias("min"), F.max(_d(val)).alias("max"), F.avg(_d(val)).alias("mean"))


def var(df: DataFrame, val: str = "val", n: int | None = None, idx: str = "idx") -> float:
    """Population variance, of the first n if given."""
    return float(_first(df, n, idx).agg(F.var_pop(_d(val))).first()[0] or 0.0)


def std(df: DataFrame, val: str = "val", n: int | None = None, idx: str = "idx") -> float:
    return var(df, val, n, idx) ** 0.5


def norm_of(val: str, order: float | int = 2) -> Column:
    """L1, L2 or maximum norm as an aggregate."""
    x = _d(val)
    if order == 1:
        return F.coalesce(F.sum(F.abs(x)), F.lit(0.0))
    if order == 2:
        return F.sqrt(F.coalesce(F.sum(x * x), F.lit(0.0)))
    if order == float("inf"):
        return absmax_of(val)
    raise ValueError(f"unsupported norm order {order!r}")


def absmax_of(val: str) -> Column:
    """The greatest absolute value; 0 for none."""
    return F.coalesce(F.max(F.abs(_d(val))), F.lit(0.0))


def nonzero_of(val: str) -> Column:
    """How many are neither 0 nor NaN."""
    return F.count_if((_d(val) != 0) & ~F.isnan(_d(val)))


def norm(df: DataFrame, val: str = "val", order: float | int = 2, n: int | None = None, idx: str = "idx") -> float:
    return float(_first(df, n, idx).agg(norm_of(val, order)).first()[0])


def absmax(df: DataFrame, val: str = "val", n: int | None = None, idx: str = "idx") -> float:
    return float(_first(df, n, idx).agg(absmax_of(val)).first()[0])


def count_nonzero(df: DataFrame, val: str = "val", n: int | None = None, idx: str = "idx") -> int:
    return int(_first(df, n, idx).agg(nonzero_of(val)).first()[0])


def dot(a: DataFrame, b: DataFrame, val: str = "val", n: int | None = None, idx: str = "idx") -> float:
    """Of two fields; co-indexed columns of one frame need no join, only ``sum(a * b)``."""
    both = _first(a, n, idx).select(idx, _d(val).alias("a")).join(b.select(idx, _d(val).alias("b")), idx)
    return float(both.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0)


def bin_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Truncated and clamped: values beyond the range count in the edge bins."""
    raw = ((x - lo) * F.lit(float(bins)) / (hi - lo)).cast("bigint")
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw)).cast("bigint")


def histogram(df: DataFrame, val: str = "val", bins: int = 10, range_: tuple[float, float] | None = None) -> DataFrame:
    """bin, lo, hi, cnt; every bin is present. Without a range it is the values' own; equal ends are one apart."""
    spark = df.sparkSession
    x = df.select(_d(val).alias("x"))
    if range_ is None:
        ends = x.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    else:
        ends = spark.range(1).select(F.lit(float(range_[0])).alias("a"), F.lit(float(range_[1])).alias("b"))
    ends = ends.select("a", F.when(F.col("a") == F.col("b"), F.col("a") + 1).otherwise(F.col("b")).alias("b"))
    # the ends are one row by construction
    placed = x.where("x is not null").crossJoin(F.broadcast(ends)).groupBy(bin_of(F.col("x"), F.col("a"), F.col("b"), bins).alias("bin")).agg(F.count("*").alias("cnt"))
    width = (F.col("b") - F.col("a")) / bins
    all_bins = spark.range(bins).select(F.col("id").alias("bin")).crossJoin(F.broadcast(ends))
    edges = all_bins.select("bin", (F.col("a") + F.col("bin") * width).alias("lo"), F.when(F.col("bin") == bins - 1, F.col("b")).otherwise(F.col("a") + (F.col("bin") + 1) * width).alias("hi"))
    return edges.join(placed, "bin", "left").select("bin", "lo", "hi", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))


def keyed(base: DataFrame, updates: DataFrame, how: str | dict[str, str], key: str = "idx", val: str = "val") -> DataFrame:
    """Atomic add, min or max of updates (key, val) into a base field: aggregated by key first, then merged.

    ``how`` may name the operation of several columns, which share one grouping.
    """
    ops = {val: how} if isinstance(how, str) else how
    agg = {"add": F.sum, "min": F.min, "max": F.max}
    delta = updates.groupBy(key).agg(*[agg[h](c).alias(f"__{c}") for c, h in ops.items()])
    merge = {"add": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    merged = {c: merge[h](F.col(c), F.col(f"__{c}")) for c, h in ops.items()}
    return base.join(delta, key, "left").withColumns(merged).drop(*[f"__{c}" for c in ops])


def block_reduce(df: DataFrame, how: str | dict[str, str], val: str = "val", idx: str = "idx", size: int = 256) -> DataFrame:
    """sum, min or max of each workgroup of ``size`` consecutive elements: (block, val).

    ``how`` may name the operation of several columns, which share one grouping.
    """
    ops = {val: how} if isinstance(how, str) else how
    agg = {"sum": F.sum, "min": F.min, "max": F.max}
    return df.groupBy(F.call_function("div", F.col(idx), F.lit(size).cast("bigint")).alias("block")).agg(*[agg[h](c).alias(c) for c, h in ops.items()])
