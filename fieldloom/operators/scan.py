"""Prefix sums and dense numbering without a single-task window.

Rows are dealt to blocks of ``BLOCK`` consecutive indices. A window scans each block; block totals, one row a
block, are scanned on their own and added back. Only the totals meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.scratch import materialized

BLOCK = 65_536


def block_of(idx: Column, size: int = BLOCK) -> Column:
    return F.call_function("div", idx.cast("bigint"), F.lit(size).cast("bigint"))


def _offsets(totals: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("__before", F.coalesce(F.sum("__total").over(w), F.lit(0))).select(*keys, "__block", "__before")


def inclusive_scan(df: DataFrame, val: str = "val", idx: str = "idx", by: list[str] | None = None, block: int = BLOCK, out: str = "scan") -> DataFrame:
    """Running sums of an integer column in index order, within the groups of ``by`` if given."""
    by = by or []
    rows = df.withColumn("__block", block_of(F.col(idx), block))
    totals = rows.groupBy(*by, "__block").agg(F.sum(F.col(val).cast("bigint")).alias("__total"))
    inside = F.sum(F.col(val).cast("bigint")).over(Window.partitionBy(*by, "__block").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0))
    scanned = rows.withColumn(out, inside).join(_offsets(totals, by), [*by, "__block"])
    return scanned.withColumn(out, F.col(out) + F.col("__before")).select(*df.columns, out)


def exclusive_scan(df: DataFrame, val: str = "val", idx: str = "idx", by: list[str] | None = None, block: int = BLOCK, out: str = "scan") -> DataFrame:
    """Sums of all before each row; the first has 0."""
    got = inclusive_scan(df, val, idx, by, block, out)
    return got.withColumn(out, F.col(out) - F.col(val).cast("bigint"))


def total(df: DataFrame, val: str = "val") -> int:
    """What a scan returns; 0 for an empty field."""
    return int(df.agg(F.coalesce(F.sum(F.col(val).cast("bigint")), F.lit(0))).first()[0])


def dense_index(df: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """Rows numbered 0 .. n-1 in the order of columns, which must be a total order for a fixed result.

    Rows are range-partitioned and sorted, as many partitions as the session shuffles to, and written with their place in
    their partition; partitions' sizes, one row each, are summed and added. A place is fixed once it is written.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # below the partition's number
    placed = materialized(dealt.withColumns({"__part": F.spark_partition_id(), "__k": place}))
    totals = placed.groupBy("__part").agg(F.count("*").alias("__total"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("__total").over(w), F.lit(0)).alias("__before"))
    got = placed.join(F.broadcast(offsets), "__part")  # a row a partition
    return got.withColumn(out, (F.col("__k") + F.col("__before")).cast("bigint")).drop("__part", "__k", "__before")


def compact(df: DataFrame, keep: Column, idx: str = "idx", block: int = BLOCK) -> DataFrame:
    """The rows that are kept, with their place among them as ``new_idx``: a filter and a blocked row number."""
    kept = df.where(keep).withColumn("one", F.lit(1))
    return exclusive_scan(kept, "one", idx, None, block, "new_idx").drop("one")
