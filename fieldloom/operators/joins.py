"""Gather, scatter, lookup, CSR expansion, as-of and overlap joins on indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.scratch import materialized


def gather(left: DataFrame, key: str, source: DataFrame, idx: str = "idx", val: str = "val", out: str = "gathered") -> DataFrame:
    """``source[left[key]]``; Spark picks broadcast or shuffle by the source's size."""
    return left.join(source.select(F.col(idx).alias(key), F.col(val).alias(out)), key)


def scatter(base: DataFrame, writes: DataFrame, key: str, val: str, order: str, idx: str = "idx", base_val: str = "val") -> DataFrame:
    """``base[key] = val``; of writes to one place the one with the highest ``order`` holds."""
    last = writes.groupBy(F.col(key).alias(idx)).agg(F.max_by(val, order).alias("__new"), F.lit(True).alias("__hit"))
    return base.join(last, idx, "left").withColumn(base_val, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(base_val))).drop("__new", "__hit")


def lookup(df: DataFrame, case: Column, table: list, out: str) -> DataFrame:
    """A constant table by case number, as an array literal."""
    return df.withColumn(out, F.get(F.array(*[F.lit(x) for x in table]), case.cast("int")))


def csr_expand(rows: DataFrame, start: str, stop: str, out: str = "k") -> DataFrame:
    """One row for each position from start up to stop; rows without one go."""
    return rows.where(F.col(start) < F.col(stop)).withColumn(out, F.explode(F.sequence(F.col(start), F.col(stop) - 1)))


def indirect(df: DataFrame, keys: list[tuple[str, DataFrame]], out: str) -> DataFrame:
    """``a[b[c[key]]]``: a chain of gathers, each (key column, (idx, val) frame), innermost first."""
    key, source = keys[0]
    got = gather(df, key, source, out=out)
    for _, source in keys[1:]:
        got = got.withColumnRenamed(out, "__k").join(source.select(F.col("idx").alias("__k"), F.col("val").alias(out)), "__k").drop("__k")
    return got


def asof_cell(points: DataFrame, pos: str, axis: DataFrame, coord: str = "coord", cell: str = "cell") -> DataFrame:
    """The cell (interval between neighbouring coordinates) of each position, clamped at the ends; a null position is in the first.

    Coordinates and positions are sorted together by range, and each position takes the last cell before it; a range that
    begins between two coordinates takes the last cell of the ranges before, one row each. However uneven the axis is, no
    cell meets more than its own positions. ``axis`` holds (cell, coord), cells numbered 0 .. n-1 in the order of coordinates.
    """
    n = axis.count()
    order = ["__p", "__kind", "__cell"]
    marks = axis.select(F.col(coord).cast("double").alias("__p"), F.lit(0).alias("__kind"), F.col(cell).alias("__cell"), F.lit(None).cast(points.schema).alias("__row"))
    rows = points.select(F.col(pos).cast("double").alias("__p"), F.lit(1).alias("__kind"), F.lit(None).cast(axis.schema[cell].dataType).alias("__cell"), F.struct("*").alias("__row"))
    dealt = marks.unionByName(rows).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt = materialized(dealt)
    ends = dealt.groupBy("__part").agg(F.max("__cell").alias("__end"))
    before = ends.select("__part", F.max("__end").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = F.last("__cell", ignorenulls=True).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = dealt.withColumn("__in", inside).where("__kind = 1").join(F.broadcast(before), "__part")  # a row a partition
    at = F.least(F.coalesce("__in", "__before", F.lit(0)), F.lit(n - 2)).cast(axis.schema[cell].dataType)
    return found.select("__row.*", at.alias(cell))


def nearest(points: DataFrame, pos: str, sites: DataFrame, site: str, coord: str, cost: str, out: str = "nearest") -> DataFrame:
    """The site of the least ``abs(pos - coord) + cost`` for each point, as a struct (total, site) in ``out``; NULL where the position is.

    Of the sites before a point the one of the least cost - coord is best, of those after it the one of the least cost + coord. Sites
    and points are sorted together by range and take the running best from both ends; ranges pass theirs on, one row each. Equal
    positions are dealt to several ranges, and of sites at one place the cheapest stays, so no task meets more than its share.
    Totals that differ by less than the rounding of ``coord`` count as equal.
    """
    at, kinds = F.col(coord).cast("double"), sites.schema
    found = F.min(F.struct(F.col(cost).alias("cost"), F.col(site).alias("site"))).alias("__best")
    cheapest = sites.where(F.col(coord).isNotNull() & F.col(cost).isNotNull() & F.col(site).isNotNull()).groupBy(at.alias("__p")).agg(found)
    order = ["__p", "__kind", "__tie"]
    marks = cheapest.select("__p", F.lit(0).alias("__kind"), F.lit(0).cast("bigint").alias("__tie"), "__best", F.lit(None).cast(points.schema).alias("__row"))
    none = F.lit(None).cast(f"struct<cost: {kinds[cost].dataType.simpleString()}, site: {kinds[site].dataType.simpleString()}>")
    rows = points.select(F.col(pos).cast("double").alias("__p"), F.lit(1).alias("__kind"), F.xxhash64(*points.columns).alias("__tie"), none.alias("__best"), F.struct("*").alias("__row"))
    dealt = materialized(marks.unionByName(rows).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    is_mark = F.col("__kind") == 0
    sides = {"__left": F.col("__best.cost") - F.col("__p"), "__right": F.col("__best.cost") + F.col("__p")}
    near = {"__left": -F.col("__p"), "__right": F.col("__p")}  # of equal ones the nearer
    held = dealt.withColumns({k: F.when(is_mark, F.struct(v.alias("by"), near[k].alias("near"), F.col("__p").alias("p"), F.col("__best.cost").alias("cost"), F.col("__best.site").alias("site"))) for k, v in sides.items()})
    ends = held.groupBy("__part").agg(*[F.min(k).alias(k) for k in sides])
    past = lambda *by: Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    beyond = ends.select("__part", F.min("__left").over(past("__part")).alias("__before"), F.min("__right").over(past(F.desc("__part"))).alias("__after"))
    inside = lambda *by: Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    run = held.withColumns({"__left": F.min("__left").over(inside(*order)), "__right": F.min("__right").over(inside(*[F.desc(c) for c in order]))})
    best = run.where(~is_mark).join(F.broadcast(beyond), "__part")  # a row a partition
    total = lambda c: F.when(c.isNotNull(), F.struct((F.abs(F.col("__p") - c["p"]) + c["cost"]).alias("total"), c["site"].alias("site")))
    best = best.withColumns({"__left": F.least("__left", "__before"), "__right": F.least("__right", "__after")})
    return best.select("__row.*", F.when(F.col("__p").isNotNull(), F.least(total(F.col("__left")), total(F.col("__right")))).alias(out))


def overlaps(a: DataFrame, b: DataFrame, a_id: str, b_id: str, axes: list[str], size: int) -> DataFrame:
    """Pairs of boxes (``lo_x, hi_x`` inclusive for each axis) that overlap, with the intersection.

    Boxes are copied to the grid cells of edge ``size`` that they meet; a pair is kept in the cell that holds its
    intersection's lower corner, so none repeats.
    """

    def celled(df: DataFrame, p: str) -> DataFrame:
        out = df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
        for x in axes:
            out = out.withColumn(f"cell_{x}", F.explode(F.sequence(F.floor(F.col(f"{p}lo_{x}") / size), F.floor(F.col(f"{p}hi_{x}") / size))))
        return out

    both = celled(a, "a_").join(celled(b, "b_"), [f"cell_{x}" for x in axes])
    for x in axes:
        both = both.withColumns({f"lo_{x}": F.greatest(f"a_lo_{x}", f"b_lo_{x}"), f"hi_{x}": F.least(f"a_hi_{x}", f"b_hi_{x}")})
        both = both.where((F.col(f"lo_{x}") <= F.col(f"hi_{x}")) & (F.floor(F.col(f"lo_{x}") / size) == F.col(f"cell_{x}")))
    return both.select(F.col(f"a_{a_id}").alias(a_id), F.col(f"b_{b_id}").alias(b_id), *[c for x in axes for c in (f"lo_{x}", f"hi_{x}")])


def product(*axes: tuple[DataFrame, str, str]) -> DataFrame:
    """Every combination of 1-D axes (frame, index, coordinate), first axis fastest, with its ``pt_id``.

    The product is the result asked for; its size is that of the grid.
    """
    out, stride, pt = None, 1, F.lit(0).cast("bigint")
    for df, idx, coord in axes:
        part = df.select(idx, coord)
        out = part if out is None else out.crossJoin(part)
        pt = pt + F.col(idx) * stride
        stride *= df.count()
    return out.withColumn("pt_id", pt)
