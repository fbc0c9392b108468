"""Adaptive-mesh masks: ghost cells and cells that a finer level covers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.joins import overlaps

#: Bits of the mask.
DUPLICATE, REFINED = 1, 8


def coarsen(v: Column, ratio: Column | int) -> Column:
    """An index at the coarser level; floor division for either sign."""
    r = F.lit(ratio) if isinstance(ratio, int) else ratio
    q = lambda a: F.call_function("div", a.cast("bigint"), r.cast("bigint"))
    return F.when(v >= 0, q(v)).otherwise(-q(F.abs(v + 1)) - 1)


def build_masks(blocks: DataFrame, ratios: list[int], ghosts: DataFrame | None = None, size: int = 32) -> DataFrame:
    """(level, block_id, cell_id, mask), one row for each marked cell; others have mask 0.

    ``blocks``: level, block_id, lo_x .. hi_z (inclusive, valid region), n_x, n_y, n_z (cells with ghosts), ng_x .. (ghosts
    before the valid region). ``ghosts``: level, block_id, cell_id, flag. Boxes meet their parents in a grid-bucketed
    join; covered cells are exploded from the intersections and their bits OR-ed.
    """
    marks = []
    for level, ratio in enumerate(ratios):
        parents = blocks.where(F.col("level") == level)
        child = blocks.where(F.col("level") == level + 1).select(F.col("block_id").alias("child"), *[coarsen(F.col(f"{e}_{d}"), ratio).alias(f"{e}_{d}") for d in "xyz" for e in ("lo", "hi")])
        own = parents.select(F.col("block_id").alias("parent"), *[F.col(f"{e}_{d}") for d in "xyz" for e in ("lo", "hi")])
        hit = overlaps(own, child, "parent", "child", list("xyz"), size)
        box = parents.select(F.col("block_id").alias("parent"), *[F.col(f"lo_{d}").alias(f"b_{d}") for d in "xyz"], *[f"n_{d}" for d in "xyz"], *[f"ng_{d}" for d in "xyz"])
        at = hit.join(box, "parent")
        for d in "xyz":
            at = at.withColumn(f"l_{d}", F.explode(F.sequence(F.col(f"lo_{d}"), F.col(f"hi_{d}")))).withColumn(f"l_{d}", F.col(f"l_{d}") - F.col(f"b_{d}") + F.col(f"ng_{d}"))
        inside = reduce(lambda a, b: a & b, [(F.col(f"l_{d}") >= 0) & (F.col(f"l_{d}") < F.col(f"n_{d}")) for d in "xyz"])
        cell = (F.col("l_z") * F.col("n_y") + F.col("l_y")) * F.col("n_x") + F.col("l_x")
        marks.append(at.where(inside).select(F.lit(level).alias("level"), F.col("parent").alias("block_id"), cell.cast("bigint").alias("cell_id"), F.lit(REFINED).alias("mask")))
    if ghosts is not None:
        marks.append(ghosts.where(F.col("flag").bitwiseAND(F.lit(DUPLICATE)) != 0).select("level", "block_id", F.col("cell_id").cast("bigint").alias("cell_id"), F.lit(DUPLICATE).alias("mask")))
    both = reduce(DataFrame.unionByName, marks)
    return both.groupBy("level", "block_id", "cell_id").agg(F.bit_or("mask").alias("mask"))
