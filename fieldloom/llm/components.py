"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.store import Scratch


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, comp) of every vertex of edges (u, v): comp is the component's smallest vertex.

    Each round links neighbours to the smallest one (larger ones, then smaller ones), which keeps the number
    of edges and ends after a number of rounds that is logarithmic in a component's length.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.keep(f"{name}0", e)
    stamp, k = _stamp(e), 0
    while stamp[0]:
        k += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.unionByName(low.where("m <> u").select("u", F.col("m").alias("v"))).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = scratch.keep(f"{name}{k}", small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(f"{name}{k - 1}")
        if (new := _stamp(e)) == stamp:
            break
        stamp = new
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots)
