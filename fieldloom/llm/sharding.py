"""Sharding by extendible hashing.

A row's hash is the first 60 bits of MD5 of its key. The directory is indexed by hash-prefix bits; a bucket that
exceeds the byte limit splits on one more bit, others stay. So a bucket's depth is the smallest at which its
prefix's bytes fit. Sums of all depths come from one pre-aggregated table of prefixes of ``STEP`` bits; only
what still exceeds the limit there goes on to the next ``STEP`` bits.

Defined results: a null text has 0 bytes; a null key hashes as the empty string; a bucket that holds one
hash alone (one large row, or repeated keys) cannot split and is marked ``oversize``; rows stay whole; an empty
table has no shards; columns other than key and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.store import Scratch

BITS, STEP = 60, 12


def hashed(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth: int) -> Column:
    """The first ``depth`` bits of a hash."""
    return F.shiftright(h, BITS - depth)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """From (h, bytes): buckets (depth, prefix, bytes, rows, oversize)."""
    scratch = Scratch(rows.sparkSession, "sharding")
    found: list[DataFrame] = []
    left, low = rows, 0
    while low < BITS:
        high = min(BITS, low + STEP)
        fine = left.groupBy(prefix(F.col("h"), high).alias("p")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        fine = scratch.keep(f"fine{low}", fine)
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(low + (low > 0)), F.lit(high)))).withColumn("prefix", F.expr(f"shiftright(p, cast({high} - depth as int))"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("h0").alias("h0"), F.max("h1").alias("h1"))
        sums = sums.withColumn("done", (F.col("bytes") <= limit) | (F.col("h0") == F.col("h1")))
        sums = scratch.keep(f"sums{low}", sums)
        # a bucket is final where it is done and its parent is not
        parents = sums.where("not done").select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        first = low + (low > 0)
        tops = sums.where(F.col("depth") == first)
        nexts = sums.where(F.col("depth") > first).join(parents, ["depth", "prefix"], "left_semi")
        active = tops.unionByName(nexts)
        found.append(active.where("done"))
        open_ = active.where(f"not done and depth = {high}").select("prefix")
        if high == BITS or open_.isEmpty():
            break
        left = rows.join(open_, prefix(F.col("h"), high) == F.col("prefix"), "left_semi")
        low = high
    out = reduce(DataFrame.unionByName, found)
    return scratch.keep("directory", out.select("depth", "prefix", "bytes", "rows", (F.col("bytes") > limit).alias("oversize")))


def assign(df: DataFrame, limit: int, key_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: key, bytes, depth, shard), (directory). A shard's name is its prefix in binary, ``-`` for the whole.

    The directory joins once for each depth in use, on the prefix; a row matches in exactly one.
    """
    rows = df.select(F.col(key_col), hashed(F.col(key_col)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    buckets = directory(rows.select("h", "bytes"), limit)
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())
    tried = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]) if depths else F.array().cast("array<int>")))
    tried = tried.withColumn("prefix", F.expr(f"shiftright(h, cast({BITS} - depth as int))"))
    placed = tried.join(buckets.select("depth", "prefix", "oversize"), ["depth", "prefix"])
    name = F.when(F.col("depth") == 0, "-").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return placed.select(key_col, "bytes", "depth", name.alias("shard"), "oversize"), buckets
