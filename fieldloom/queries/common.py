"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A total order of line items; the first two columns alone repeat.
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def grid(spark: SparkSession, *shape: int, names: str = "ijk") -> DataFrame:
    """idx and row-major subscripts of a generated grid."""
    from fieldloom.sources.field import unpack

    n = 1
    for s in shape:
        n *= s
    df = spark.range(n).select(F.col("id").alias("idx"))
    return df.select("idx", *[c.alias(d) for d, c in zip(names, unpack(F.col("idx"), shape), strict=False)])


def cents(c) -> F.Column:
    """A value of cent precision as an integer."""
    return F.round(F.col(c) * 100 if isinstance(c, str) else c * 100).cast("bigint")


def doubles(sql: str, *cols: str) -> str:
    """SQL whose decimal literals are to come out as DOUBLE."""
    return f"SELECT * REPLACE ({', '.join(f'{c}::DOUBLE AS {c}' for c in cols)}) FROM ({sql})"
