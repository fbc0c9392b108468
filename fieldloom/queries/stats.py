"""Reductions, norms, histograms and keyed aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import stats
from fieldloom.queries.common import cents, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _histogram_sql(source: str, bins: int, lo: str, hi: str) -> str:
    return f"""WITH v AS ({source}), r AS (SELECT a, CASE WHEN a = b THEN a + 1 ELSE b END AS b FROM (SELECT {lo} AS a, {hi} AS b FROM v)),
    p AS (SELECT greatest(0, least({bins - 1}, trunc((x - a) * {bins}.0 / (b - a))::BIGINT))::BIGINT AS bin, count(*)::BIGINT AS cnt FROM v, r GROUP BY 1)
    SELECT k.range AS bin, a + k.range * ((b - a) / {bins}) AS lo, CASE WHEN k.range = {bins - 1} THEN b ELSE a + (k.range + 1) * ((b - a) / {bins}) END AS hi, coalesce(cnt, 0)::BIGINT AS cnt
    FROM range({bins}) k CROSS JOIN r LEFT JOIN p ON p.bin = k.range"""


@query(_histogram_sql("SELECT l_extendedprice * (1.0 - l_discount) AS x FROM lineitem", 10, "min(x)", "max(x)"))
def histogram_revenue(spark, d):
    rev = table(spark, d, "lineitem").select((F.col("l_extendedprice") * (1.0 - F.col("l_discount"))).alias("val"))
    return stats.histogram(rev, "val", 10)


@query(_histogram_sql("SELECT value AS x FROM events", 10, "min(x)", "max(x)"))
def histogram_auto(spark, d):
    return stats.histogram(table(spark, d, "events"), "value", 10)


@query(_histogram_sql("SELECT value AS x FROM events", 8, "max(100.0::DOUBLE)", "max(300.0::DOUBLE)"))
def histogram_clamped(spark, d):
    return stats.histogram(table(spark, d, "events"), "value", 8, (100.0, 300.0))


@query("SELECT sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS sum, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 6) AS mean FROM lineitem")
def field_sum_min_max_mean(spark, d):
    x = "l_extendedprice"
    return table(spark, d, "lineitem").agg(F.sum(cents(x)).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.avg(x), 6).alias("mean"))


@query("SELECT round(var_pop(l_quantity), 6) AS var, round(stddev_pop(l_quantity), 6) AS std FROM lineitem")
def var_std(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.var_pop("l_quantity"), 6).alias("var"), F.round(F.stddev_pop("l_quantity"), 6).alias("std"))


@query("SELECT round(sum(abs(c_acctbal)), 2) AS l1, round(sqrt(sum(c_acctbal * c_acctbal)), 4) AS l2, max(abs(c_acctbal)) AS linf FROM customer")
def norms(spark, d):
    n = lambda o: stats.norm_of("c_acctbal", o)
    return table(spark, d, "customer").agg(F.round(n(1), 2).alias("l1"), F.round(n(2), 4).alias("l2"), n(float("inf")).alias("linf"))


@query("SELECT coalesce(max(abs(c_acctbal)), 0.0) AS absmax, coalesce(max(abs(c_acctbal)) FILTER (c_acctbal > 1e18), 0.0) AS empty FROM customer")
def absmax(spark, d):
    return table(spark, d, "customer").withColumn("none", F.when(F.col("c_acctbal") > 1e18, F.col("c_acctbal"))).agg(stats.absmax_of("c_acctbal").alias("absmax"), stats.absmax_of("none").alias("empty"))


@query("SELECT count(*) FILTER (l_discount <> 0)::BIGINT AS nonzero FROM lineitem")
def count_nonzero(spark, d):
    return table(spark, d, "lineitem").agg(stats.nonzero_of("l_discount").cast("bigint").alias("nonzero"))


@query("SELECT sum(l_quantity::BIGINT * round(l_extendedprice * 100)::BIGINT)::BIGINT AS dot FROM lineitem")
def dot(spark, d):
    return table(spark, d, "lineitem").agg(F.sum(F.col("l_quantity").cast("bigint") * cents("l_extendedprice")).alias("dot"))


@query("SELECT event_id // 256 AS block, sum(round(value * 100)::BIGINT)::BIGINT AS s, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def block_sum_256(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("idx"), cents("value").alias("s"), F.col("value").alias("lo"), F.col("value").alias("hi"))
    return stats.block_reduce(e, {"s": "sum", "lo": "min", "hi": "max"})


@query("""SELECT s_suppkey AS idx, round(s_acctbal * 100)::BIGINT + coalesce(q, 0)::BIGINT AS val FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def atomic_add_scatter(spark, d):
    base = table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), cents("s_acctbal").alias("val"))
    up = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("idx"), F.col("l_quantity").cast("bigint").alias("val"))
    return stats.keyed(base, up, "add")


@query("""SELECT s_suppkey AS idx, least(s_acctbal, lo) AS low, greatest(s_acctbal, hi) AS high FROM supplier LEFT JOIN (SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def atomic_minmax(spark, d):
    base = table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("low"), F.col("s_acctbal").alias("high"))
    up = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("idx"), F.col("l_extendedprice").alias("low"), F.col("l_extendedprice").alias("high"))
    return stats.keyed(base, up, {"low": "min", "high": "max"})


@query("SELECT " + ", ".join(f"{f}(embedding[{k + 1}])::DOUBLE AS {f}_{c}" for f in ("min", "max") for k, c in enumerate("xyz")) + " FROM embeddings")
def bounding_box(spark, d):
    from fieldloom.operators.mesh import bounds

    e = F.col("embedding")
    pts = table(spark, d, "embeddings").select(*[F.get(e, F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")])
    return bounds(pts)


@query("SELECT bit_or(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END | CASE WHEN l_linestatus = 'F' THEN 8 ELSE 0 END)::BIGINT AS mask, l_suppkey FROM lineitem GROUP BY l_suppkey")
def mask_bits(spark, d):
    m = F.when(F.col("l_returnflag") == "R", 1).otherwise(0).bitwiseOR(F.when(F.col("l_linestatus") == "F", 8).otherwise(0))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.bit_or(m).cast("bigint").alias("mask"))
