"""Element-wise projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import bits, ieee, types as ty
from fieldloom.queries.common import LINE_KEYS, cents, doubles, grid, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


KEYS = ", ".join(LINE_KEYS)


@query(f"SELECT {KEYS}, 2.0::DOUBLE * l_quantity + l_extendedprice AS y FROM lineitem")
def saxpy(spark, d):
    return table(spark, d, "lineitem").select(*LINE_KEYS, (2.0 * F.col("l_quantity") + F.col("l_extendedprice")).alias("y"))


@query("SELECT event_id, value AS copied, 1.5::DOUBLE * value AS scaled, 1.5::DOUBLE * value + 2 AS affine FROM events")
def memcpy_scale_affine(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", v.alias("copied"), (1.5 * v).alias("scaled"), (1.5 * v + 2.0).alias("affine"))


@query("""SELECT event_id, greatest(0.0, least(value - 100.0, 50.0))::DOUBLE AS clamped, CASE WHEN value > 250 THEN value - 250 ELSE 0.0 END::DOUBLE AS relu,
    10.0 + (20.0 - 10.0) * (value / 500.0) AS lerped, t * t * (3.0 - 2.0 * t) AS smooth, -1.0 + (value - 0.0) * 2.0 / 500.0 AS remapped
    FROM (SELECT *, greatest(0.0, least(1.0, (value - 100.0) / 300.0))::DOUBLE AS t FROM events)""")
def clamp_relu(spark, d):
    v = F.col("value")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - 100.0) / 300.0))
    return table(spark, d, "events").withColumn("t", t).select(
        "event_id",
        F.greatest(F.lit(0.0), F.least(v - 100.0, F.lit(50.0))).alias("clamped"),
        F.when(v > 250, v - 250.0).otherwise(0.0).alias("relu"),
        (10.0 + (20.0 - 10.0) * (v / 500.0)).alias("lerped"),
        (F.col("t") * F.col("t") * (3.0 - 2.0 * F.col("t"))).alias("smooth"),
        (-1.0 + (v - 0.0) * 2.0 / 500.0).alias("remapped"),
    )


@query(f"""SELECT {KEYS}, ((0 - l_partkey) // 7)::BIGINT AS quot, ((0 - l_partkey) % 7)::BIGINT AS rem, (l_partkey::BIGINT << 3)::BIGINT AS shl, (l_partkey::BIGINT >> 2)::BIGINT AS shr,
    (l_partkey & l_suppkey)::BIGINT AS band, (l_partkey | l_suppkey)::BIGINT AS bor, xor(l_partkey, l_suppkey)::BIGINT AS bxor, (~l_partkey)::BIGINT AS bnot, (l_linenumber * l_linenumber)::BIGINT AS squared FROM lineitem""")
def int_ops(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, d, "lineitem").select(
        *LINE_KEYS,
        ieee.idiv(-p, 7).alias("quot"), ieee.irem(-p, 7).alias("rem"), F.shiftleft(p, 3).alias("shl"), F.shiftright(p, 2).alias("shr"),
        p.bitwiseAND(s).alias("band"), p.bitwiseOR(s).alias("bor"), p.bitwiseXOR(s).alias("bxor"), F.bitwise_not(p).alias("bnot"),
        F.pow(F.col("l_linenumber"), 2).cast("bigint").alias("squared"),
    )


@query(f"""SELECT {KEYS}, trunc(l_extendedprice)::BIGINT AS as_i64, (trunc(l_extendedprice)::BIGINT & 255)::BIGINT AS as_u8, (((trunc(l_extendedprice)::BIGINT & 255) + 128) % 256 - 128)::BIGINT AS as_i8,
    (trunc(0 - l_extendedprice)::BIGINT & 65535)::BIGINT AS as_u16, l_extendedprice::FLOAT::DOUBLE AS as_f32 FROM lineitem""")
def casts(spark, d):
    x = F.col("l_extendedprice")
    to = lambda c, t: ty.cast(c, t, ty.f64).cast("bigint")
    return table(spark, d, "lineitem").select(*LINE_KEYS, to(x, ty.i64).alias("as_i64"), to(x, ty.u8).alias("as_u8"), to(x, ty.i8).alias("as_i8"), to(-x, ty.u16).alias("as_u16"), ty.cast(x, ty.f32, ty.f64).cast("double").alias("as_f32"))


_UNIT = "(p_retailprice / 4000.0)"


@query(f"""SELECT p_partkey, round(sqrt(x), 9) AS sqrt_, round(sin(x), 9) AS sin_, round(cos(x), 9) AS cos_, round(tan(x), 9) AS tan_, round(asin(u), 9) AS asin_, round(acos(u), 9) AS acos_, round(atan(x), 9) AS atan_,
    round(atan2(x, 2.0), 9) AS atan2_, round(exp(u), 9) AS exp_, round(pow(2.0, u), 9) AS exp2_, round(ln(x), 9) AS log_, round(log2(x), 9) AS log2_, round(log10(x), 9) AS log10_, floor(x)::DOUBLE AS floor_,
    ceil(x)::DOUBLE AS ceil_, abs(0.0 - x) AS abs_, least(x, 1000.0)::DOUBLE AS min_, greatest(x, 1000.0)::DOUBLE AS max_, round(pow(u, 0.4545), 9) AS pow_ FROM (SELECT p_partkey, p_retailprice AS x, least(1.0, {_UNIT})::DOUBLE AS u FROM part)""")
def math_builtins(spark, d):
    x, u = F.col("x"), F.col("u")
    df = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("x"), F.least(F.lit(1.0), F.col("p_retailprice") / 4000.0).alias("u"))
    r = lambda c, n: F.round(c, 9).alias(n)
    return df.select(
        "p_partkey", r(F.sqrt(x), "sqrt_"), r(F.sin(x), "sin_"), r(F.cos(x), "cos_"), r(F.tan(x), "tan_"), r(F.asin(u), "asin_"), r(F.acos(u), "acos_"), r(F.atan(x), "atan_"),
        r(F.atan2(x, F.lit(2.0)), "atan2_"), r(F.exp(u), "exp_"), r(ieee.exp2(u), "exp2_"), r(ieee.log(x), "log_"), r(ieee.log2(x), "log2_"), r(ieee.log10(x), "log10_"), F.floor(x).cast("double").alias("floor_"),
        F.ceil(x).cast("double").alias("ceil_"), F.abs(0.0 - x).alias("abs_"), ieee.fmin(x, F.lit(1000.0)).alias("min_"), ieee.fmax(x, F.lit(1000.0)).alias("max_"), r(F.pow(u, 0.4545), "pow_"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END::BIGINT AS tier,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 0.5 ELSE o_totalprice END AS guarded, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey ELSE o_custkey END AS a, CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE o_orderkey END AS b FROM orders""")
def ternary_predicated(spark, d):
    p, even = F.col("o_totalprice"), F.col("o_custkey") % 2 == 0
    return table(spark, d, "orders").select(
        "o_orderkey", F.when(p > 200000, 2).when(p > 100000, 1).otherwise(0).cast("bigint").alias("tier"), F.when(F.col("o_orderstatus") == "F", p * 0.5).otherwise(p).alias("guarded"),
        F.when(even, F.col("o_orderkey")).otherwise(F.col("o_custkey")).alias("a"), F.when(even, F.col("o_custkey")).otherwise(F.col("o_orderkey")).alias("b"),
    )


@query("SELECT range AS idx, (range // 48)::BIGINT AS i, (range % 48)::BIGINT AS j, (range // 48 * 100 + range % 48)::BIGINT AS code FROM range(64 * 48)")
def ndrange_unpack(spark, d):
    return grid(spark, 64, 48).withColumn("code", F.col("i") * 100 + F.col("j"))


@query("SELECT range AS idx, ((range // 32 + range % 32) % 2)::BIGINT AS dark FROM range(32 * 32)")
def checkerboard(spark, d):
    return grid(spark, 32, 32).select("idx", ((F.col("i") + F.col("j")) % 2).alias("dark"))


@query("SELECT range AS idx, round(sqrt(pow(range // 32 - 15.5, 2) + pow(range % 32 - 15.5, 2)), 9) AS dist FROM range(32 * 32)")
def distance_field(spark, d):
    return grid(spark, 32, 32).select("idx", F.round(F.sqrt(F.pow(F.col("i") - 15.5, 2) + F.pow(F.col("j") - 15.5, 2)), 9).alias("dist"))


@query("""SELECT range AS idx, round(sin(x) * cos(y) + sin(y) * cos(z) + sin(z) * cos(x), 9) AS gyroid, round(1.0 - (x * x + y * y + z * z), 9) AS sphere, round(z, 9) AS plane
    FROM (SELECT range, (range % 12) * 0.5 AS x, (range // 12 % 12) * 0.5 AS y, (range // 144) * 0.5 AS z FROM range(1728))""")
def gyroid_grid(spark, d):
    from fieldloom.sources import synthetic

    g = grid(spark, 12, 12, 12, names="kji").select("idx", (F.col("i") * 0.5).alias("x"), (F.col("j") * 0.5).alias("y"), (F.col("k") * 0.5).alias("z"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return g.select("idx", F.round(synthetic.gyroid(x, y, z), 9).alias("gyroid"), F.round(synthetic.sphere(x, y, z, 1.0), 9).alias("sphere"), F.round(z.cast("double"), 9).alias("plane"))


@query("SELECT event_id, round(least(1.0, greatest(0.0, value / 490.0 * 1.2 + 0.1)), 9) AS bright, round(pow(least(value / 490.0, 1.0), 0.4545), 9) AS gamma FROM events")
def brightness_gamma(spark, d):
    v = F.col("value") / 490.0
    return table(spark, d, "events").select("event_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v * 1.2 + 0.1)), 9).alias("bright"), F.round(F.pow(F.least(v, F.lit(1.0)), 0.4545), 9).alias("gamma"))


@query("""SELECT range AS idx, round(h2, 12) AS halton2, round(h3, 12) AS halton3 FROM (SELECT range, list_sum(list_transform(range(20), lambda k: ((range + 1) // pow(2, k)::BIGINT % 2)::DOUBLE / pow(2.0, k + 1))) AS h2,
    list_sum(list_transform(range(20), lambda k: ((range + 1) // pow(3, k)::BIGINT % 3)::DOUBLE / pow(3.0, k + 1))) AS h3 FROM range(1000))""")
def halton(spark, d):
    i = F.col("id")
    return spark.range(1000).select(i.alias("idx"), F.round(bits.halton(i, 2), 12).alias("halton2"), F.round(bits.halton(i, 3), 12).alias("halton3"))


_W = lambda e: "(((((" + e + ") & 4294967295) + 2147483648) % 4294967296) - 2147483648)"


@query(f"""WITH a AS (SELECT range AS idx, xor(xor(range * 7919, 61), (range * 7919) >> 16)::BIGINT AS x FROM range(1000)),
    b AS (SELECT idx, {_W("x + x * 8")}::BIGINT AS x FROM a), c AS (SELECT idx, xor(x, (x - (x & 15)) // 16)::BIGINT AS x FROM b),
    e AS (SELECT idx, {_W("(x::HUGEINT * 668265261) % 4294967296 + 4294967296")}::BIGINT AS x FROM c)
    SELECT idx, abs(xor(x, (x - (x & 32767)) // 32768))::BIGINT AS h FROM e""")
def pixel_hash(spark, d):
    return spark.range(1000).select(F.col("id").alias("idx"), bits.pixel_hash(F.col("id") * 7919).alias("h"))


@query("SELECT event_id, (round(value * 100) / 0.0 = 'Infinity'::DOUBLE) AS div_inf, isnan(0.0::DOUBLE / 0.0) AS div_nan, (-value / 0.0 = '-Infinity'::DOUBLE) AS div_neg, isinf(ln(0.0)) AS log_zero FROM events")
def ieee_edges(spark, d):
    z, inf = F.lit(0.0), F.lit(float("inf"))
    return table(spark, d, "events").select(
        "event_id", (ieee.fdiv(cents("value"), z) == inf).alias("div_inf"), F.isnan(ieee.fdiv(z, z)).alias("div_nan"), (ieee.fdiv(-F.col("value"), z) == -inf).alias("div_neg"), (ieee.log(z) == -inf).alias("log_zero")
    )


ORACLES["gyroid_grid"] = doubles(ORACLES["gyroid_grid"], "sphere", "plane")
