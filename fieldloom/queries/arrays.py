"""Scans, compaction, sorting, joins by index, set operations, vectors, stencils."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import bits, vectors as vec
from fieldloom.operators import joins, scan, stencil
from fieldloom.queries.common import LINE_KEYS, cents, doubles, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("idx"), cents("value").alias("val"), "user_id", "value")


_E = "(SELECT event_id AS idx, round(value * 100)::BIGINT AS val, user_id, value FROM events)"


@query(f"SELECT idx, val, sum(val) OVER (ORDER BY idx)::BIGINT AS scan FROM {_E}")
def inclusive_scan(spark, d):
    return scan.inclusive_scan(_events(spark, d).select("idx", "val"), block=4096)


@query(f"SELECT idx, val, (sum(val) OVER (ORDER BY idx) - val)::BIGINT AS scan FROM {_E}")
def exclusive_scan(spark, d):
    return scan.exclusive_scan(_events(spark, d).select("idx", "val"), block=4096)


@query(f"SELECT idx, user_id, val, sum(val) OVER (PARTITION BY user_id ORDER BY idx)::BIGINT AS scan FROM {_E}")
def segmented_scan(spark, d):
    return scan.inclusive_scan(_events(spark, d).select("idx", "user_id", "val"), by=["user_id"], block=4096)


_LK = ", ".join(LINE_KEYS)


@query(f"SELECT {_LK}, row_number() OVER (ORDER BY {_LK}) - 1 AS new_idx FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def threshold_compact(spark, d):
    kept = table(spark, d, "lineitem").where(F.col("l_quantity").between(10, 20)).select(*LINE_KEYS)
    return scan.dense_index(kept, LINE_KEYS, "new_idx")


@query(f"SELECT idx, (value >= 100 AND value <= 300)::BIGINT AS mask, CASE WHEN value >= 100 AND value <= 300 THEN sum((value >= 100 AND value <= 300)::BIGINT) OVER (ORDER BY idx) - 1 ELSE -1 END::BIGINT AS new_idx FROM {_E}")
def classify_mask(spark, d):
    e = _events(spark, d).select("idx", F.col("value").between(100, 300).cast("bigint").alias("mask"))
    return scan.inclusive_scan(e, "mask", block=4096).select("idx", "mask", F.when(F.col("mask") == 1, F.col("scan") - 1).otherwise(-1).alias("new_idx"))


@query(f"SELECT {_LK}, p_retailprice AS gathered FROM lineitem JOIN part ON p_partkey = l_partkey")
def gather(spark, d):
    return joins.gather(table(spark, d, "lineitem").select(*LINE_KEYS), "l_partkey", table(spark, d, "part"), "p_partkey", "p_retailprice")


@query("""SELECT s_suppkey AS idx, coalesce(v, s_acctbal) AS val FROM supplier LEFT JOIN (SELECT l_suppkey, arg_max(l_extendedprice, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber + l_extendedprice / 1e9) AS v FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def scatter_last(spark, d):
    base = table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("val"))
    order = F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber") + F.col("l_extendedprice") / 1e9
    return joins.scatter(base, table(spark, d, "lineitem").withColumn("o", order), "l_suppkey", "l_extendedprice", "o")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 10 WHEN 'O' THEN 20 ELSE 30 END::BIGINT AS code FROM orders")
def lookup_table(spark, d):
    case = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return joins.lookup(table(spark, d, "orders"), case, [10, 20, 30], "code").select("o_orderkey", F.col("code").cast("bigint").alias("code"))


@query("SELECT conv_id, k, (k * 2)::BIGINT AS dof FROM (SELECT conv_id, unnest(range(a, b)) AS k FROM (SELECT conv_id, min(turn) AS a, max(turn) + 1 AS b FROM conversations GROUP BY 1))")
def csr_expand(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("a"), (F.max("turn") + 1).alias("b"))
    return joins.csr_expand(rows, "a", "b").select("conv_id", "k", (F.col("k") * 2).alias("dof"))


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, c_acctbal AS bal FROM lineitem l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey")
def double_indirection(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("val"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("val"))
    return joins.indirect(table(spark, d, "lineitem").select(*LINE_KEYS), [("l_orderkey", o), ("", c)], "bal")


@query("SELECT s_suppkey AS idx, s_acctbal AS val FROM supplier UNION ALL SELECT c_custkey + (SELECT count(*) FROM supplier), c_acctbal FROM customer")
def concat_rebased(spark, d):
    from fieldloom.functions.types import f64
    from fieldloom.sources.field import concat, of_frame

    s = of_frame(table(spark, d, "supplier"), "s_acctbal", "s_suppkey", f64)
    c = of_frame(table(spark, d, "customer"), "c_acctbal", "c_custkey", f64)
    return concat([s, c]).df


@query("SELECT p_brand AS material, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS id FROM part GROUP BY p_brand")
def distinct_first_seen(spark, d):
    first = table(spark, d, "part").groupBy(F.col("p_brand").alias("material")).agg(F.min("p_partkey").alias("first"))
    return scan.dense_index(first, ["first"], "id").select("material", "id")


_Q = "greatest(0.0, least(1023.0, (embedding[{0}]::DOUBLE * 0.5 + 0.5) * 1024.0))::DOUBLE"
_SPREAD = lambda e: "(" + " | ".join(f"((({e} >> {k}) & 1) << {3 * k})" for k in range(10)) + ")"


@query(f"""WITH q AS (SELECT vec_id, trunc({_Q.format(1)})::BIGINT AS x, trunc({_Q.format(2)})::BIGINT AS y, trunc({_Q.format(3)})::BIGINT AS z FROM embeddings),
    m AS (SELECT vec_id, (({_SPREAD("x")} << 2) | ({_SPREAD("y")} << 1) | {_SPREAD("z")})::BIGINT AS code FROM q) SELECT vec_id, code, row_number() OVER (ORDER BY code, vec_id) - 1 AS place FROM m""")
def argsort_morton(spark, d):
    e = F.col("embedding")
    c = [F.get(e, F.lit(k)).cast("double") * 0.5 + 0.5 for k in range(3)]
    codes = table(spark, d, "embeddings").select("vec_id", bits.morton(*c).alias("code"))
    return scan.dense_index(codes, ["code", "vec_id"], "place")


@query("""SELECT p_partkey, arg_min(s_suppkey, abs(p_retailprice - s_acctbal) + s_suppkey / 1e9) AS s_suppkey FROM part, supplier GROUP BY 1""")
def closest(spark, d):
    """Nearest supplier by balance, and of equal ones the first: suppliers and parts in one order, the best so far from both ends."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("x"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("y"), (F.col("s_suppkey") / 1e9).alias("cost"))
    if s.isEmpty():  # no pair
        p = p.limit(0)
    found = joins.nearest(p, "x", s, "s_suppkey", "y", "cost")
    return found.groupBy("p_partkey").agg(F.min("nearest")["site"].alias("s_suppkey"))


@query("""WITH b AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, 1.0 + label AS m FROM embeddings), p AS (SELECT a.id, o.x - a.x AS dx, o.y - a.y AS dy, o.z - a.z AS dz, a.m * o.m AS mm FROM b a, b o),
    q AS (SELECT *, dx * dx + dy * dy + dz * dz + 0.01 AS r2 FROM p) SELECT id, round(sum(mm / (r2 * sqrt(r2)) * dx), 4) AS fx, round(sum(mm / (r2 * sqrt(r2)) * dy), 4) AS fy, round(sum(mm / (r2 * sqrt(r2)) * dz), 4) AS fz FROM q GROUP BY id""")
def nbody_forces(spark, d):
    e = F.col("embedding")
    b = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[F.get(e, F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")], (1.0 + F.col("label")).alias("m"))
    out = stencil.nbody_forces(b)
    return out.select("id", *[F.round(f"f{c}", 4).alias(f"f{c}") for c in "xyz"])


@query("""WITH e AS (SELECT vec_id AS i, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT a.k AS i, b.k AS j, round(sum(a.v * b.v), 4) AS val FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2""")
def matmul(spark, d):
    """The transposed embeddings times the embeddings (64 x 64)."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "val"))
    a = e.select(F.col("c").cast("bigint").alias("i"), F.col("r").alias("k"), "val")
    b = e.select(F.col("r").alias("k"), F.col("c").cast("bigint").alias("j"), "val")
    return stencil.matmul(a, b).withColumn("val", F.round("val", 4))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS sqr, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm,
    round(e[2] * e[6] - e[3] * e[5], 9) AS cx, round(e[3] * e[4] - e[1] * e[6], 9) AS cy, round(e[1] * e[5] - e[2] * e[4], 9) AS cz, round(e[1] / sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3]), 9) AS nx, round((e[1] + e[4]) * (label + 1), 9) AS ax, round((e[1] - e[4]) / 2.0, 9) AS sx FROM v""")
def vec_dot_norm_cross_normalized(spark, d):
    e = vec.doubles(F.col("embedding"))
    a, b = F.slice("e", 1, 3), F.slice("e", 4, 3)
    df = table(spark, d, "embeddings").select("vec_id", "label", e.alias("e")).withColumns({"a": a, "b": b}).withColumn("c", vec.cross(F.col("a"), F.col("b")))
    x0 = lambda v: F.round(F.get(v, F.lit(0)), 9)
    A, B = F.col("a"), F.col("b")
    return df.select(
        "vec_id", F.round(vec.dot(F.col("e"), F.col("e")), 6).alias("sqr"), F.round(vec.norm(F.col("e")), 6).alias("norm"), *[F.round(F.get("c", F.lit(k)), 9).alias(n) for k, n in enumerate(("cx", "cy", "cz"))],
        x0(vec.normalized(A)).alias("nx"), x0(vec.scale(vec.add(A, B), F.col("label") + 1)).alias("ax"), x0(vec.div(vec.sub(A, B), 2.0)).alias("sx"),
    )


@query("""SELECT vec_id, idx, round(val, 9) AS val FROM (SELECT vec_id, (vec_id * 64 + unnest(range(64)))::BIGINT AS idx, unnest(embedding)::DOUBLE AS val FROM embeddings)""")
def vector_interleave(spark, d):
    from fieldloom.sources.field import from_tuples

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("val"))
    out = from_tuples(e, 64)
    return out.select(F.call_function("div", "idx", F.lit(64).cast("bigint")).alias("vec_id"), "idx", F.round(F.col("val").cast("double"), 9).alias("val"))


_AXIS = "(SELECT range AS cell, 10.0 * range + (range % 3) AS coord FROM range(50))"


@query(f"SELECT event_id, a.cell FROM events, (SELECT x.cell, x.coord AS l, y.coord AS r FROM {_AXIS} x JOIN {_AXIS} y ON y.cell = x.cell + 1) a WHERE greatest(0.0, least(491.0, value)) >= l AND (greatest(0.0, least(491.0, value)) < r OR (a.cell = 48 AND greatest(0.0, least(491.0, value)) <= r))")
def asof_cell(spark, d):
    axis = spark.range(50).select(F.col("id").alias("cell"), (F.col("id") * 10.0 + F.col("id") % 3).alias("coord"))
    return joins.asof_cell(table(spark, d, "events").select("event_id", "value"), "value", axis).select("event_id", "cell")


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, least(99, cell) AS cell FROM lineitem l ASOF JOIN (SELECT range AS cell, CASE WHEN range = 0 THEN 0.0 ELSE pow(1.13, range) END::DOUBLE AS coord FROM range(101)) a ON l.l_extendedprice::DOUBLE >= a.coord")
def asof_uneven(spark, d):
    """Intervals that grow by a factor: most lie below all positions."""
    axis = spark.range(101).select(F.col("id").alias("cell"), F.when(F.col("id") == 0, 0.0).otherwise(F.pow(F.lit(1.13), F.col("id"))).alias("coord"))
    return joins.asof_cell(table(spark, d, "lineitem").select(*LINE_KEYS), "l_extendedprice", axis)


_BOXES = """a AS (SELECT p_partkey AS a, p_partkey % 100 AS lx, p_partkey % 100 + p_size AS hx, p_partkey // 100 % 50 AS ly, p_partkey // 100 % 50 + 2 AS hy FROM part), b AS (SELECT s_suppkey AS b, s_suppkey % 40 * 3 AS lx, s_suppkey % 40 * 3 + 4 AS hx, s_suppkey // 4 AS ly, s_suppkey // 4 + 3 AS hy FROM supplier)"""


@query(f"WITH {_BOXES} SELECT a, b, greatest(a.lx, b.lx)::BIGINT AS lo_x, least(a.hx, b.hx)::BIGINT AS hi_x, greatest(a.ly, b.ly)::BIGINT AS lo_y, least(a.hy, b.hy)::BIGINT AS hi_y FROM a, b WHERE a.lx <= b.hx AND b.lx <= a.hx AND a.ly <= b.hy AND b.ly <= a.hy")
def box_overlap(spark, d):
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    q = lambda c, n: F.call_function("div", c, F.lit(n).cast("bigint"))
    a = table(spark, d, "part").select(p.alias("a"), (p % 100).alias("lo_x"), (p % 100 + F.col("p_size")).alias("hi_x"), (q(p, 100) % 50).alias("lo_y"), (q(p, 100) % 50 + 2).alias("hi_y"))
    b = table(spark, d, "supplier").select(s.alias("b"), (s % 40 * 3).alias("lo_x"), (s % 40 * 3 + 4).alias("hi_x"), q(s, 4).alias("lo_y"), (q(s, 4) + 3).alias("hi_y"))
    return joins.overlaps(a, b, "a", "b", ["x", "y"], 16)


@query(f"""SELECT idx, round(0.25 * lag(value) OVER w + 0.5 * value + 0.25 * lead(value) OVER w, 9) AS smooth, round(0.5 * (value + lead(value) OVER w), 9) AS mean2, round(0.5 * (lead(value) OVER w - lag(value) OVER w), 9) AS gradient FROM {_E} WINDOW w AS (ORDER BY idx)""")
def stencil_1d(spark, d):
    got = stencil.shifted(_events(spark, d).select("idx", "value"), "value", (-1, 1), block=1024)
    m, v, p = F.col("value_m1"), F.col("value"), F.col("value_p1")
    return got.select("idx", F.round(0.25 * m + 0.5 * v + 0.25 * p, 9).alias("smooth"), F.round(0.5 * (v + p), 9).alias("mean2"), F.round(0.5 * (p - m), 9).alias("gradient"))


@query(f"""SELECT idx, value AS prev, round(CASE WHEN idx > 0 AND idx < (SELECT count(*) - 1 FROM events) THEN 2.0 * value - 0.5 * value + 0.25 * (lag(value) OVER w - 2.0 * value + lead(value) OVER w) ELSE 0.0 END, 9) AS curr FROM {_E} WINDOW w AS (ORDER BY idx)""")
def wave_step(spark, d):
    e = _events(spark, d).select("idx", (0.5 * F.col("value")).alias("prev"), F.col("value").alias("curr"))
    return stencil.wave_step(e, e.count(), 0.25).withColumn("curr", F.round("curr", 9))


# the events as rows of 50
_G = "(SELECT event_id AS idx, event_id // 50 AS i, event_id % 50 AS j, value AS val FROM events)"
_H = "(SELECT count(*) // 50 FROM events)"


def _rows50(spark, d):
    """The grid (idx, i, j, val) and its shape."""
    e = table(spark, d, "events").select(F.col("event_id").alias("idx"), F.expr("event_id div 50").alias("i"), (F.col("event_id") % 50).alias("j"), F.col("value").alias("val"))
    return e, (e.count() // 50, 50)


def _nb(*cells: tuple[int, int, float]) -> str:
    return " + ".join(f"{w} * coalesce((SELECT n.val FROM g n WHERE n.i = g.i + ({a}) AND n.j = g.j + ({b})), 0)" for a, b, w in cells)


_IN = f"g.i BETWEEN 1 AND {_H} - 2 AND g.j BETWEEN 1 AND 48"
_BOX = [(a, b, 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1)]
_CROSS = [(-1, 0, 1.0), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0)]


@query(f"WITH g AS {_G} SELECT idx, round(CASE WHEN {_IN} THEN ({_nb(*_BOX)}) / 9.0 ELSE val END, 6) AS out FROM g")
def blur_3x3(spark, d):
    return stencil.box_blur(*_rows50(spark, d)).select("idx", F.round("out", 6).alias("out"))


@query(f"""WITH g AS {_G}, h AS (SELECT *, CASE WHEN j BETWEEN 2 AND 47 THEN avg(val) OVER (PARTITION BY i ORDER BY j ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE val END AS x FROM g)
    SELECT idx, round(CASE WHEN i BETWEEN 2 AND {_H} - 3 THEN avg(x) OVER (PARTITION BY j ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE x END, 6) AS out FROM h""")
def separable_blur(spark, d):
    return stencil.separable_blur(*_rows50(spark, d)).select("idx", F.round("out", 6).alias("out"))


_GX = [(a, b, float(b * (2 - abs(a)))) for a in (-1, 0, 1) for b in (-1, 1)]
_GY = [(a, b, float(a * (2 - abs(b)))) for b in (-1, 0, 1) for a in (-1, 1)]


@query(f"WITH g AS {_G} SELECT idx, round(CASE WHEN {_IN} THEN sqrt(pow({_nb(*_GX)}, 2) + pow({_nb(*_GY)}, 2)) ELSE 0.0 END, 6) AS out FROM g")
def sobel(spark, d):
    return stencil.sobel(*_rows50(spark, d)).select("idx", F.round("out", 6).alias("out"))


@query(f"WITH g AS {_G} SELECT idx, round(CASE WHEN {_IN} THEN ({_nb(*_CROSS)}) / 4.0 ELSE val END, 6) AS val FROM g")
def jacobi_step(spark, d):
    return stencil.jacobi_step(*_rows50(spark, d)).select("idx", F.round("val", 6).alias("val"))


@query(f"WITH g AS {_G} SELECT idx, round(val + 0.1 * CASE WHEN {_IN} THEN ({_nb(*_CROSS)}) - 4.0 * val ELSE 0.0 END, 6) AS val FROM g")
def heat_step(spark, d):
    return stencil.heat_step(*_rows50(spark, d), 0.1).select("idx", F.round("val", 6).alias("val"))


_LIFE = "(SELECT event_id AS idx, event_id // 50 AS i, event_id % 50 AS j, (round(value * 100)::BIGINT % 3 = 0)::BIGINT AS val FROM events)"


@query(f"WITH g AS {_LIFE}, n AS (SELECT *, {_nb(*[c for c in _BOX if c[:2] != (0, 0)])} AS s FROM g) SELECT idx, (s = 3 OR (val = 1 AND s = 2))::BIGINT AS val FROM n")
def life_step(spark, d):
    g, shape = _rows50(spark, d)
    g = g.withColumn("val", (cents("val") % 3 == 0).cast("int"))
    return stencil.life_step(g, shape).select("idx", F.col("val").cast("bigint").alias("val"))


@query("SELECT user_id, min(event_id) AS first, max(event_id) AS last FROM events WHERE value > 50 GROUP BY user_id")
def trim_ranges(spark, d):
    return table(spark, d, "events").where("value > 50").groupBy("user_id").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("SELECT a.range + 4 * b.range AS pt_id, a.range * 0.5 AS x, b.range * 2.0 AS y, a.range AS ix, b.range AS iy FROM range(4) a, range(3) b")
def axis_product(spark, d):
    x = spark.range(4).select(F.col("id").alias("ix"), (F.col("id") * 0.5).alias("x"))
    y = spark.range(3).select(F.col("id").alias("iy"), (F.col("id") * 2.0).alias("y"))
    return joins.product((x, "ix", "x"), (y, "iy", "y"))


ORACLES["axis_product"] = doubles(ORACLES["axis_product"], "x", "y")
