"""Kernels of the kernel language, and time stepping."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldloom.plans.kernel import func, kernel
from fieldloom.queries.common import cents, table
from fieldloom.streaming import stepping

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@kernel
def _saxpy(x, y, out, a, n):
    for i in range(n):
        out[i] = a * x[i] + y[i]


@query("SELECT event_id AS idx, round(2.5 * value + event_id, 6) AS val FROM events")
def kernel_saxpy(spark, d):
    e = table(spark, d, "events")
    x = e.select(F.col("event_id").alias("idx"), F.col("value").alias("val"))
    y = e.select(F.col("event_id").alias("idx"), F.col("event_id").cast("double").alias("val"))
    return _saxpy(x, y, None, 2.5, e.count())["out"].select("idx", F.round("val", 6).alias("val"))


@kernel(while_bound=200)
def _collatz(out, n):
    for i in range(n):
        x = i + 1
        c = 0
        while x != 1:
            if x % 2 == 0:
                x = x // 2
            else:
                x = 3 * x + 1
            c += 1
        out[i] = c


@query("WITH RECURSIVE c(i, x, k) AS (SELECT range, range + 1, 0 FROM range(600) UNION ALL SELECT i, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 3 * x + 1 END, k + 1 FROM c WHERE x <> 1) SELECT i AS idx, max(k)::BIGINT AS val FROM c GROUP BY i")
def collatz(spark, d):
    return _collatz(None, 600)["out"]


@kernel
def _escape(out, h, w, limit):
    for i, j in ndrange(h, w):  # noqa: F821
        cx = j / w * 3.0 - 2.0
        cy = i / h * 2.0 - 1.0
        x = 0.0
        y = 0.0
        c = 0
        for k in range(limit):
            if x * x + y * y > 4.0:
                break
            x, y = x * x - y * y + cx, 2.0 * x * y + cy
            c += 1
        out[i, j] = c


@query("""WITH RECURSIVE z(idx, cx, cy, x, y, k) AS (SELECT range, (range % 48) / 48.0 * 3.0 - 2.0, (range // 48) / 32.0 * 2.0 - 1.0, 0.0::DOUBLE, 0.0::DOUBLE, 0 FROM range(1536) UNION ALL SELECT idx, cx, cy, x * x - y * y + cx, 2.0 * x * y + cy, k + 1 FROM z WHERE x * x + y * y <= 4.0 AND k < 60) SELECT idx, max(k)::BIGINT AS val FROM z GROUP BY idx""")
def mandelbrot(spark, d):
    return _escape(None, 32, 48, 60)["out"]


@func
def _soft(v, cut):
    if v < cut:
        return 0.0
    return v - cut


@kernel
def _shade(x, out, lut, n):
    for i in range(n):
        v = _soft(x[i], 100.0)
        k = int(v / 50.0)
        if k > 3:
            k = 3
        out[i] = v * lut[k]


@query("SELECT event_id AS idx, round(v * ([1.0, 0.5, 0.25, 0.125]::DOUBLE[])[least(3, trunc(v / 50.0)::INT) + 1], 6) AS val FROM (SELECT event_id, CASE WHEN value < 100 THEN 0.0 ELSE value - 100.0 END::DOUBLE AS v FROM events)")
def kernel_func_gather(spark, d):
    """An inlined helper with an early return, predicated locals and a load at a computed index."""
    e = table(spark, d, "events")
    x = e.select(F.col("event_id").alias("idx"), F.col("value").alias("val"))
    lut = spark.range(4).select(F.col("id").alias("idx"), F.pow(F.lit(0.5), F.col("id")).alias("val"))
    return _shade(x, None, lut, e.count())["out"].select("idx", F.round("val", 6).alias("val"))


@kernel
def _count_bins(x, hist, n):
    for i in range(n):
        b = x[i] // 2000
        if b > 9:
            b = 9
        atomic_add(hist, b, 1)  # noqa: F821


@query("SELECT range AS idx, coalesce(n, 0)::BIGINT AS val FROM range(10) LEFT JOIN (SELECT least(9, round(value * 100)::BIGINT // 2000) AS b, count(*) AS n FROM events GROUP BY 1) ON b = range")
def kernel_atomic_histogram(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("idx"), cents("value").alias("val"))
    zero = spark.range(10).select(F.col("id").alias("idx"), F.lit(0).cast("bigint").alias("val"))
    return _count_bins(e, zero, e.count())["hist"]


@kernel
def _directions(p, out, n):
    for i in range(n):
        a = Vector([p[3 * i], p[3 * i + 1], p[3 * i + 2]])  # noqa: F821
        b = a.cross(Vector([0.0, 0.0, 1.0]))  # noqa: F821
        out[i] = a.normalized().dot(b + a * 2.0) - a.norm()


@query("SELECT vec_id AS idx, round(sqrt(e1 * e1 + e2 * e2 + e3 * e3), 6) AS val FROM (SELECT vec_id, embedding[1]::DOUBLE AS e1, embedding[2]::DOUBLE AS e2, embedding[3]::DOUBLE AS e3 FROM embeddings)")
def kernel_vectors(spark, d):
    from fieldloom.sources.field import from_tuples

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.slice("embedding", 1, 3).alias("val"))
    flat = from_tuples(e, 3).withColumn("val", F.col("val").cast("double"))
    return _directions(flat, None, e.count())["out"].select("idx", F.round("val", 6).alias("val"))


@kernel
def _kick_and_drift(p, v, a, dt, n):
    for i in range(n):
        v[i] += a[i] * dt
        v[i] = v[i] * 0.5
        p[i] += v[i] * dt


@query("SELECT event_id AS idx, round((value + event_id % 7 * 0.25) * 0.5, 6) AS v, round(event_id + (value + event_id % 7 * 0.25) * 0.5 * 0.25, 6) AS p FROM events")
def kernel_nbody_update(spark, d):
    """Loads of fields that the same iteration has stored."""
    e = table(spark, d, "events")
    field = lambda val: e.select(F.col("event_id").alias("idx"), val.cast("double").alias("val"))
    out = _kick_and_drift(field(F.col("event_id")), field(F.col("value")), field(F.col("event_id") % 7), 0.25, e.count())
    both = out["v"].select("idx", F.round("val", 6).alias("v")).join(out["p"].select("idx", F.round("val", 6).alias("p")), "idx")
    return both.select("idx", "v", "p")


@kernel
def _row_sums(off, x, out, n):
    for i in range(n):
        acc = 0.0
        for k in range(off[i], off[i + 1]):
            acc += x[k]
        out[i] = acc


_ROWS = "(SELECT ceil((sqrt(8 * count(*) + 1) - 1) / 2)::BIGINT FROM events)"


@query(f"SELECT r.i AS idx, round(sum(value), 4) AS val FROM (SELECT unnest(range({_ROWS})) AS i) r JOIN events ON event_id >= i * (i + 1) // 2 AND event_id < (i + 1) * (i + 2) // 2 GROUP BY r.i")
def kernel_csr_sum(spark, d):
    """Loops of a length that is loaded: row i of a ragged table has i + 1 values."""
    e = table(spark, d, "events").select(F.col("event_id").alias("idx"), F.col("value").alias("val"))
    n = e.count()
    rows = math.ceil((math.sqrt(8 * n + 1) - 1) / 2)
    off = spark.range(rows + 1).select(F.col("id").alias("idx"), F.least(F.lit(n).cast("long"), F.expr("id * (id + 1) div 2")).alias("val"))
    return _row_sums(off, e, None, rows)["out"].select("idx", F.round("val", 4).alias("val"))


@kernel
def _gram(x, out, m, n, wide):
    for i, j in ndrange(m, m):  # noqa: F821
        acc = 0.0
        for k in range(n):
            acc += x[k * wide + i] * x[k * wide + j]
        out[i, j] = acc


@query("SELECT i * 16 + j AS idx, round(sum(embedding[i + 1]::DOUBLE * embedding[j + 1]::DOUBLE), 4) AS val FROM embeddings, (SELECT range AS i FROM range(16)), (SELECT range AS j FROM range(16)) GROUP BY i, j")
def kernel_gram_matrix(spark, d):
    """A long loop of loads: products of 16 columns of all vectors."""
    from fieldloom.sources.field import from_tuples

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.slice("embedding", 1, 16).alias("val"))
    flat = from_tuples(e, 16).withColumn("val", F.col("val").cast("double"))
    return _gram(flat, None, 16, e.count(), 16)["out"].select("idx", F.round("val", 4).alias("val"))


@kernel
def _subtract(x, out, b, n):
    for i in range(n):
        u = x[i]
        w = b
        while u != w:
            if u > w:
                u = u - w
            else:
                w = w - u
        out[i] = u


@query("SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS idx, gcd(c_custkey + 1, 6)::BIGINT AS val FROM customer")
def kernel_long_while(spark, d):
    """Greatest common divisors by subtraction: as many trips as a key has sixths."""
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1).cast("long").alias("val"))
    low = c.agg(F.min("val")).first()[0]
    return _subtract(c.select((F.col("val") - low).alias("idx"), "val"), None, 6, c.count())["out"]


@kernel
def _reflected(v, out, n):
    for i in range(n):
        a = v[i]
        out[i] = a - Vector([2.0 * a[0], 0.0, 0.0])  # noqa: F821


@query("SELECT vec_id AS idx, round(-embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, round(embedding[3]::DOUBLE, 6) AS z FROM embeddings")
def kernel_vector_field(spark, d):
    """Loads and stores of whole vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.slice("embedding", 1, 3).cast("array<double>").alias("val"))
    out = _reflected(e, None, e.count())["out"]
    return out.select("idx", *[F.round(F.get("val", F.lit(k)), 6).alias(c) for k, c in enumerate("xyz")])


_G = "(SELECT event_id AS idx, event_id // 50 AS i, event_id % 50 AS j, value AS val FROM events)"
_STEP = lambda src: f"SELECT g.idx, g.i, g.j, CASE WHEN g.i BETWEEN 1 AND (SELECT count(*) // 50 - 2 FROM events) AND g.j BETWEEN 1 AND 48 THEN (a.val + b.val + c.val + e.val) / 4 ELSE g.val END AS val FROM {src} g LEFT JOIN {src} a ON a.i = g.i - 1 AND a.j = g.j LEFT JOIN {src} b ON b.i = g.i + 1 AND b.j = g.j LEFT JOIN {src} c ON c.i = g.i AND c.j = g.j - 1 LEFT JOIN {src} e ON e.i = g.i AND e.j = g.j + 1"


@query(f"WITH s0 AS {_G}, s1 AS ({_STEP('s0')}), s2 AS ({_STEP('s1')}), s3 AS ({_STEP('s2')}) SELECT idx, round(val, 8) AS val FROM s3")
def jacobi_3_steps(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("idx"), F.expr("event_id div 50").alias("i"), (F.col("event_id") % 50).alias("j"), F.col("value").alias("val"))
    out = stepping.jacobi(e, (e.count() // 50, 50), 3)
    return out.select("idx", F.round("val", 8).alias("val"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """The streaming window aggregate, over the table as a batch."""
    e = table(spark, d, "events").withColumn("c", cents("value")).withColumn("t", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.window("t", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("c").alias("cents"))
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", "cents")
