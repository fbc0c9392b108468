"""Meshes, contours, adaptive grids, finite elements."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fieldloom.operators import amr, contour, fe, mesh
from fieldloom.queries.common import doubles, grid, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# a generated grid with a hashed scalar
_NX, _NY, _NZ = 6, 5, 4
_CELLS = f"(SELECT range AS cell_id, range % {_NX} AS i, range // {_NX} % {_NY} AS j, range // {_NX * _NY} AS k, (range * 37 % 101)::DOUBLE AS val FROM range({_NX * _NY * _NZ}))"


def _cells(spark):
    return spark.range(_NX * _NY * _NZ).select(F.col("id").alias("cell_id"), (F.col("id") * 37 % 101).cast("double").alias("val"))


@query(f"""SELECT ((k + c) * {_NY + 1} + j + b) * {_NX + 1} + i + a AS pt_id, round(avg(val), 9) AS val FROM {_CELLS}, (SELECT range AS a FROM range(2)), (SELECT range AS b FROM range(2)), (SELECT range AS c FROM range(2)) GROUP BY 1""")
def cell_to_point(spark, d):
    return mesh.cell_to_point(_cells(spark), _NX, _NY, _NZ).withColumn("val", F.round("val", 9))


_CONN = f"(SELECT cell_id, ((k + c) * {_NY + 1} + j + b) * {_NX + 1} + i + a AS pt_id FROM {_CELLS}, (SELECT range AS a FROM range(2)), (SELECT range AS b FROM range(2)), (SELECT range AS c FROM range(2)))"


@query(f"SELECT cell_id, round(avg(pt_id * 53 % 97), 9) AS val, round(avg(pt_id * 0.5), 9) AS w FROM {_CONN} GROUP BY 1")
def point_to_cell(spark, d):
    cells = mesh.structured_cells(spark, _NX, _NY, _NZ)
    pts = spark.range((_NX + 1) * (_NY + 1) * (_NZ + 1)).select(F.col("id").alias("pt_id"), (F.col("id") * 53 % 97).alias("val"), (F.col("id") * 0.5).alias("w"))
    return mesh.cell_average(cells, pts, ["val", "w"]).select("cell_id", F.round("val", 9).alias("val"), F.round("w", 9).alias("w"))


@query(f"""SELECT cell_id, local_idx, pt_id FROM (SELECT cell_id, unnest(range(8)) AS local_idx, unnest([p, p + 1, p + {_NX + 2}, p + {_NX + 1}, p + {(_NX + 1) * (_NY + 1)}, p + {(_NX + 1) * (_NY + 1) + 1}, p + {(_NX + 1) * (_NY + 1) + _NX + 2}, p + {(_NX + 1) * (_NY + 1) + _NX + 1}]) AS pt_id FROM (SELECT cell_id, (k * {_NY + 1} + j) * {_NX + 1} + i AS p FROM {_CELLS}))""")
def structured_connectivity(spark, d):
    return mesh.structured_cells(spark, _NX, _NY, _NZ).select("cell_id", F.col("local_idx").cast("bigint").alias("local_idx"), "pt_id")


@query(f"SELECT n.new_id AS cell_id, count(*) AS points, sum(pt_id)::BIGINT AS total FROM (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS new_id FROM {_CELLS} WHERE val BETWEEN 20 AND 60) n JOIN {_CONN} c USING (cell_id) GROUP BY 1")
def threshold_mesh(spark, d):
    out = mesh.threshold(mesh.structured_cells(spark, _NX, _NY, _NZ), _cells(spark), 20, 60)
    return out.groupBy("cell_id").agg(F.count("*").alias("points"), F.sum("pt_id").alias("total"))


@query(f"SELECT cell_id, round(avg(pt_id * 0.25), 9) AS val FROM {_CONN} GROUP BY 1")
def parametric_center(spark, d):
    pts = spark.range((_NX + 1) * (_NY + 1) * (_NZ + 1)).select(F.col("id").alias("pt_id"), (F.col("id") * 0.25).alias("val"))
    return mesh.parametric_center(mesh.structured_cells(spark, _NX, _NY, _NZ), pts, "hexahedron", ["val"]).withColumn("val", F.round("val", 9))


# a height-field mesh of 8 x 8 quads
_PTS = "(SELECT range AS pt_id, (range % 9)::DOUBLE AS x, (range // 9)::DOUBLE AS y, ((range * 31) % 17) / 8.0 AS z FROM range(81))"
_TRIS = "(SELECT range AS tri_id, CASE WHEN range % 2 = 0 THEN p ELSE p + 1 END AS v0, CASE WHEN range % 2 = 0 THEN p + 1 ELSE p + 10 END AS v1, p + 9 AS v2 FROM (SELECT range, (range // 2 // 8) * 9 + range // 2 % 8 AS p FROM range(128)))"


def height_mesh(spark):
    i = F.col("id")
    pts = spark.range(81).select(i.alias("pt_id"), (i % 9).cast("double").alias("x"), F.expr("cast(id div 9 as double)").alias("y"), (i * 31 % 17 / 8.0).alias("z"))
    p = F.expr("(id div 2 div 8) * 9 + (id div 2) % 8")
    tris = spark.range(128).select(i.alias("tri_id"), F.when(i % 2 == 0, p).otherwise(p + 1).alias("v0"), F.when(i % 2 == 0, p + 1).otherwise(p + 10).alias("v1"), (p + 9).alias("v2"))
    return pts, tris


@query(f"""WITH t AS (SELECT tri_id, v0, v1, v2, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz FROM {_TRIS} JOIN {_PTS} a ON a.pt_id = v0 JOIN {_PTS} b ON b.pt_id = v1 JOIN {_PTS} c ON c.pt_id = v2),
    s AS (SELECT pt_id, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT unnest([v0, v1, v2]) AS pt_id, nx, ny, nz FROM t) GROUP BY 1) SELECT pt_id, round(nx / l, 6) + 0.0 AS nx, round(ny / l, 6) + 0.0 AS ny, round(nz / l, 6) + 0.0 AS nz FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM s)""")
def vertex_normals(spark, d):
    n = mesh.vertex_normals(*height_mesh(spark))
    return n.select("pt_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


@query(f"""SELECT tri_id, least(a.z, b.z, c.z) - 1e-6 AS lo_z, greatest(a.z, b.z, c.z) + 1e-6 AS hi_z, round((a.x + b.x + c.x) / 3, 9) AS cx FROM {_TRIS} JOIN {_PTS} a ON a.pt_id = v0 JOIN {_PTS} b ON b.pt_id = v1 JOIN {_PTS} c ON c.pt_id = v2""")
def triangle_boxes(spark, d):
    return mesh.triangle_boxes(*height_mesh(spark)).select("tri_id", "lo_z", "hi_z", F.round("cx", 9).alias("cx"))


@query(f"SELECT uses, count(*)::BIGINT AS edges FROM (SELECT least(a, b), greatest(a, b), count(*)::BIGINT AS uses FROM (SELECT unnest([v0, v1, v2]) AS a, unnest([v1, v2, v0]) AS b FROM {_TRIS}) GROUP BY 1, 2) GROUP BY 1")
def edge_uses(spark, d):
    return mesh.edge_uses(height_mesh(spark)[1]).groupBy("uses").agg(F.count("*").alias("edges"))


@query("SELECT vec_id, round(0.5 * embedding[1]::DOUBLE + 0.25 * embedding[2]::DOUBLE - embedding[3]::DOUBLE, 9) AS elevation FROM embeddings")
def elevation(spark, d):
    e = F.col("embedding")
    pts = table(spark, d, "embeddings").select("vec_id", *[F.get(e, F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")])
    return pts.select("vec_id", F.round(mesh.elevation((0.5, 0.25, -1.0)), 9).alias("elevation"))


_M = np.array([[0.0, -2.0, 0.0, 1.0], [2.0, 0.0, 0.0, -1.0], [0.0, 0.0, 0.5, 3.0], [0, 0, 0, 1]])


@query("SELECT vec_id, round(-2.0 * embedding[2]::DOUBLE + 1, 9) AS x, round(2.0 * embedding[1]::DOUBLE - 1, 9) AS y, round(0.5 * embedding[3]::DOUBLE + 3, 9) AS z FROM embeddings")
def affine_transform(spark, d):
    e = F.col("embedding")
    pts = table(spark, d, "embeddings").select("vec_id", *[F.get(e, F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")])
    return mesh.transform_points(pts, _M).select("vec_id", *[F.round(c, 9).alias(c) for c in "xyz"])


# contours
_W, _H = 40, 30
_S2 = f"(SELECT range % {_W} AS i, range // {_W} AS j, sqrt(pow(range % {_W} - 19.3, 2) + pow(range // {_W} - 14.6, 2)) AS s FROM range({_W * _H}))"


def _nodes2(spark):
    g = grid(spark, _H, _W, names="ji")
    return g.select("i", "j", F.sqrt(F.pow(F.col("i") - 19.3, 2) + F.pow(F.col("j") - 14.6, 2)).alias("s"))


_SQ = f"""n AS {_S2}, c AS (SELECT a.i, a.j, a.s AS s0, b.s AS s1, e.s AS s2, f.s AS s3 FROM n a JOIN n b ON b.i = a.i + 1 AND b.j = a.j JOIN n e ON e.i = a.i + 1 AND e.j = a.j + 1 JOIN n f ON f.i = a.i AND f.j = a.j + 1),
    k AS (SELECT *, ((s0 > 9)::INT + 2 * (s1 > 9)::INT + 4 * (s2 > 9)::INT + 8 * (s3 > 9)::INT)::BIGINT AS case_id FROM c)"""


@query(f"WITH {_SQ} SELECT case_id, count(*)::BIGINT AS cells FROM k GROUP BY 1")
def marching_squares_cases(spark, d):
    return contour.square_cells(_nodes2(spark)).withColumn("case_id", contour.case_of(9.0, 4).cast("bigint")).groupBy("case_id").agg(F.count("*").alias("cells"))


@query(f"""WITH {_SQ}, t(case_id, seg, e0, e1) AS (VALUES {", ".join(f"({c}, {n}, {a}, {b})" for c, s in enumerate(contour.SEGMENTS) for n, (a, b) in enumerate(s))}),
    p AS (SELECT k.i, k.j, t.seg, t.e0, t.e1, [i + (9 - s0) / (s1 - s0), i + 1, i + 1 + (9 - s2) / (s3 - s2) * -1, i] AS xs, [j, j + (9 - s1) / (s2 - s1), j + 1, j + 1 - (9 - s3) / (s0 - s3)] AS ys FROM k JOIN t USING (case_id))
    SELECT (j * {_W} + i)::BIGINT AS cell_id, seg::BIGINT AS seg, round(xs[e0 + 1], 6) AS ax, round(ys[e0 + 1], 6) AS ay, round(xs[e1 + 1], 6) AS bx, round(ys[e1 + 1], 6) AS by FROM p""")
def marching_squares_segments(spark, d):
    cells = contour.square_cells(_nodes2(spark)).withColumn("cell_id", F.col("j") * _W + F.col("i"))
    out = contour.marching_squares(cells, 9.0)
    return out.select("cell_id", F.col("seg").cast("bigint").alias("seg"), *[F.round(c, 6).alias(c) for c in ("ax", "ay", "bx", "by")])


_N = 12
_S3 = f"(SELECT range % {_N + 1} AS i, range // {_N + 1} % {_N + 1} AS j, range // {(_N + 1) ** 2} AS k, 1.0 - (pow(-1.5 + (range % {_N + 1}) * 0.25, 2) + pow(-1.5 + (range // {_N + 1} % {_N + 1}) * 0.25, 2) + pow(-1.5 + (range // {(_N + 1) ** 2}) * 0.25, 2)) AS s FROM range({(_N + 1) ** 3}))"


def sphere_nodes(spark, n=_N, half=1.5):
    h = 2.0 * half / n
    x = lambda c: -half + F.col(c) * h
    g = grid(spark, n + 1, n + 1, n + 1, names="kji")
    return g.select("i", "j", "k", (1.0 - (F.pow(x("i"), 2) + F.pow(x("j"), 2) + F.pow(x("k"), 2))).alias("s"))


@query(f"""WITH n AS {_S3} SELECT a.k, a.j, count(*) FILTER ((a.s > 0) <> (b.s > 0))::BIGINT AS x, count(*) FILTER ((a.s > 0) <> (c.s > 0))::BIGINT AS y, count(*) FILTER ((a.s > 0) <> (e.s > 0))::BIGINT AS z
    FROM n a LEFT JOIN n b ON b.i = a.i + 1 AND b.j = a.j AND b.k = a.k LEFT JOIN n c ON c.i = a.i AND c.j = a.j + 1 AND c.k = a.k LEFT JOIN n e ON e.i = a.i AND e.j = a.j AND e.k = a.k + 1 GROUP BY 1, 2""")
def flying_edges_counts(spark, d):
    return contour.row_counts(contour.corners(sphere_nodes(spark)), 0.0).drop("tris")


@query(f"""WITH n AS {_S3}, e AS (SELECT 0 AS axis, a.i, a.j, a.k, a.s, b.s AS t FROM n a JOIN n b ON b.i = a.i + 1 AND b.j = a.j AND b.k = a.k UNION ALL SELECT 1, a.i, a.j, a.k, a.s, b.s FROM n a JOIN n b ON b.i = a.i AND b.j = a.j + 1 AND b.k = a.k UNION ALL SELECT 2, a.i, a.j, a.k, a.s, b.s FROM n a JOIN n b ON b.i = a.i AND b.j = a.j AND b.k = a.k + 1),
    c AS (SELECT *, (0 - s) / (t - s + 1e-10) AS w FROM e WHERE (s > 0) <> (t > 0)) SELECT row_number() OVER (ORDER BY axis, k, j, i) - 1 AS pt_id, round(-1.5 + (i + CASE WHEN axis = 0 THEN w ELSE 0 END) * 0.25, 6) AS x, round(-1.5 + (j + CASE WHEN axis = 1 THEN w ELSE 0 END) * 0.25, 6) AS y, round(-1.5 + (k + CASE WHEN axis = 2 THEN w ELSE 0 END) * 0.25, 6) AS z FROM c""")
def flying_edges_points(spark, d):
    pts, _ = contour.flying_edges(sphere_nodes(spark), 0.0, (-1.5,) * 3, (0.25,) * 3)
    return pts.select("pt_id", *[F.round(c, 6).alias(c) for c in "xyz"])


def _corner_values() -> str:
    return ", ".join(f"({c}, {x}, {y}, {z})" for c, (x, y, z) in enumerate(mesh.HEX))


def _case_values() -> str:
    """(case_id, t, n, corner a's offsets, corner b's offsets) of every triangle's vertices; the table itself is tested by its invariants."""
    rows = [(c, t, n, *mesh.HEX[contour.EDGES[e][0]], *mesh.HEX[contour.EDGES[e][1]]) for c in range(256) for t, tri in enumerate(contour.triangles(c)) for n, e in enumerate(tri)]
    return ", ".join(str(r).replace(" ", "") for r in rows)


def _cases(keys: str, iso: float) -> str:
    """SQL of the cells' cases and of their triangles' vertices, over nodes n (keys, i, j, k, s)."""
    on = lambda t, o: " AND ".join([*[f"{t}.{k} = c.{k}" for k in keys.split(", ") if k], *[f"{t}.{x} = c.{x} + v.{o}{x}" for x in "ijk"]])
    lead = f"{keys}, " if keys else ""
    return f"""h(c, di, dj, dk) AS (VALUES {_corner_values()}), v(case_id, t, n, ai, aj, ak, bi, bj, bk) AS (VALUES {_case_values()}),
    c AS (SELECT {lead}i - di AS i, j - dj AS j, k - dk AS k, sum(CASE WHEN s > {iso} THEN 1 << c ELSE 0 END) AS case_id FROM n, h GROUP BY ALL HAVING count(*) = 8),
    w AS (SELECT c.*, v.* EXCLUDE (case_id), greatest(0.0, least(1.0, CASE WHEN abs(b.s - a.s) <= 1e-10 THEN 0.5 ELSE ({iso} - a.s) / (b.s - a.s) END)) AS w FROM c JOIN v USING (case_id) JOIN n a ON {on("a", "a")} JOIN n b ON {on("b", "b")})"""


@query(f"""WITH o AS {_S3}, n AS (SELECT block, o.* FROM o, (SELECT range AS block FROM range(2))), {_cases("block", 0.0)},
    e AS (SELECT DISTINCT a.block, a.i, a.j, a.k, CASE WHEN b.i > a.i THEN 0 WHEN b.j > a.j THEN 1 ELSE 2 END AS axis FROM n a JOIN n b ON a.block = b.block AND (a.s > 0) <> (b.s > 0) AND b.i - a.i + b.j - a.j + b.k - a.k = 1 AND b.i >= a.i AND b.j >= a.j AND b.k >= a.k),
    p AS (SELECT *, row_number() OVER (ORDER BY block, axis, k, j, i) - 1 AS pt FROM e),
    u AS (SELECT *, row_number() OVER (ORDER BY block, k, j, i, t) - 1 AS tri_id FROM (SELECT DISTINCT block, i, j, k, t FROM w WHERE block = 0 OR i >= 6))
    SELECT u.tri_id, u.block, max(CASE WHEN n = 0 THEN pt END) AS v0, max(CASE WHEN n = 1 THEN pt END) AS v1, max(CASE WHEN n = 2 THEN pt END) AS v2 FROM u JOIN w USING (block, i, j, k, t) JOIN p ON p.block = u.block AND p.i = w.i + least(ai, bi) AND p.j = w.j + least(aj, bj) AND p.k = w.k + least(ak, bk) AND p.axis = CASE WHEN ai <> bi THEN 0 WHEN aj <> bj THEN 1 ELSE 2 END GROUP BY ALL""")
def flying_edges_triangles(spark, d):
    """Two stacked blocks; half the cells of the second are masked."""
    one = sphere_nodes(spark)
    both = one.withColumn("block", F.lit(0)).unionByName(one.withColumn("block", F.lit(1)))
    mask = one.where("i < 6").select(F.lit(1).alias("block"), "i", "j", "k", F.lit(1).alias("mask"))
    out = contour.flying_edges(both, 0.0, (-1.5,) * 3, (0.25,) * 3, mask=mask, block="block")[1]
    return out.withColumn("block", F.col("block").cast("bigint"))


@query("SELECT 2::BIGINT AS euler, true AS closed")
def flying_edges_topology(spark, d):
    """V - E + F of the sphere, and whether every edge has two triangles."""
    tris = contour.flying_edges(sphere_nodes(spark), 0.0, (-1.5,) * 3, (0.25,) * 3)[1]
    v = tris.select(F.explode(F.array("v0", "v1", "v2")).alias("v")).agg(F.count_distinct("v").alias("nv"))
    e = mesh.edge_uses(tris).agg(F.count("*").alias("ne"), F.every(F.col("uses") == 2).alias("closed"))
    f = tris.agg(F.count("*").alias("nf"))
    return v.crossJoin(e).crossJoin(f).select((F.col("nv") - F.col("ne") + F.col("nf")).alias("euler"), "closed")  # three rows of one


_AT = lambda x, a: f"round({a} + ({x} + a{x} + w * (b{x} - a{x})) * 0.25, 6)::DOUBLE + 0.0"


@query(f"""WITH n AS {_S3}, {_cases("", 0.0)} SELECT i, j, k, t, n, {", ".join(f"{_AT(x, -1.5)} AS {c}" for x, c in zip("ijk", "xyz", strict=True))} FROM w""")
def marching_cubes(spark, d):
    out = contour.marching_cubes(contour.corners(sphere_nodes(spark)), 0.0, (-1.5,) * 3, (0.25,) * 3)
    return out.select("i", "j", "k", "t", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


# adaptive grids
_BLOCKS = [(0, 0, 0, 0, 0, 15, 15, 15, 0), (0, 1, 16, 0, 0, 31, 15, 15, 1), (1, 0, 4, 4, 4, 19, 19, 19, 0), (1, 1, 28, 8, 8, 43, 23, 23, 0), (1, 2, -8, -8, 0, 3, 3, 7, 0)]


@query(f"""WITH b(level, block_id, lx, ly, lz, hx, hy, hz, ng) AS (VALUES {", ".join(map(str, _BLOCKS))}), c AS (SELECT *, floor(lx / 2.0)::BIGINT AS clx, floor(ly / 2.0)::BIGINT AS cly, floor(lz / 2.0)::BIGINT AS clz, floor(hx / 2.0)::BIGINT AS chx, floor(hy / 2.0)::BIGINT AS chy, floor(hz / 2.0)::BIGINT AS chz FROM b WHERE level = 1),
    p AS (SELECT p.block_id, p.lx, p.ly, p.lz, p.hx - p.lx + 1 + 2 * p.ng AS nx, p.hy - p.ly + 1 + 2 * p.ng AS ny, p.ng, greatest(p.lx, clx) AS ax, greatest(p.ly, cly) AS ay, greatest(p.lz, clz) AS az, least(p.hx, chx) AS bx, least(p.hy, chy) AS b_y, least(p.hz, chz) AS bz FROM b p, c WHERE p.level = 0),
    x AS (SELECT *, unnest(range(ax, bx + 1)) AS x FROM p WHERE ax <= bx AND ay <= b_y AND az <= bz), y AS (SELECT *, unnest(range(ay, b_y + 1)) AS y FROM x), z AS (SELECT *, unnest(range(az, bz + 1)) AS z FROM y)
    SELECT DISTINCT block_id::BIGINT AS block_id, (((z - lz + ng) * ny + y - ly + ng) * nx + x - lx + ng)::BIGINT AS cell_id, 8::BIGINT AS mask FROM z""")
def amr_masks(spark, d):
    names = ["level", "block_id", "lo_x", "lo_y", "lo_z", "hi_x", "hi_y", "hi_z", "ng"]
    b = spark.createDataFrame(_BLOCKS, ", ".join(f"{n} long" for n in names))
    b = b.withColumns({f"ng_{x}": F.col("ng") for x in "xyz"} | {f"n_{x}": F.col(f"hi_{x}") - F.col(f"lo_{x}") + 1 + 2 * F.col("ng") for x in "xyz"})
    return amr.build_masks(b, [2]).select("block_id", "cell_id", F.col("mask").cast("bigint").alias("mask"))


# finite elements: 5 quads with nine degrees of freedom each, values of x * y + x in parametric terms
_DOFS = "(SELECT e.range AS elem, p.range AS j, (e.range + 1) * ((p.range % 3) * 0.5) * ((p.range // 3) * 0.5) + (p.range % 3) * 0.5 AS val FROM range(5) e, range(9) p)"


@query("SELECT e.range AS elem, p.range AS pt, round((e.range + 1) * ((p.range % 5) * 0.25) * ((p.range // 5) * 0.25) + (p.range % 5) * 0.25, 9) AS v FROM range(5) e, range(25) p")
def fe_quad_eval(spark, d):
    """The values are of a bilinear function, which a quadratic basis reproduces at every sub-point."""
    g = grid(spark, 5, 9, names="ej").select(F.col("e").alias("elem"), F.col("j").cast("int").alias("j"))
    r, s = F.col("j") % 3 * 0.5, F.expr("j div 3") * 0.5
    dofs = g.withColumn("val", (F.col("elem") + 1) * r * s + r)
    return fe.at_subpoints(dofs, fe.quad_basis([0, 0.5, 1]), 4).select("elem", F.col("pt").cast("bigint").alias("pt"), F.round("v", 9).alias("v"))


@query("SELECT range AS elem, round(2 * 0.3 + range * 0.3 * 0.6, 9) AS x, round(0.6 + 0.1 * range, 9) AS y, round((2 + range * 0.6) * 1.0, 9) AS det FROM range(4)")
def fe_quad_map(spark, d):
    """Quads (0,y0) (2,y0) (2+e,y0+1) (0,y0+1), y0 = e / 10, mapped at (0.3, 0.6)."""
    e = F.col("id").cast("double")
    geo = spark.range(4).select(F.col("id").alias("elem"), F.lit(0.0).alias("x0"), F.lit(2.0).alias("x1"), (2.0 + e).alias("x2"), F.lit(0.0).alias("x3"), (e * 0.1).alias("y0"), (e * 0.1).alias("y1"), (e * 0.1 + 1.0).alias("y2"), (e * 0.1 + 1.0).alias("y3"))
    r, s = F.lit(0.3), F.lit(0.6)
    det = fe.quad_jacobian("x", 0, r, s) * fe.quad_jacobian("y", 1, r, s) - fe.quad_jacobian("x", 1, r, s) * fe.quad_jacobian("y", 0, r, s)
    return geo.select("elem", F.round(fe.quad_map("x", r, s), 9).alias("x"), F.round(fe.quad_map("y", r, s), 9).alias("y"), F.round(det, 9).alias("det"))


_V = lambda a, b: f"((elem + 1) * {a} * {b} / 16.0 + {a} / 4.0)::DOUBLE"
_SIDES = [((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 1), (0, 1)), ((0, 1), (0, 0))]


@query(f"""WITH g AS (SELECT e.range AS elem, a.range AS si, b.range AS sj FROM range(5) e, range(4) a, range(4) b),
    x AS ({" UNION ALL ".join(f"SELECT elem, si, sj, {k} AS k, {_V(f'(si + {a[0]})', f'(sj + {a[1]})')} AS va, {_V(f'(si + {b[0]})', f'(sj + {b[1]})')} AS vb, {a[0]} AS ar, {a[1]} AS a_s, {b[0]} AS br, {b[1]} AS bs FROM g" for k, (a, b) in enumerate(_SIDES))}),
    c AS (SELECT elem, si, sj, row_number() OVER (PARTITION BY elem, si, sj ORDER BY k) - 1 AS q, elem + (si + ar + (0.8 - va) / (vb - va) * (br - ar)) * 0.25 AS x, (sj + a_s + (0.8 - va) / (vb - va) * (bs - a_s)) * 0.25 AS y FROM x WHERE (va >= 0.8) <> (vb >= 0.8))
    SELECT a.elem, a.si, a.sj, a.q // 2 AS seg, round(a.x, 6)::DOUBLE AS ax, round(a.y, 6)::DOUBLE AS ay, round(b.x, 6)::DOUBLE AS bx, round(b.y, 6)::DOUBLE AS by FROM c a JOIN c b ON b.elem = a.elem AND b.si = a.si AND b.sj = a.sj AND b.q = a.q + 1 AND a.q % 2 = 0""")
def fe_isolines(spark, d):
    g = grid(spark, 5, 5, 5, names="eab").select(F.col("e").alias("elem"), F.col("b").alias("si"), F.col("a").alias("sj"))
    vals = g.withColumn("v", (F.col("elem") + 1) * F.col("si") * F.col("sj") / 16.0 + F.col("si") / 4.0)
    geo = spark.range(5).select(F.col("id").alias("elem"), *[(F.col("id") + x).cast("double").alias(f"x{k}") for k, x in enumerate((0, 1, 1, 0))], *[F.lit(float(y)).alias(f"y{k}") for k, y in enumerate((0, 0, 1, 1))])
    out = contour.isolines(vals, geo, 4, 0.8)
    return out.select("elem", "si", "sj", F.col("seg").cast("bigint").alias("seg"), *[F.round(c, 6).alias(c) for c in ("ax", "ay", "bx", "by")])


@query(f"""WITH n AS (SELECT e.range AS elem, a.range AS i, b.range AS j, c.range AS k, (pow(a.range / 4.0 - 0.5, 2) + pow(b.range / 4.0 - 0.5, 2) + pow(c.range / 4.0 - 0.5, 2))::DOUBLE AS s FROM range(3) e, range(5) a, range(5) b, range(5) c), {_cases("elem", 0.1)}
    SELECT elem, i, j, k, t, n, {", ".join(f"{_AT(x, a)} AS {c}" for x, a, c in (("i", "elem", "x"), ("j", "0", "y"), ("k", "0", "z")))} FROM w""")
def fe_isosurface(spark, d):
    g = grid(spark, 3, 5, 5, 5, names="ekji").withColumnRenamed("e", "elem").drop("idx")
    vals = g.withColumn("v", F.pow(F.col("i") / 4.0 - 0.5, 2) + F.pow(F.col("j") / 4.0 - 0.5, 2) + F.pow(F.col("k") / 4.0 - 0.5, 2))
    cols = [(F.col("id") + float(o[0])).alias(f"x{k}") for k, o in enumerate(mesh.HEX)] + [F.lit(float(o[d])).alias(f"{c}{k}") for k, o in enumerate(mesh.HEX) for d, c in ((1, "y"), (2, "z"))]
    out = contour.isosurface(vals, spark.range(3).select(F.col("id").alias("elem"), *cols), 4, 0.1)
    return out.select("elem", "i", "j", "k", "t", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


@query("SELECT elem, j, idx * 1.5 AS val FROM (SELECT range AS elem, unnest(range(4)) AS j, unnest([range * 3 + 1, range * 3 + 0, range * 3 + 2, range * 3 + 3]) AS idx FROM range(6))")
def fe_gathered_dofs(spark, d):
    """Continuous elements whose shared degrees of freedom are reached through an index and a permutation."""
    off = spark.range(6).select(F.col("id").alias("elem"), (F.col("id") * 4).alias("start"), (F.col("id") * 4 + 4).alias("stop"))
    ind = spark.range(24).select(F.col("id").alias("at"), F.expr("(id div 4) * 3 + id % 4").alias("idx"))
    val = spark.range(19).select(F.col("id").alias("idx"), (F.col("id") * 1.5).alias("val"))
    return fe.gathered_dofs(off, ind, val, [1, 0, 2, 3]).withColumn("j", F.col("j").cast("bigint"))


ORACLES["fe_quad_eval"] = doubles(ORACLES["fe_quad_eval"], "v")
ORACLES["fe_quad_map"] = doubles(ORACLES["fe_quad_map"], "x", "y", "det")
ORACLES["fe_gathered_dofs"] = doubles(ORACLES["fe_gathered_dofs"], "val")
