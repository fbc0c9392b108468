import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import amr, bvh, camera, colour, contour, fe, mesh
from fieldloom.queries.geometry import height_mesh, sphere_nodes


def test_table_rules():
    for case in range(256):
        tris = contour.triangles(case)
        assert len(tris) <= 5 and (len(tris) == 0) == (case in (0, 255))
        cut = {k for k, (a, b) in enumerate(contour.EDGES) if (case >> a & 1) != (case >> b & 1)}
        assert {e for t in tris for e in t} == cut


def test_plane(spark):
    n = 4
    nodes = spark.range((n + 1) ** 3).select((F.col("id") % (n + 1)).alias("i"), F.expr(f"id div {n + 1} % {n + 1}").alias("j"), F.expr(f"id div {(n + 1) ** 2}").alias("k"))
    pts, tris = contour.flying_edges(nodes.withColumn("s", F.col("k") / n), 0.375, spacing=(1 / n,) * 3)
    assert pts.count() == (n + 1) ** 2 and tris.count() == 2 * n * n
    assert pts.agg(F.max(F.abs(F.col("z") - 0.375))).first()[0] < 1e-5
    assert mesh.edge_uses(tris).where("uses = 1").count() == 4 * n


def test_sphere_is_closed_and_points_outwards(spark):
    n = 12
    pts, tris = contour.flying_edges(sphere_nodes(spark, n), 0.0, (-1.5,) * 3, (3 / n,) * 3)
    pts, tris = pts.cache(), tris.cache()
    assert mesh.edge_uses(tris).where("uses <> 2").count() == 0
    assert mesh.euler(tris) == 2
    assert mesh.volume(pts, tris).first()[0] == pytest.approx(4 / 3 * math.pi, rel=0.08)


def test_normals(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 9.0, 9.0, 9.0)], "pt_id long, x double, y double, z double")
    tris = spark.createDataFrame([(0, 0, 1, 2)], "tri_id long, v0 long, v1 long, v2 long")
    got = {r["pt_id"]: (r["nx"], r["ny"], r["nz"]) for r in mesh.vertex_normals(pts, tris).collect()}
    assert got[0] == got[1] == got[2] == (0, 0, 1) and got[3] == (0, 0, 0)


def test_coarsening(spark):
    df = spark.createDataFrame([(v,) for v in (-4, -3, -2, -1, 0, 1, 2, 3)], "v int")
    assert [r[0] for r in df.select(amr.coarsen(F.col("v"), 2)).collect()] == [-2, -2, -1, -1, 0, 0, 1, 1]


def test_basis():
    b = fe.hex_basis([0.0, 0.3, 1.0])
    at = [(x, y, z) for x in (0.1, 0.7) for y in (0.2,) for z in (0.9,)]
    for p in at:
        assert sum(b.evaluate(j, *p) for j in range(b.ndof)) == pytest.approx(1)
        assert sum(b.evaluate(j, *p, d=1) for j in range(b.ndof)) == pytest.approx(0, abs=1e-12)
    nodes = b.nodes
    m = np.array([[b.evaluate(j, *(nodes[k] for k in b.split(i))) for j in range(27)] for i in range(27)])
    assert np.allclose(m, np.eye(27))


def test_grid_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.random((60, 3))
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "pt_id long, x double, y double, z double")
    tris = spark.createDataFrame([(i, 3 * i, 3 * i + 1, 3 * i + 2) for i in range(20)], "tri_id long, v0 long, v1 long, v2 long")
    d = rng.normal(size=(40, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    rays = spark.createDataFrame([(i, *map(float, rng.random(3) * 2 - 0.5), *map(float, d[i])) for i in range(40)], "pid long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r["pid"]: (r["tri_id"], round(r["t"], 9)) for r in bvh.Grid(pts, tris, 6).closest(rays, ["pid"]).collect()}
    want = {r["pid"]: (r["tri_id"], round(r["t"], 9)) for r in bvh.brute_force(rays, pts, tris, ["pid"]).collect()}
    assert got == want and got


def test_hierarchy(spark):
    _, nodes = bvh.hierarchy(*height_mesh(spark))
    n = len(nodes) + 1
    kids = nodes[:, :2].astype(int).ravel()
    assert n == 128 and sorted([0, *kids]) == list(range(2 * n - 1))


def test_colours():
    with pytest.raises(ValueError):
        colour.lut("none")
    assert colour.lut("grayscale", 3).tolist() == [[0, 0, 0], [0.5, 0.5, 0.5], [1, 1, 1]]
    cam = camera.orthographic((0, 0, 5), (0, 0, 0), view_height=2, width=2, height=2)
    assert np.allclose(cam.mvp()[:2, :2], np.eye(2))
