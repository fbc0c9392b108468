"""Sampling, colour, volumes, cameras, rays, images."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldloom.operators import bvh, camera, colour, pathtrace, raster, volume
from fieldloom.operators.scene import GLASS, MIRROR, Actor, Light, Material, Scene
from fieldloom.queries.common import doubles, grid, table
from fieldloom.queries.geometry import height_mesh

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_N = 8
_VOX = f"(SELECT range % 8 AS ix, range // 8 % 8 AS iy, range // 64 AS iz, sqrt(pow(range % 8 - 3.5, 2) + pow(range // 8 % 8 - 3.5, 2) + pow(range // 64 - 3.5, 2)) AS s FROM range(512))"


def _voxels(spark):
    g = grid(spark, _N, _N, _N, names="kji")
    c = lambda x: F.pow(F.col(x) - 3.5, 2)
    return g.select(F.col("i").cast("int").alias("ix"), F.col("j").cast("int").alias("iy"), F.col("k").cast("int").alias("iz"), F.sqrt(c("i") + c("j") + c("k")).alias("s"))


def _sample_sql(clamp: str) -> str:
    at = lambda c: clamp.format(f"({c} * 7.0)")
    return f"""WITH p AS (SELECT event_id, (event_id % 97) / 96.0 AS u, (event_id % 89) / 88.0 AS v, (event_id % 83) / 82.0 AS w FROM events), f AS (SELECT event_id, {at("u")} AS fx, {at("v")} AS fy, {at("w")} AS fz FROM p),
    b AS (SELECT *, floor(fx)::BIGINT AS bx, floor(fy)::BIGINT AS b_y, floor(fz)::BIGINT AS bz FROM f), c AS (SELECT event_id, least(7, bx + a.range) AS ix, least(7, b_y + o.range) AS iy, least(7, bz + e.range) AS iz,
    (CASE WHEN a.range = 1 THEN fx - bx ELSE 1 - fx + bx END) * (CASE WHEN o.range = 1 THEN fy - b_y ELSE 1 - fy + b_y END) * (CASE WHEN e.range = 1 THEN fz - bz ELSE 1 - fz + bz END) AS k FROM b, range(2) a, range(2) o, range(2) e)
    SELECT event_id, round(sum(k * s), 6) AS val FROM c JOIN {_VOX} USING (ix, iy, iz) GROUP BY 1"""


def _sample_points(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", (e % 97 / 96.0).alias("u"), (e % 89 / 88.0).alias("v"), (e % 83 / 82.0).alias("w"))


@query(_sample_sql("{0}"))
def texture_sample(spark, d):
    return volume.texture_sample(_sample_points(spark, d), _voxels(spark), (_N,) * 3, ["event_id"]).select("event_id", F.round("val", 6).alias("val"))


@query(_sample_sql("least(6.0, greatest(0.0, {0}))::DOUBLE"))
def volume_sample(spark, d):
    return volume.volume_sample(_sample_points(spark, d), _voxels(spark), (_N,) * 3, ["event_id"]).select("event_id", F.round("val", 6).alias("val"))


_RAINBOW = colour.PRESETS["rainbow"]


def _channel(c: int) -> str:
    v = "[" + ", ".join(f"{p[c]}::DOUBLE" for p in _RAINBOW) + "]"
    return f"round({v}[k + 1] + w * ({v}[k + 2] - {v}[k + 1]), 6)"


@query(f"WITH t AS (SELECT event_id, least(1.0, greatest(0.0, (value - 50.0) * (1.0 / 250.0)))::DOUBLE * 4.0 AS f FROM events), k AS (SELECT event_id, f, least(3, trunc(f)::INT) AS k, f - least(3, trunc(f)::INT) AS w FROM t) SELECT event_id, {_channel(0)} AS r, {_channel(1)} AS g, {_channel(2)} AS b FROM k")
def colormap(spark, d):
    out = colour.ColourTable("rainbow", len(_RAINBOW), (50.0, 300.0)).map(table(spark, d, "events").select("event_id", "value"), "value")
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in "rgb"])


@query("SELECT event_id, round(k / 10.0, 6) AS r, round(0.5 * k / 10.0, 6) AS a FROM (SELECT event_id, least(10, trunc(least(1.0, greatest(0.0, (value - 0.0) / 300.0))::DOUBLE * 10.0)::INT) AS k FROM events)")
def transfer_function(spark, d):
    tf = colour.TransferFunction("grayscale", n=11, range_=(0.0, 300.0))
    e = table(spark, d, "events").select("event_id", tf.entry(F.col("value")).alias("e"))
    return e.select("event_id", F.round(F.get("e", F.lit(0)), 6).alias("r"), F.round(F.get("e", F.lit(3)), 6).alias("a"))


_T = math.tan(math.radians(22.5))


@query(f"WITH p AS (SELECT range AS pid, range % 16 AS px, range // 16 AS py FROM range(256)), r AS (SELECT pid, (px + 0.5) / 16.0 * 2 * {_T!r} - {_T!r} AS x, {_T!r} - (py + 0.5) / 16.0 * 2 * {_T!r} AS y FROM p) SELECT pid, round(x / sqrt(x * x + y * y + 1), 9) AS dx, round(y / sqrt(x * x + y * y + 1), 9) AS dy, round(-1.0 / sqrt(x * x + y * y + 1), 9) AS dz, 5.0::DOUBLE AS oz FROM r")
def camera_rays(spark, d):
    cam = camera.perspective((0, 0, 5), (0, 0, 0), width=16, height=16)
    return cam.rays(spark).select("pid", *[F.round(f"d{a}", 9).alias(f"d{a}") for a in "xyz"], "oz")


@query("SELECT range AS pid, round((range % 16 + 0.5) * 0.25 - 2.0, 9) AS ox, round(2.0 - (range // 16 + 0.5) * 0.25, 9) AS oy, -1.0::DOUBLE AS dz FROM range(256)")
def orthographic_rays(spark, d):
    cam = camera.orthographic((0, 0, 5), (0, 0, 0), view_height=4.0, width=16, height=16)
    return cam.rays(spark).select("pid", F.round("ox", 9).alias("ox"), F.round("oy", 9).alias("oy"), "dz")


@query("""WITH r AS (SELECT range AS pid, (range % 16 + 0.5) * 0.25 - 2.0 AS ox, 2.0 - (range // 16 + 0.5) * 0.25 AS oy FROM range(256)) SELECT pid, (ox BETWEEN -1 AND 1 AND oy BETWEEN -0.5 AND 1.5) AS hit, CASE WHEN ox BETWEEN -1 AND 1 AND oy BETWEEN -0.5 AND 1.5 THEN 4.0 END::DOUBLE AS near, CASE WHEN ox BETWEEN -1 AND 1 AND oy BETWEEN -0.5 AND 1.5 THEN 6.0 END::DOUBLE AS far FROM r""")
def ray_aabb(spark, d):
    cam = camera.orthographic((0, 0, 5), (0, 0, 0), view_height=4.0, width=16, height=16)
    near, far = volume.slab((-1, -0.5, -1), (1, 1.5, 1))
    r = cam.rays(spark).withColumns({"a": near, "b": far}).withColumn("hit", F.col("a") <= F.col("b"))
    return r.select("pid", "hit", F.when(F.col("hit"), F.col("a")).alias("near"), F.when(F.col("hit"), F.col("b")).alias("far"))


def _mesh_rays(spark):
    cam = camera.orthographic((4.0, 4.0, 9.0), (4.0, 4.0, 0.0), view_height=9.0, width=24, height=24)
    return cam.rays(spark)


_PTS = "(SELECT range AS pt_id, (range % 9)::DOUBLE AS x, (range // 9)::DOUBLE AS y, ((range * 31) % 17) / 8.0 AS z FROM range(81))"
_TRIS = "(SELECT range AS tri_id, CASE WHEN range % 2 = 0 THEN p ELSE p + 1 END AS v0, CASE WHEN range % 2 = 0 THEN p + 1 ELSE p + 10 END AS v1, p + 9 AS v2 FROM (SELECT range, (range // 2 // 8) * 9 + range // 2 % 8 AS p FROM range(128)))"


@query(f"""WITH r AS (SELECT range AS pid, 4.0 - 4.5 + (range % 24 + 0.5) * 0.375 AS ox, 4.0 + 4.5 - (range // 24 + 0.5) * 0.375 AS oy FROM range(576)), t AS (SELECT tri_id, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2 FROM {_TRIS} JOIN {_PTS} a ON a.pt_id = v0 JOIN {_PTS} b ON b.pt_id = v1 JOIN {_PTS} c ON c.pt_id = v2),
    h AS (SELECT pid, tri_id, z0, z1, z2, ((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) AS det, ((ox - x0) * (y2 - y0) - (oy - y0) * (x2 - x0)) AS nu, ((x1 - x0) * (oy - y0) - (y1 - y0) * (ox - x0)) AS nv FROM r, t),
    k AS (SELECT pid, tri_id, nu / det AS u, nv / det AS v, z0, z1, z2 FROM h), m AS (SELECT pid, tri_id, 9.0 - (z0 + u * (z1 - z0) + v * (z2 - z0)) AS t FROM k WHERE u >= 0 AND v >= 0 AND u + v <= 1) SELECT pid, round(min(t), 6) AS t FROM m GROUP BY pid""")
def ray_triangle(spark, d):
    """Nearest hit of each ray through the grid-bucketed join."""
    return bvh.Grid(*height_mesh(spark), cells=8).closest(_mesh_rays(spark), ["pid"]).select("pid", F.round("t", 6).alias("t"))


@query(f"SELECT range AS pid FROM range(576) WHERE 4.0 - 4.5 + (range % 24 + 0.5) * 0.375 BETWEEN 0 AND 8 AND 4.0 + 4.5 - (range // 24 + 0.5) * 0.375 BETWEEN 0 AND 8")
def shadow_rays(spark, d):
    """Rays that meet anything within a distance."""
    rays = _mesh_rays(spark).withColumn("dist", F.lit(20.0))
    return bvh.Grid(*height_mesh(spark), cells=8).blocked(rays, ["pid"], "dist")


_Q = lambda c: f"least(1023, trunc((t.{c} - b.{c}0) / (b.{c}1 - b.{c}0) * 1024.0))::BIGINT"
_SPREAD = lambda e: "(" + " | ".join(f"((({e} >> {k}) & 1) << {3 * k})" for k in range(10)) + ")"


@query(f"""WITH b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM {_PTS}), t AS (SELECT tri_id, (a.x + b.x + c.x) / 3 AS x, (a.y + b.y + c.y) / 3 AS y, (a.z + b.z + c.z) / 3 AS z FROM {_TRIS} JOIN {_PTS} a ON a.pt_id = v0 JOIN {_PTS} b ON b.pt_id = v1 JOIN {_PTS} c ON c.pt_id = v2),
    q AS (SELECT tri_id, {_Q("x")} AS x, {_Q("y")} AS y, {_Q("z")} AS z FROM t, b), m AS (SELECT tri_id, (({_SPREAD("x")} << 2) | ({_SPREAD("y")} << 1) | {_SPREAD("z")})::BIGINT AS code FROM q) SELECT tri_id, code, row_number() OVER (ORDER BY code, tri_id) - 1 AS place FROM m""")
def bvh_order(spark, d):
    return bvh.morton_order(*height_mesh(spark)).select("tri_id", "code", "place")


@query("SELECT range AS node, CASE WHEN range = 0 THEN NULL ELSE (range - 1) // 2 END AS parent FROM range(1, 15)")
def tree_parents(spark, d):
    n = spark.range(7).select(F.col("id").alias("node"), (F.col("id") * 2 + 1).alias("left"), (F.col("id") * 2 + 2).alias("right"))
    return bvh.parents(n)


@query("""WITH RECURSIVE s AS (SELECT event_id // 16 AS pid, event_id % 16 AS step, least(10, trunc(least(1.0, greatest(0.0, value / 300.0))::DOUBLE * 10.0)::INT) / 10.0 AS c FROM events), a AS (SELECT pid, step, c, 1.0 - exp(-(0.5 * c) * 2.0 * 0.5) AS al FROM s),
    f(pid, step, r, al) AS (SELECT pid, -1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT pid FROM a) UNION ALL SELECT f.pid, f.step + 1, CASE WHEN f.al > 0.99 THEN f.r ELSE f.r + (1 - f.al) * a.al * a.c END, CASE WHEN f.al > 0.99 THEN f.al ELSE f.al + (1 - f.al) * a.al END FROM f JOIN a ON a.pid = f.pid AND a.step = f.step + 1)
    SELECT pid, round(r + (1 - al) * 0.25, 6) AS r, round(al, 6) AS alpha FROM f QUALIFY step = max(step) OVER (PARTITION BY pid)""")
def volume_composite(spark, d):
    s = table(spark, d, "events").select(F.expr("event_id div 16").alias("pid"), (F.col("event_id") % 16).alias("step"), F.col("value").alias("val"))
    out = volume.composite(s, ["pid"], "step", colour.TransferFunction("grayscale", n=11, range_=(0.0, 300.0)), 0.5, 2.0, (0.25, 0.25, 0.25))
    return out.select("pid", F.round("r", 6).alias("r"), F.round("alpha", 6).alias("alpha"))


@query(None)
def volume_render(spark, d):
    cam = camera.perspective((0, 0, 5), (0, 0, 0), width=16, height=16)
    return volume.render(cam, _voxels(spark), (_N,) * 3, (-1, -1, -1), (1, 1, 1), colour.TransferFunction("cool_to_warm", n=64, range_=(0.0, 6.1)), 0.1)


@query(f"""WITH RECURSIVE p AS (SELECT range AS pid, -1.2e0 + (range % 16 + 0.5e0) * 0.15e0 AS ox, 1.2e0 - (range // 16 + 0.5e0) * 0.15e0 AS oy FROM range(256)),
    q AS (SELECT pid, k.range AS step, (ox + 1) / 2 * 7 AS a, (oy + 1) / 2 * 7 AS b, (5 - (4 + k.range * 0.1e0) + 1) / 2 * 7 AS c FROM p, range(20) k WHERE abs(ox) <= 1 AND abs(oy) <= 1),
    o AS (SELECT q.*, floor(a)::INT + x.range AS ia, floor(b)::INT + y.range AS ib, floor(c)::INT + z.range AS ic, CASE WHEN x.range = 1 THEN a - floor(a) ELSE 1 - (a - floor(a)) END * CASE WHEN y.range = 1 THEN b - floor(b) ELSE 1 - (b - floor(b)) END * CASE WHEN z.range = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END AS w FROM q, range(2) x, range(2) y, range(2) z),
    s AS (SELECT pid, step, sum(w * s) AS val FROM o JOIN {_VOX} v ON v.ix = least(7, ia) AND v.iy = least(7, ib) AND v.iz = least(7, ic) GROUP BY 1, 2),
    e AS (SELECT pid, step, least(10, trunc(least(1.0e0, greatest(0.0e0, val / 6.1e0)) * 10)) / 10 AS c FROM s), t AS (SELECT *, 1 - exp(-(0.5e0 * c) * 4 * 0.1e0) AS al FROM e),
    f(pid, step, r, al) AS (SELECT pid, -1::BIGINT, 0.0e0, 0.0e0 FROM p UNION ALL SELECT f.pid, f.step + 1, CASE WHEN f.al > 0.99e0 THEN f.r ELSE f.r + (1 - f.al) * t.al * t.c END, CASE WHEN f.al > 0.99e0 THEN f.al ELSE f.al + (1 - f.al) * t.al END FROM f JOIN t ON t.pid = f.pid AND t.step = f.step + 1)
    SELECT pid, round(r, 6) AS r, round(al, 6) AS alpha FROM f QUALIFY step = max(step) OVER (PARTITION BY pid)""")
def volume_render_parallel(spark, d):
    """Parallel rays through a volume, shaded from black to white."""
    cam = camera.orthographic((0, 0, 5), (0, 0, 0), view_height=2.4, width=16, height=16)
    out = volume.render(cam, _voxels(spark), (_N,) * 3, (-1, -1, -1), (1, 1, 1), colour.TransferFunction("grayscale", n=11, range_=(0.0, 6.1)), 0.1, 4.0)
    return out.select("pid", F.round("r", 6).alias("r"), F.round("alpha", 6).alias("alpha"))


@query("""SELECT event_id, arg_max(b, lvl * 100 + b)::BIGINT AS block_id FROM (SELECT event_id, (event_id % 64) / 4.0 AS x, (event_id % 48) / 4.0 AS y FROM events) p JOIN (SELECT range AS b, CASE WHEN range = 0 THEN 0 ELSE 1 END AS lvl, CASE WHEN range = 0 THEN 0 ELSE range * 4.0 END AS lx, CASE WHEN range = 0 THEN 16.0 ELSE range * 4.0 + 3 END AS hx FROM range(4)) k ON x >= lx AND x < hx AND y < 16 GROUP BY 1""")
def block_lookup(spark, d):
    e = F.col("event_id")
    p = table(spark, d, "events").select("event_id", (e % 64 / 4.0).alias("x"), (e % 48 / 4.0).alias("y"), F.lit(1.0).alias("z"))
    i = F.col("id")
    b = spark.range(4).select(i.alias("block_id"), F.when(i == 0, 0).otherwise(1).alias("level"), F.when(i == 0, 0.0).otherwise(i * 4.0).alias("lo_x"), F.when(i == 0, 16.0).otherwise(i * 4.0 + 3).alias("hi_x"), F.lit(0.0).alias("lo_y"), F.lit(16.0).alias("hi_y"), F.lit(0.0).alias("lo_z"), F.lit(16.0).alias("hi_z"))
    return volume.block_lookup(p, b, 4.0).select("event_id", "block_id")


@query("""WITH p AS (SELECT vec_id AS id, trunc((embedding[1]::DOUBLE / 1.0 * 0.5 + 0.5) * 32)::BIGINT AS sx, trunc((0.5 - embedding[2]::DOUBLE * 0.5) * 32)::BIGINT AS sy, embedding[3]::DOUBLE AS z FROM embeddings), f AS (SELECT id, sx + a.range - 1 AS x, sy + b.range - 1 AS y, z FROM p, range(3) a, range(3) b WHERE abs(a.range - 1) + abs(b.range - 1) <= 1)
    SELECT y * 32 + x AS pid, arg_max(id, z - id / 1e12) AS id FROM f WHERE x BETWEEN 0 AND 31 AND y BETWEEN 0 AND 31 GROUP BY 1""")
def raster_points(spark, d):
    """Discs of radius 1 under a parallel camera; the nearest point of each pixel."""
    e = F.col("embedding")
    pts = table(spark, d, "embeddings").select(F.col("vec_id").alias("pt_id"), *[F.get(e, F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")])
    cam = camera.orthographic((0, 0, 5), (0, 0, 0), view_height=2.0, width=32, height=32)
    return raster.nearest(raster.point_fragments(pts, cam, 1)).select("pid", "id")


@query(None)
def raster_wireframe(spark, d):
    pts, tris = height_mesh(spark)
    cam = camera.perspective((4, 4, 14), (4, 4, 0), width=48, height=48)
    return raster.to_bytes(raster.resolve(raster.over(raster.clear(spark, 48, 48), raster.wire_fragments(pts, tris, cam))))


@query(None)
def path_trace(spark, d):
    """A height field, a mirror and a glass pane under two lights; 12 x 12 pixels, one bounce."""
    pts, tris = height_mesh(spark)
    pane = spark.createDataFrame([(0, 1.0, 1.0, 4.0), (1, 4.0, 1.0, 4.0), (2, 1.0, 4.0, 4.0)], "pt_id long, x double, y double, z double")
    one = spark.createDataFrame([(0, 0, 1, 2)], "tri_id long, v0 long, v1 long, v2 long")
    glass = pane.withColumn("x", F.col("x") + 3.5)
    scene = Scene([Actor(pts, tris, (0.6, 0.7, 0.8)), Actor(pane, one, material=Material(MIRROR), smooth=False), Actor(glass, one, material=Material(GLASS, 1.5), smooth=False)], [Light((4.0, 4.0, 9.0), 40.0), Light((0.0, 0.6, 0.8), 0.5, directional=True)], (0.1, 0.1, 0.2))
    return pathtrace.trace(scene, camera.perspective((4, 4, 14), (4, 4, 0), width=12, height=12), spark, 1, 1, cells=8)


ORACLES["orthographic_rays"] = doubles(ORACLES["orthographic_rays"], "ox", "oy")
