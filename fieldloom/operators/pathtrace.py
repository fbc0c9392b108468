"""Path tracing as a loop of joins: rays meet triangles, shadow rays are left out by an anti join, expressions shade."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import bits
from fieldloom.operators import raster
from fieldloom.operators.bvh import Grid
from fieldloom.operators.camera import Camera
from fieldloom.operators.scene import GLASS, MATTE, Scene
from fieldloom.sources.scratch import materialized

OFFSET = 0.005
KEY = ["pid", "samp"]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _v(p: str) -> list[Column]:
    return [F.col(f"{p}{a}") for a in "xyz"]


def _names(p: str, v: list[Column]) -> dict[str, Column]:
    return {f"{p}{a}": c for a, c in zip("xyz", v, strict=True)}


def trace(scene: Scene, camera: Camera, spark: SparkSession, samples: int = 1, bounces: int = 2, cells: int | None = None) -> DataFrame:
    """(pid, r, g, b, depth): summed samples are averaged; depth is the first sample's first hit, -1 for none."""
    prepared = scene.prepare("solid")
    rays = spark.range(camera.width * camera.height).select(F.col("id").alias("pid"))
    rays = rays.withColumns({"px": F.col("pid") % camera.width, "py": F.call_function("div", F.col("pid"), F.lit(camera.width).cast("bigint"))})
    rays = rays.withColumn("samp", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("seed", bits.pixel_hash(F.col("pid")) + F.col("samp"))
    rays = camera.shoot(rays, (bits.halton(F.col("seed"), 2, 32) - 0.5, bits.halton(F.col("seed"), 3, 21) - 0.5))
    state = rays.select(*KEY, "seed", *[f"{k}{a}" for k in "od" for a in "xyz"], *[F.lit(1.0).alias(f"t{c}") for c in "rgb"], *[F.lit(0.0).alias(c) for c in "rgb"])
    state = materialized(state)
    bg = {c: F.col(c) + F.col(f"t{c}") * float(v) for c, v in zip("rgb", scene.background, strict=True)}
    if prepared is None:
        done = state.withColumns(bg).select(*KEY, "r", "g", "b", F.lit(-1.0).alias("depth"))
        return _summed(done, samples)
    points, tris = prepared
    grid = Grid(points, tris, cells)
    at = points.select("pt_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b")])
    corner = tris
    for k in range(3):
        corner = corner.join(at.select(F.col("pt_id").alias(f"v{k}"), F.struct("x", "y", "z", "nx", "ny", "nz", "r", "g", "b").alias(f"p{k}")), f"v{k}")
    ended, depth = [], None
    for bounce in range(bounces + 1):
        hit = grid.closest(state, KEY)
        seen = materialized(state.join(hit, KEY, "left"))
        if bounce == 0:
            depth = seen.where("samp = 0").select("pid", F.coalesce("t", F.lit(-1.0)).alias("depth"))
        ended.append(seen.where("t is null").withColumns(bg).select(*KEY, "r", "g", "b"))
        lit = materialized(_direct(materialized(_surface(seen.where("t is not null"), corner)), grid, scene))
        if bounce == bounces:
            ended.append(lit.select(*KEY, "r", "g", "b"))
        else:
            state = materialized(_bounce(lit, bounce, bounces))
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return _summed(out, samples).join(depth, "pid")


def _summed(df: DataFrame, samples: int) -> DataFrame:
    agg = [(F.sum(c) / float(samples)).alias(c) for c in "rgb"] + ([F.min("depth").alias("depth")] if "depth" in df.columns else [])
    return df.groupBy("pid").agg(*agg)


def _surface(rays: DataFrame, corner: DataFrame) -> DataFrame:
    """Adds hit point h, the normal n that faces the ray, dn (its product with the ray before facing) and albedo."""
    df = rays.join(corner.select("tri_id", "p0", "p1", "p2", "kind", "ior"), "tri_id")
    w = [1.0 - F.col("u") - F.col("v"), F.col("u"), F.col("v")]
    mix = lambda c: sum((w[k] * F.col(f"p{k}.{c}") for k in range(3)), F.lit(0.0))
    e1, e2 = [[F.col(f"p{k}.{a}") - F.col(f"p0.{a}") for a in "xyz"] for k in (1, 2)]
    face = [e1[1] * e2[2] - e1[2] * e2[1], e1[2] * e2[0] - e1[0] * e2[2], e1[0] * e2[1] - e1[1] * e2[0]]
    df = df.withColumns(_names("f", face) | {f"s{a}": mix(f"n{a}") for a in "xyz"} | _names("h", [F.col(f"o{a}") + F.col("t") * F.col(f"d{a}") for a in "xyz"]) | {f"a{c}": mix(c) for c in "rgb"})
    df = df.withColumns({"fl": F.sqrt(_dot(_v("f"), _v("f"))) + 1e-20, "sl": F.sqrt(_dot(_v("s"), _v("s")))})
    df = df.withColumns(_names("n", [F.when(F.col("sl") > 0.01, F.col(f"s{a}") / F.col("sl")).otherwise(F.col(f"f{a}") / F.col("fl")) for a in "xyz"]))
    df = df.withColumn("dn", _dot(_v("n"), _v("d"))).withColumns(_names("n", [F.when(F.col("dn") > 0, -c).otherwise(c) for c in _v("n")]))
    return df.drop("p0", "p1", "p2", "fx", "fy", "fz", "sx", "sy", "sz", "fl", "sl", "u", "v")


def _direct(hits: DataFrame, grid: Grid, scene: Scene) -> DataFrame:
    """Adds matte surfaces' light: a row for each light, less those with a shadow ray that is blocked."""
    lights = [F.struct(*[F.lit(float(x)).alias(f"p{a}") for a, x in zip("xyz", s.xyz, strict=True)], F.lit(float(s.intensity)).alias("i"), *[F.lit(float(x)).alias(c) for c, x in zip("rgb", s.colour, strict=True)], F.lit(s.directional).alias("far")) for s in scene.lit()]
    m = hits.where(F.col("kind") == MATTE).select(*KEY, *[f"{k}{a}" for k in "hn" for a in "xyz"], F.posexplode(F.array(*lights)).alias("light", "l"))
    to = [F.col(f"l.p{a}") - F.col(f"h{a}") for a in "xyz"]
    m = m.withColumn("dist", F.when(F.col("l.far"), F.lit(1e20)).otherwise(F.sqrt(_dot(to, to)) + 1e-20))
    m = m.withColumns(_names("d", [F.when(F.col("l.far"), F.col(f"l.p{a}")).otherwise((F.col(f"l.p{a}") - F.col(f"h{a}")) / F.col("dist")) for a in "xyz"]))
    m = m.withColumns(_names("o", [F.col(f"h{a}") + F.col(f"n{a}") * OFFSET for a in "xyz"]))
    key = [*KEY, "light"]
    open_ = m.join(grid.blocked(m.select(*key, "dist", *[f"{k}{a}" for k in "od" for a in "xyz"]), key, "dist"), key, "left_anti")
    c = F.col("l.i") * F.greatest(F.lit(0.0), _dot(_v("n"), _v("d"))) / F.when(F.col("l.far"), F.lit(1.0)).otherwise(F.col("dist") * F.col("dist"))
    got = open_.groupBy(*KEY).agg(*[F.sum(c * F.col(f"l.{ch}")).alias(f"l{ch}") for ch in "rgb"])
    out = hits.join(got, KEY, "left")
    return out.withColumns({ch: F.col(ch) + F.col(f"t{ch}") * F.col(f"a{ch}") * F.coalesce(f"l{ch}", F.lit(0.0)) for ch in "rgb"}).drop("lr", "lg", "lb")


def _bounce(df: DataFrame, bounce: int, bounces: int) -> DataFrame:
    """The next ray: cosine-weighted for matte, mirrored, or refracted with Schlick's reflectance (total reflection beyond the critical angle)."""
    n, d = _v("n"), _v("d")
    seq = bits.pixel_hash(F.col("seed") * (bounces + 1) + bounce)
    df = df.withColumn("q", seq).withColumns({"u1": bits.halton(F.col("q"), 2, 32), "u2": bits.halton(F.col("q"), 3, 21)})
    steep = F.abs(F.col("ny")) > 0.9
    ref = [F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0), F.lit(0.0)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    df = df.withColumns(_names("g", cross(n, ref)))
    df = df.withColumn("gl", F.sqrt(_dot(_v("g"), _v("g"))) + 1e-20).withColumns(_names("g", [c / F.col("gl") for c in _v("g")]))
    df = df.withColumns(_names("b_", cross(n, _v("g"))))
    r, th = F.sqrt(F.col("u1")), 2.0 * math.pi * F.col("u2")
    matte = [r * F.cos(th) * g + r * F.sin(th) * b + F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("u1"))) * c for g, b, c in zip(_v("g"), _v("b_"), n, strict=True)]
    mirror = [x - 2.0 * _dot(d, n) * c for x, c in zip(d, n, strict=True)]
    inside = F.col("dn") > 0  # leaving the glass; n already faces the ray
    eta = F.when(inside, F.col("ior")).otherwise(1.0 / F.col("ior"))
    df = df.withColumns({"eta": eta, "ci": F.greatest(F.lit(0.0), -_dot(d, n))}).withColumn("s2", F.col("eta") * F.col("eta") * (1.0 - F.col("ci") * F.col("ci")))
    r0 = F.pow((1.0 - F.col("ior")) / (1.0 + F.col("ior")), 2)
    df = df.withColumn("fr", r0 + (1.0 - r0) * F.pow(1.0 - F.col("ci"), 5))
    through = (F.col("kind") == GLASS) & (F.col("s2") <= 1.0) & (F.col("u1") >= F.col("fr"))
    ct = F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("s2")))
    bent = [F.col("eta") * x + (F.col("eta") * F.col("ci") - ct) * c for x, c in zip(d, n, strict=True)]
    df = df.withColumn("through", through)
    new = [F.when(F.col("kind") == MATTE, a).when(F.col("through"), b).otherwise(c) for a, b, c in zip(matte, bent, mirror, strict=True)]
    start = [F.col(f"h{a}") + F.when(F.col("through"), -OFFSET).otherwise(OFFSET) * F.col(f"n{a}") for a in "xyz"]
    out = df.select(*KEY, "seed", *[c.alias(f"o{a}") for a, c in zip("xyz", start, strict=True)], *[c.alias(f"d{a}") for a, c in zip("xyz", new, strict=True)], *[(F.col(f"t{c}") * F.col(f"a{c}")).alias(f"t{c}") for c in "rgb"], "r", "g", "b")
    return out


def render(scene: Scene, camera: Camera, spark: SparkSession, samples: int = 1, bounces: int = 2) -> DataFrame:
    """Dispatch by actors' mode: solids are traced; wireframes and points are drawn over what is there. (pid, r, g, b, depth)"""
    modes = {a.mode for a in scene.actors}
    if "solid" in modes or not modes:
        out = trace(scene, camera, spark, samples, bounces).withColumn("depth", F.when(F.col("depth") < 0, F.lit(1e30)).otherwise(F.lit(1e29)))
        out = raster.resolve(out)
    else:
        out = raster.clear(spark, camera.width, camera.height, scene.background)
    for mode, draw in (("wireframe", lambda p, t: raster.wire_fragments(p, t, camera)), ("points", lambda p, t: raster.point_fragments(p, camera))):
        if mode in modes:
            p, t = scene.prepare(mode)
            out = raster.over(out, draw(p, t))
    return out


