"""Sampling of volumes and volume ray casting. Voxels are (ix, iy, iz, s), x fastest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.camera import Camera
from fieldloom.operators.colour import TransferFunction


def _corners(points: DataFrame, voxels: DataFrame, shape: tuple[int, int, int], at: list[Column], key: list[str], out: str, clamp_index: bool) -> DataFrame:
    """Eight corners a point, joined to the voxels, weighted and summed."""
    df = points.withColumns({f"__f{d}": c for d, c in enumerate(at)})
    df = df.withColumns({f"__b{d}": F.floor(f"__f{d}").cast("int") for d in range(3)})
    df = df.withColumns({f"__w{d}": F.col(f"__f{d}") - F.col(f"__b{d}") for d in range(3)})
    offs = F.explode(F.array(*[F.struct(*[F.lit(o >> d & 1).alias(f"o{d}") for d in range(3)]) for o in range(8)])).alias("__o")
    rows = df.select(*key, *[f"__b{d}" for d in range(3)], *[f"__w{d}" for d in range(3)], offs)
    names = ("ix", "iy", "iz")
    place = lambda d: F.col(f"__b{d}") + F.col(f"__o.o{d}")
    rows = rows.withColumns({n: (F.greatest(F.lit(0), F.least(F.lit(shape[d] - 1), place(d))) if clamp_index else place(d)) for d, n in enumerate(names)})
    weight = reduce(lambda a, b: a * b, [F.when(F.col(f"__o.o{d}") == 1, F.col(f"__w{d}")).otherwise(1.0 - F.col(f"__w{d}")) for d in range(3)])
    got = rows.withColumn("__w", weight).join(voxels, list(names)).groupBy(*key).agg(F.sum(F.col("__w") * F.col("s")).alias(out))
    return points.join(got, key)


def texture_sample(points: DataFrame, voxels: DataFrame, shape: tuple[int, int, int], key: list[str], uvw=("u", "v", "w"), out: str = "val") -> DataFrame:
    """Trilinear; corner indices are clamped to the volume, weights are not."""
    at = [F.col(c) * float(n - 1) for c, n in zip(uvw, shape, strict=True)]
    return _corners(points, voxels, shape, at, key, out, True)


def volume_sample(points: DataFrame, voxels: DataFrame, shape: tuple[int, int, int], key: list[str], uvw=("u", "v", "w"), out: str = "val") -> DataFrame:
    """Trilinear with the coordinate clamped to [0, n - 2] first, so 1 gives voxel n - 2."""
    at = [F.least(F.lit(float(n - 2)), F.greatest(F.lit(0.0), F.col(c) * float(n - 1))) for c, n in zip(uvw, shape, strict=True)]
    return _corners(points, voxels, shape, at, key, out, True)


def slab(lo, hi, origin: str = "o", direction: str = "d") -> tuple[Column, Column]:
    """Entry and exit of a ray (ox .. dz) in a box; an axis-parallel ray outside gives an empty interval."""
    near, far = F.lit(-3.4e38), F.lit(3.4e38)
    miss = F.lit(False)
    for k, a in enumerate("xyz"):
        o, d = F.col(f"{origin}{a}"), F.col(f"{direction}{a}")
        flat = F.abs(d) < 1e-10
        safe = F.when(flat, F.lit(1.0)).otherwise(d)
        t1, t2 = (float(lo[k]) - o) / safe, (float(hi[k]) - o) / safe
        near = F.when(flat, near).otherwise(F.greatest(near, F.least(t1, t2)))
        far = F.when(flat, far).otherwise(F.least(far, F.greatest(t1, t2)))
        miss = miss | (flat & ((o < float(lo[k])) | (o > float(hi[k]))))
    return F.when(miss, F.lit(3.4e38)).otherwise(near), F.when(miss, F.lit(-3.4e38)).otherwise(far)


def composite(samples: DataFrame, pixel: list[str], step: str, tf: TransferFunction, step_size: float, scale: float, background=(0.0, 0.0, 0.0)) -> DataFrame:
    """Front to back: (pixel, step, val) to (pixel, r, g, b, alpha). A pixel's samples are ordered in an array that its
    number of steps bounds; past an opacity of 0.99 samples add nothing."""
    e = tf.entry(F.col("val"))
    rows = samples.withColumn("e", e)
    a = F.least(F.lit(1.0), 1.0 - F.exp(-F.get("e", F.lit(3)) * float(scale) * float(step_size)))
    rows = rows.select(*pixel, F.struct(F.col(step).alias("step"), *[F.get("e", F.lit(c)).alias(n) for c, n in enumerate("rgb")], a.alias("a")).alias("s"))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in "rgba"])

    def add(acc: Column, s: Column) -> Column:
        w = (1.0 - acc["a"]) * s["a"]
        new = F.struct(*[(acc[n] + w * s[n]).alias(n) for n in "rgb"], (acc["a"] + w).alias("a"))
        return F.when(acc["a"] > 0.99, acc).otherwise(new)

    got = rows.groupBy(*pixel).agg(F.aggregate(F.array_sort(F.collect_list("s")), zero, add).alias("c"))
    return got.select(*pixel, *[(F.col(f"c.{n}") + (1.0 - F.col("c.a")) * float(background[k])).alias(n) for k, n in enumerate("rgb")], F.col("c.a").alias("alpha"))


def render(camera: Camera, voxels: DataFrame, shape: tuple[int, int, int], lo, hi, tf: TransferFunction, step: float, scale: float = 1.0, max_steps: int = 512, background=(0.0, 0.0, 0.0)) -> DataFrame:
    """One ray a pixel through a volume between corners lo and hi: (pid, r, g, b, alpha)."""
    rays = camera.rays(voxels.sparkSession)
    near, far = slab(lo, hi)
    rays = rays.withColumns({"t0": F.greatest(F.lit(0.0), near), "t1": far})
    count = F.least(F.lit(max_steps), F.ceil((F.col("t1") - F.col("t0")) / step).cast("int"))
    hit = rays.where("t0 < t1").withColumn("step", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("t", F.col("t0") + F.col("step") * step)
    uvw = {n: (F.col(f"o{a}") + F.col("t") * F.col(f"d{a}") - float(lo[k])) / (float(hi[k] - lo[k]) + 1e-20) for k, (n, a) in enumerate(zip("uvw", "xyz", strict=True))}
    pts = hit.where("t < t1").withColumns(uvw).select("pid", "step", "u", "v", "w")
    seen = composite(texture_sample(pts, voxels, shape, ["pid", "step"]), ["pid"], "step", tf, step, scale, background)
    fill = {n: float(background[k]) for k, n in enumerate("rgb")} | {"alpha": 0.0}
    return rays.select("pid").join(seen, "pid", "left").na.fill(fill)


def block_lookup(points: DataFrame, blocks: DataFrame, cell: float) -> DataFrame:
    """World positions (x, y, z) to the finest block that holds them: (lo_, hi_ exclusive) boxes are copied to the grid cells they
    meet, points join on their cell, the highest level wins."""
    at = lambda c: F.floor(c / cell)
    b = blocks
    for d in "xyz":
        b = b.withColumn(f"g{d}", F.explode(F.sequence(at(F.col(f"lo_{d}")), at(F.col(f"hi_{d}")))))
    p = points.withColumns({f"g{d}": at(F.col(d)) for d in "xyz"})
    hit = reduce(lambda x, y: x & y, [(F.col(d) >= F.col(f"lo_{d}")) & (F.col(d) < F.col(f"hi_{d}")) for d in "xyz"])
    both = p.join(b, ["gx", "gy", "gz"]).where(hit)
    return both.groupBy(*points.columns).agg(F.max_by("block_id", F.struct("level", "block_id")).alias("block_id"))


