"""Rasterising of points and wireframes, framebuffers, annotations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.camera import Camera


def clear(spark: SparkSession, width: int, height: int, colour=(0.0, 0.0, 0.0)) -> DataFrame:
    """(pid, r, g, b, depth), depth at infinity."""
    return spark.range(width * height).select(F.col("id").alias("pid"), *[F.lit(float(c)).alias(n) for n, c in zip("rgb", colour, strict=True)], F.lit(1e30).alias("depth"))


def nearest(fragments: DataFrame) -> DataFrame:
    """Depth test: of each pixel's fragments (pid, depth, r, g, b, id) the nearest, ties to the smallest id."""
    got = fragments.groupBy("pid").agg(F.min(F.struct("depth", "id", "r", "g", "b")).alias("f"))
    return got.select("pid", *[F.col(f"f.{c}").alias(c) for c in ("r", "g", "b", "depth", "id")])


def over(buffer: DataFrame, fragments: DataFrame) -> DataFrame:
    """A framebuffer with nearer fragments drawn."""
    new = nearest(fragments).select("pid", *[F.col(c).alias(f"n_{c}") for c in ("r", "g", "b", "depth")])
    both = buffer.join(new, "pid", "left")
    hit = F.col("n_depth").isNotNull() & (F.col("n_depth") <= F.col("depth"))
    return both.select("pid", *[F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("r", "g", "b", "depth")])


def point_fragments(points: DataFrame, camera: Camera, radius: int = 1) -> DataFrame:
    """Discs of whole pixels around visible points (pt_id, x, y, z[, r, g, b])."""
    disc = [(a, b) for b in range(-radius, radius + 1) for a in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    rgb = [F.col(c) if c in points.columns else F.lit(0.8).alias(c) for c in "rgb"]
    at = camera.project(points).where("visible").select(F.col("pt_id").alias("id"), "sx", "sy", "depth", *rgb)
    at = at.withColumn("o", F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in disc])))
    at = at.withColumns({"px": F.col("sx").cast("int") + F.col("o.x"), "py": F.col("sy").cast("int") + F.col("o.y")})
    return _inside(at, camera).select("pid", "depth", "r", "g", "b", "id")


def _inside(df: DataFrame, camera: Camera) -> DataFrame:
    ok = (F.col("px") >= 0) & (F.col("px") < camera.width) & (F.col("py") >= 0) & (F.col("py") < camera.height)
    return df.where(ok).withColumn("pid", F.col("py").cast("bigint") * camera.width + F.col("px"))


def wire_fragments(points: DataFrame, tris: DataFrame, camera: Camera) -> DataFrame:
    """Edges of triangles (tri_id, v0, v1, v2[, r, g, b]) with both ends visible, one fragment a step along the longer axis,
    depth interpolated. Along the shorter axis the line steps as Bresenham's does: to the nearest pixel, halves towards its start."""
    scr = camera.project(points).select("pt_id", F.col("sx").cast("int").alias("x"), F.col("sy").cast("int").alias("y"), "depth", "visible")
    rgb = [F.col(c) if c in tris.columns else F.lit(0.8).alias(c) for c in "rgb"]
    pairs = F.explode(F.array(*[F.struct(F.col(a).alias("p"), F.col(b).alias("q")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])).alias("e")
    e = tris.select(F.col("tri_id").alias("id"), *rgb, pairs).select("id", "r", "g", "b", "e.p", "e.q")
    for k in "pq":
        e = e.join(scr.select(F.col("pt_id").alias(k), *[F.col(c).alias(f"{c}{k}") for c in ("x", "y", "depth", "visible")]), k)
    e = e.where("visiblep and visibleq").withColumn("n", F.greatest(F.abs(F.col("xq") - F.col("xp")), F.abs(F.col("yq") - F.col("yp")), F.lit(1)))
    e = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("t", F.col("k") / F.col("n"))
    lerp = lambda c: F.col(f"{c}p") + F.col("t") * (F.col(f"{c}q") - F.col(f"{c}p"))
    along = lambda c: F.expr(f"cast((2 * abs({c}q - {c}p) * k + n - 1) div (2 * n) as int)") * F.signum(F.col(f"{c}q") - F.col(f"{c}p")).cast("int")
    e = e.withColumns({"px": F.col("xp") + along("x"), "py": F.col("yp") + along("y"), "depth": lerp("depth")})
    return _inside(e, camera).select("pid", "depth", "r", "g", "b", "id")


def resolve(buffer: DataFrame, samples: int = 1, gamma: float = 0.4545) -> DataFrame:
    """Mean of the samples, clamped and gamma-corrected."""
    return buffer.withColumns({c: F.pow(F.least(F.lit(1.0), F.col(c) / float(samples)), gamma) for c in "rgb"})


def to_bytes(buffer: DataFrame) -> DataFrame:
    """Channels as 0 .. 255."""
    return buffer.withColumns({c: F.greatest(F.lit(0), F.least(F.lit(255), (F.col(c) * 255.0).cast("int"))) for c in "rgb"})


def to_numpy(buffer: DataFrame, width: int, height: int) -> np.ndarray:
    """(height, width, 4) uint8 of an image that the driver holds."""
    rows = to_bytes(buffer).orderBy("pid").select("r", "g", "b").toPandas().to_numpy()
    return np.concatenate([rows, np.full((len(rows), 1), 255)], 1).astype(np.uint8).reshape(height, width, 4)


# annotations of a collected image
def draw_line(img: np.ndarray, a, b, colour) -> np.ndarray:
    out = img.copy()
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1)
    for k in range(n + 1):
        x, y = round(a[0] + (b[0] - a[0]) * k / n), round(a[1] + (b[1] - a[1]) * k / n)
        if 0 <= x < img.shape[1] and 0 <= y < img.shape[0]:
            out[y, x, : len(colour)] = colour
    return out


def draw_rect(img: np.ndarray, lo, hi, colour) -> np.ndarray:
    out = img.copy()
    out[max(0, lo[1]) : hi[1], max(0, lo[0]) : hi[0], : len(colour)] = colour
    return out


def colour_bar(img: np.ndarray, table: np.ndarray, lo, hi) -> np.ndarray:
    """A vertical bar of a colour table, its last entry on top."""
    out = img.copy()
    h = hi[1] - lo[1]
    rows = table[np.round(np.linspace(len(table) - 1, 0, h)).astype(int)]
    out[lo[1] : hi[1], lo[0] : hi[0], :3] = (rows[:, None, :] * 255).astype(np.uint8)
    return out


def axis_indicator(img: np.ndarray, camera: Camera, at, size: int) -> np.ndarray:
    """The world's axes as red, green and blue lines."""
    for k, colour in enumerate(((255, 0, 0), (0, 255, 0), (0, 0, 255))):
        end = (round(at[0] + camera.right[k] * size), round(at[1] - camera.up[k] * size))
        img = draw_line(img, at, end, colour)
    return img
