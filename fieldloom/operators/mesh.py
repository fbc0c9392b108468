"""Cell sets, averages, normals, measures, thresholds on meshes.

Points are (pt_id, x, y, z[, arrays]), cells (cell_id, local_idx, pt_id), triangles (tri_id, v0, v1, v2).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.scan import dense_index
from fieldloom.sources.field import unpack


def bounds(points: DataFrame) -> DataFrame:
    """min and max of each coordinate in one aggregate."""
    return points.agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"])


#: Corner offsets of a hexahedron in the cell's point order (x, y, z).
HEX = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
QUAD = HEX[:4]


def structured_cells(spark: SparkSession, nx: int, ny: int, nz: int = 0) -> DataFrame:
    """Explicit connectivity of a grid of nx x ny (x nz) cells, x fastest; quads where nz is 0."""
    if nz:
        cells = spark.range(nx * ny * nz).select(F.col("id").alias("cell_id"))
        k, j, i = unpack(F.col("cell_id"), (nz, ny, nx))
        corners, plane = HEX, (nx + 1) * (ny + 1)
    else:
        cells = spark.range(nx * ny).select(F.col("id").alias("cell_id"))
        (j, i), k = unpack(F.col("cell_id"), (ny, nx)), F.lit(0).cast("bigint")
        corners, plane = QUAD, 0
    pts = F.array(*[(k + c) * plane + (j + b) * (nx + 1) + i + a for a, b, c in corners])
    return cells.select("cell_id", F.posexplode(pts).alias("local_idx", "pt_id"))


def cell_average(cells: DataFrame, points: DataFrame, vals: list[str]) -> DataFrame:
    """Point to cell: the mean of a cell's points, for any cell set and several components."""
    return cells.join(points.select("pt_id", *vals), "pt_id").groupBy("cell_id").agg(*[F.avg(v).alias(v) for v in vals])


def cell_to_point(cells: DataFrame, nx: int, ny: int, nz: int, val: str = "val") -> DataFrame:
    """Each node's mean over its up to 8 cells: a cell is copied to its corners, then one aggregate."""
    k, j, i = unpack(F.col("cell_id"), (nz, ny, nx))
    nodes = F.array(*[((k + c) * (ny + 1) + j + b) * (nx + 1) + i + a for a, b, c in HEX])
    return cells.select(F.explode(nodes).alias("pt_id"), val).groupBy("pt_id").agg(F.avg(val).alias(val))


def _vertices(tris: DataFrame, points: DataFrame) -> DataFrame:
    out = tris
    for k in range(3):
        out = out.join(points.select(F.col("pt_id").alias(f"v{k}"), *[F.col(c).cast("double").alias(f"{c}{k}") for c in "xyz"]), f"v{k}")
    return out


def _cross(ax, ay, az, bx, by, bz) -> tuple[Column, Column, Column]:
    return ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx


def vertex_normals(points: DataFrame, tris: DataFrame) -> DataFrame:
    """(pt_id, nx, ny, nz): area-weighted sums of face normals, normalised where longer than 1e-10, else 0."""
    v = _vertices(tris, points)
    e = lambda k: [F.col(f"{c}{k}") - F.col(f"{c}0") for c in "xyz"]
    n = _cross(*e(1), *e(2))
    faces = v.select(F.explode(F.array("v0", "v1", "v2")).alias("pt_id"), *[c.alias(f"n{d}") for c, d in zip(n, "xyz", strict=True)])
    sums = faces.groupBy("pt_id").agg(*[F.sum(f"n{d}").alias(f"n{d}") for d in "xyz"])
    size = F.sqrt(sum((F.col(f"n{d}") * F.col(f"n{d}") for d in "xyz"), F.lit(0.0)))
    out = points.select("pt_id").join(sums, "pt_id", "left").withColumn("size", size)
    return out.select("pt_id", *[F.coalesce(F.when(F.col("size") > 1e-10, F.col(f"n{d}") / F.col("size")).otherwise(F.col(f"n{d}")), F.lit(0.0)).alias(f"n{d}") for d in "xyz"])


def triangle_boxes(points: DataFrame, tris: DataFrame, pad: float = 1e-6) -> DataFrame:
    """Each triangle's padded box and centroid."""
    v = _vertices(tris, points)
    box = [c for d in "xyz" for c in ((F.least(*[f"{d}{k}" for k in range(3)]) - pad).alias(f"lo_{d}"), (F.greatest(*[f"{d}{k}" for k in range(3)]) + pad).alias(f"hi_{d}"))]
    return v.select("tri_id", *box, *[((F.col(f"{d}0") + F.col(f"{d}1") + F.col(f"{d}2")) / 3.0).alias(f"c{d}") for d in "xyz"])


def edge_uses(tris: DataFrame) -> DataFrame:
    """(a, b, uses) of undirected edges."""
    pairs = F.explode(F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])).alias("e")
    return tris.select(pairs).groupBy("e.a", "e.b").agg(F.count("*").alias("uses"))


def euler(tris: DataFrame) -> int:
    """V - E + F."""
    v = tris.select(F.explode(F.array("v0", "v1", "v2"))).distinct().count()
    return v - edge_uses(tris).count() + tris.count()


def volume(points: DataFrame, tris: DataFrame) -> DataFrame:
    """Enclosed signed volume."""
    v = _vertices(tris, points)
    c = _cross(*[F.col(f"{d}1") for d in "xyz"], *[F.col(f"{d}2") for d in "xyz"])
    return v.agg((F.sum(sum((F.col(f"{d}0") * x for d, x in zip("xyz", c, strict=True)), F.lit(0.0))) / 6.0).alias("volume"))


def threshold(cells: DataFrame, values: DataFrame, lo: float, hi: float, val: str = "val") -> DataFrame:
    """Cells whose value is in [lo, hi], renumbered densely in order: (cell_id, local_idx, pt_id, old_id). Points stay."""
    kept = dense_index(values.where(F.col(val).between(lo, hi)).select(F.col("cell_id").alias("old_id")), ["old_id"], "new_id")
    return cells.withColumnRenamed("cell_id", "old_id").join(kept, "old_id").select(F.col("new_id").alias("cell_id"), "local_idx", "pt_id", "old_id")


def elevation(direction: tuple[float, float, float]) -> Column:
    return sum((float(w) * F.col(c) for w, c in zip(direction, "xyz", strict=True)), F.lit(0.0))


def transform_points(points: DataFrame, m: np.ndarray) -> DataFrame:
    """By a 4 x 4 affine matrix, as literal coefficients."""
    m = np.asarray(m, float)
    row = lambda r: sum((float(m[r, k]) * F.col(c) for k, c in enumerate("xyz")), F.lit(float(m[r, 3])))
    return points.withColumns({c: row(r) for r, c in enumerate("xyz")})


def transform_normals(normals: DataFrame, m: np.ndarray) -> DataFrame:
    """By the inverse transpose (the matrix itself where singular), renormalised."""
    a = np.asarray(m, float)[:3, :3]
    try:
        a = np.linalg.inv(a).T
    except np.linalg.LinAlgError:
        pass
    raw = normals.withColumns({f"n{c}": sum((float(a[r, k]) * F.col(f"n{d}") for k, d in enumerate("xyz")), F.lit(0.0)) for r, c in enumerate("xyz")})
    size = F.sqrt(sum((F.col(f"n{c}") * F.col(f"n{c}") for c in "xyz"), F.lit(0.0)))
    return raw.withColumn("__s", size).withColumns({f"n{c}": F.when(F.col("__s") > 1e-10, F.col(f"n{c}") / F.col("__s")).otherwise(F.col(f"n{c}")) for c in "xyz"}).drop("__s")


def shape_weights(kind: str, r: float, s: float, t: float) -> list[float]:
    """Shape functions of a hexahedron, tetrahedron or wedge at parametric coordinates."""
    if kind == "hexahedron":
        return [(r if a else 1 - r) * (s if b else 1 - s) * (t if c else 1 - t) for a, b, c in HEX]
    if kind == "tetrahedron":
        return [1 - r - s - t, r, s, t]
    if kind == "wedge":
        tri = [1 - r - s, r, s]
        return [w * (1 - t) for w in tri] + [w * t for w in tri]
    raise ValueError(f"unknown cell kind {kind!r}")


#: Parametric centres.
CENTRES = {"hexahedron": (0.5, 0.5, 0.5), "tetrahedron": (0.25, 0.25, 0.25), "wedge": (1 / 3, 1 / 3, 0.5)}


def parametric_center(cells: DataFrame, points: DataFrame, kind: str, vals: list[str]) -> DataFrame:
    """Values interpolated at each cell's parametric centre."""
    w = F.get(F.array(*[F.lit(float(x)) for x in shape_weights(kind, *CENTRES[kind])]), F.col("local_idx"))
    return cells.join(points.select("pt_id", *vals), "pt_id").groupBy("cell_id").agg(*[F.sum(F.col(v) * w).alias(v) for v in vals])


def merge_meshes(meshes: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Point and triangle tables end to end, with indices rebased and the actor's number."""
    pts, tris, at, tri_at = None, None, 0, 0
    for k, (p, t) in enumerate(meshes):
        n, m = p.count(), t.count()
        p = p.withColumn("pt_id", F.col("pt_id") + at).withColumn("actor", F.lit(k))
        t = t.withColumns({c: F.col(c) + at for c in ("v0", "v1", "v2")}).withColumn("tri_id", F.col("tri_id") + tri_at).withColumn("actor", F.lit(k))
        pts = p if pts is None else pts.unionByName(p, allowMissingColumns=True)
        tris = t if tris is None else tris.unionByName(t, allowMissingColumns=True)
        at, tri_at = at + n, tri_at + m
    return pts, tris
