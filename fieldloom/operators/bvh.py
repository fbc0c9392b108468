"""Ray-triangle queries and a linear bounding-volume hierarchy.

Joins between rays and triangles go through a uniform grid: triangles are copied to the cells of their boxes,
rays to the cells that they cross, and candidates meet in an equi-join. The hierarchy is there for what needs a tree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import bits
from fieldloom.operators.mesh import _vertices, bounds, triangle_boxes
from fieldloom.operators.scan import dense_index

MISS = 1e30


def moller_trumbore(prefix: str = "") -> Column:
    """struct(t, u, v) of ray (ox .. dz) and triangle (x0 .. z2); NULL where it misses (|det| <= 1e-10, t <= 0.001)."""
    c = lambda n: F.col(prefix + n)
    e1, e2 = [[c(f"{a}{k}") - c(f"{a}0") for a in "xyz"] for k in (1, 2)]
    d, o = [F.col(f"d{a}") for a in "xyz"], [F.col(f"o{a}") - c(f"{a}0") for a in "xyz"]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    p = cross(d, e2)
    det = dot(e1, p)
    flat = F.abs(det) <= 1e-10
    inv = 1.0 / F.when(flat, F.lit(1.0)).otherwise(det)
    q = cross(o, e1)
    u, v, t = dot(o, p) * inv, dot(d, q) * inv, dot(e2, q) * inv
    hit = ~flat & (u >= 0) & (v >= 0) & (u + v <= 1) & (t > 0.001)
    return F.when(hit, F.struct(t.alias("t"), u.alias("u"), v.alias("v")))


class Grid:
    """A uniform grid over a mesh. By default a side has as many cells as a square surface of the mesh's triangles would cross,
    128 at most, as each ray's plan lists the planes."""

    def __init__(self, points: DataFrame, tris: DataFrame, cells: int | None = None):
        cells = cells or max(4, min(128, round((tris.count() / 2) ** 0.5)))
        b = bounds(points).first()
        lo = np.array([b[f"min_{a}"] for a in "xyz"], float)
        hi = np.array([b[f"max_{a}"] for a in "xyz"], float)
        pad = 1e-6 + 1e-3 * float((hi - lo).max())
        self.lo, self.hi, self.n = lo - pad, hi + pad, cells
        self.size = (self.hi - self.lo) / cells
        box = triangle_boxes(points, tris)
        place = lambda c, k: F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((F.col(c) - float(self.lo[k])) / float(self.size[k])).cast("int")))
        for k, a in enumerate("xyz"):
            box = box.withColumn(f"g{a}", F.explode(F.sequence(place(f"lo_{a}", k), place(f"hi_{a}", k))))
        self.tris = _vertices(tris, points).join(box.select("tri_id", "gx", "gy", "gz"), "tri_id")

    def candidates(self, rays: DataFrame, key: list[str]) -> DataFrame:
        """Each ray with the triangles of the cells that it crosses.

        A ray's crossing times of all cell planes cut it into pieces, each inside one cell; the piece's middle names
        the cell. A ray has at most 3 (n + 1) pieces.
        """
        times, near, far = [], F.lit(0.0), F.lit(MISS)
        outside = F.lit(False)
        for k, a in enumerate("xyz"):
            o, d = F.col(f"o{a}"), F.col(f"d{a}")
            flat = F.abs(d) < 1e-12
            safe = F.when(flat, F.lit(1.0)).otherwise(d)
            t = lambda x: (float(x) - o) / safe  # noqa: E731, B023
            times.append(F.when(~flat, F.array(*[t(self.lo[k] + i * self.size[k]) for i in range(self.n + 1)])).otherwise(F.array().cast("array<double>")))
            near = F.when(flat, near).otherwise(F.greatest(near, F.least(t(self.lo[k]), t(self.hi[k]))))
            far = F.when(flat, far).otherwise(F.least(far, F.greatest(t(self.lo[k]), t(self.hi[k]))))
            outside = outside | (flat & ((o < float(self.lo[k])) | (o > float(self.hi[k]))))
        r = rays.withColumns({"__t": F.concat(*times), "__a": near, "__b": far, "__x": outside}).where("not __x and __a < __b")
        r = r.withColumn("__t", F.array_sort(F.concat(F.array("__a", "__b"), F.filter("__t", lambda t: (t > F.col("__a")) & (t < F.col("__b"))))))
        r = r.withColumn("__k", F.explode(F.sequence(F.lit(0), F.size("__t") - 2))).withColumn("__m", 0.5 * (F.get("__t", F.col("__k")) + F.get("__t", F.col("__k") + 1)))
        cell = lambda k, a: F.greatest(F.lit(0), F.least(F.lit(self.n - 1), F.floor((F.col(f"o{a}") + F.col("__m") * F.col(f"d{a}") - float(self.lo[k])) / float(self.size[k])).cast("int")))
        r = r.withColumns({f"g{a}": cell(k, a) for k, a in enumerate("xyz")}).drop("__t", "__a", "__b", "__x", "__k", "__m")
        r = r.dropDuplicates([*key, "gx", "gy", "gz"])
        return r.join(self.tris, ["gx", "gy", "gz"])

    def closest(self, rays: DataFrame, key: list[str]) -> DataFrame:
        """(key, tri_id, t, u, v) of each ray's nearest triangle, ties to the smallest id; rays that miss are absent."""
        hit = self.candidates(rays, key).withColumn("h", moller_trumbore()).where("h is not null")
        best = hit.groupBy(*key).agg(F.min(F.struct("h.t", "tri_id", "h.u", "h.v")).alias("m"))
        return best.select(*key, *[F.col(f"m.{c}").alias(c) for c in ("tri_id", "t", "u", "v")])

    def blocked(self, rays: DataFrame, key: list[str], dist: str) -> DataFrame:
        """Keys of rays that meet any triangle before ``dist``."""
        hit = self.candidates(rays, key).withColumn("h", moller_trumbore()).where("h is not null")
        return hit.where(F.col("h.t") < F.col(dist)).select(*key).distinct()


def brute_force(rays: DataFrame, points: DataFrame, tris: DataFrame, key: list[str]) -> DataFrame:
    """``closest`` over every pair, for tests on small meshes."""
    hit = rays.crossJoin(_vertices(tris, points)).withColumn("h", moller_trumbore()).where("h is not null")
    best = hit.groupBy(*key).agg(F.min(F.struct("h.t", "tri_id", "h.u", "h.v")).alias("m"))
    return best.select(*key, *[F.col(f"m.{c}").alias(c) for c in ("tri_id", "t", "u", "v")])


def morton_order(points: DataFrame, tris: DataFrame) -> DataFrame:
    """(place, tri_id, code, boxes): triangles by the Morton code of their centroid in the mesh's box, then id."""
    box = triangle_boxes(points, tris)
    b = bounds(points).first()
    unit = lambda a: (F.col(f"c{a}") - float(b[f"min_{a}"])) / (max(float(b[f"max_{a}"] - b[f"min_{a}"]), 1e-20))
    coded = box.withColumn("code", bits.morton(unit("x"), unit("y"), unit("z")))
    return dense_index(coded, ["code", "tri_id"], "place")


def hierarchy(points: DataFrame, tris: DataFrame, limit: int = 100_000) -> tuple[DataFrame, np.ndarray]:
    """A linear hierarchy of up to ``limit`` triangles (beyond, use the grid).

    Returns the ordered triangles and, for the n - 1 inner nodes, an array of (left, right, lo xyz, hi xyz); child numbers
    from n - 1 are leaves by place. Each inner node covers a range of places and splits it where the common prefix of
    neighbouring codes is shortest, which sorted codes make a tree; boxes fold up from the leaves.
    """
    order = morton_order(points, tris)
    rows = order.orderBy("place").select("code", *[f"{e}_{a}" for e in ("lo", "hi") for a in "xyz"]).limit(limit + 1).toPandas()
    n = len(rows)
    if n > limit:
        raise ValueError(f"more than {limit} triangles")
    if n < 2:
        return order, np.zeros((0, 8))
    codes, box = rows["code"].to_numpy(np.int64), rows.iloc[:, 1:].to_numpy()
    gap = codes[1:] ^ codes[:-1]
    same = gap == 0
    place = np.arange(1, n) ^ np.arange(n - 1)
    weight = np.where(same, place, gap << 32)  # a larger one means a shorter common prefix
    nodes = np.zeros((n - 1, 8))
    stack, made = [(0, 0, n - 1)], 1
    spans: list[tuple[int, int, int]] = []
    while stack:
        node, a, b = stack.pop()
        spans.append((node, a, b))
        cut = a + int(np.argmax(weight[a:b]))
        for side, (x, y) in enumerate(((a, cut), (cut + 1, b))):
            if x == y:
                nodes[node, side] = n - 1 + x
            else:
                nodes[node, side] = made
                stack.append((made, x, y))
                made += 1
    for node, a, b in spans:
        nodes[node, 2:5], nodes[node, 5:8] = box[a : b + 1, :3].min(0), box[a : b + 1, 3:].max(0)
    return order, nodes


def parents(nodes: DataFrame) -> DataFrame:
    """(node, parent) from (node, left, right)."""
    return nodes.select(F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("parent"))
