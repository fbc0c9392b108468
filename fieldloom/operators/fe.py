"""Finite elements: Lagrange bases, degrees of freedom, linear geometry maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lagrange(nodes: list[float], k: int, t):
    """The k-th Lagrange polynomial at t, a number or a column."""
    out = 1.0 if not isinstance(t, Column) else F.lit(1.0)
    for j, x in enumerate(nodes):
        if j != k:
            out = out * (t - float(x)) / float(nodes[k] - x)
    return out


def lagrange_d(nodes: list[float], k: int, t):
    """Its derivative."""
    total = 0.0 if not isinstance(t, Column) else F.lit(0.0)
    for m, xm in enumerate(nodes):
        if m == k:
            continue
        part = 1.0 / float(nodes[k] - xm)
        for j, x in enumerate(nodes):
            if j not in (k, m):
                part = part * (t - float(x)) / float(nodes[k] - x)
        total = total + part
    return total


class TensorBasis:
    """Tensor-product Lagrange basis in ``dim`` dimensions, degrees of freedom with the first axis fastest."""

    def __init__(self, nodes: list[float], dim: int):
        self.nodes, self.dim = list(map(float, nodes)), dim

    @property
    def ndof(self) -> int:
        return len(self.nodes) ** self.dim

    def split(self, j: int) -> list[int]:
        n = len(self.nodes)
        return [j // n**d % n for d in range(self.dim)]

    def evaluate(self, j: int, *at, d: int | None = None):
        """Basis function j at parametric coordinates, or its derivative along axis d."""
        out = None
        for axis, (k, t) in enumerate(zip(self.split(j), at, strict=True)):
            f = lagrange_d(self.nodes, k, t) if axis == d else lagrange(self.nodes, k, t)
            out = f if out is None else out * f
        return out

    def matrix(self, n_sub: int) -> np.ndarray:
        """Rows: the (n_sub + 1) ** dim sub-points, first axis fastest; columns: degrees of freedom."""
        m = n_sub + 1
        pts = [[p // m**d % m / n_sub for d in range(self.dim)] for p in range(m**self.dim)]
        return np.array([[self.evaluate(j, *p) for j in range(self.ndof)] for p in pts])

    def frame(self, spark: SparkSession, n_sub: int) -> DataFrame:
        """The matrix as (pt, j, b); its size is fixed by order and subdivision."""
        b = self.matrix(n_sub)
        return spark.createDataFrame([(p, j, float(b[p, j])) for p in range(b.shape[0]) for j in range(b.shape[1])], "pt int, j int, b double")


def quad_basis(nodes) -> TensorBasis:
    return TensorBasis(nodes, 2)


def hex_basis(nodes) -> TensorBasis:
    return TensorBasis(nodes, 3)


def nodes_and_order(points: np.ndarray, dim: int) -> tuple[list[float], list[int]]:
    """Sorted 1-D nodes (unique to 10 places) of an element's points, and each tensor position's point."""
    pts = np.asarray(points, float).reshape(-1, dim)
    nodes = np.unique(np.round(pts[:, 0], 10))
    n = len(nodes)
    assert n**dim == len(pts), "not a tensor-product element"
    key = {tuple(np.round(p, 10)): k for k, p in enumerate(pts)}
    order = [key[tuple(nodes[j // n**d % n] for d in range(dim))] for j in range(len(pts))]
    return nodes.tolist(), order


def at_subpoints(dofs: DataFrame, basis: TensorBasis, n_sub: int) -> DataFrame:
    """(elem, j, val) to (elem, pt, v): the field at sub-points, B times the element's values."""
    b = basis.frame(dofs.sparkSession, n_sub)
    return dofs.join(F.broadcast(b), "j").groupBy("elem", "pt").agg(F.sum(F.col("b") * F.col("val")).alias("v"))


def contiguous_dofs(offsets: DataFrame, values: DataFrame) -> DataFrame:
    """Discontinuous elements: (elem, start, stop), (idx, val) to (elem, j, val)."""
    rows = offsets.select("elem", F.posexplode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("j", "idx"))
    return rows.join(values, "idx").select("elem", "j", "val")


def gathered_dofs(offsets: DataFrame, indices: DataFrame, values: DataFrame, order: list[int] | None = None) -> DataFrame:
    """Continuous elements: ``values[indices[start + order[j]]]``. ``indices``: (at, idx)."""
    rows = offsets.select("elem", F.posexplode(F.sequence(F.lit(0), F.col("stop") - F.col("start") - 1)).alias("j", "k"), "start")
    k = F.get(F.array(*[F.lit(x) for x in order]), F.col("j")) if order is not None else F.col("k")
    return rows.withColumn("at", F.col("start") + k).join(indices, "at").join(values, "idx").select("elem", "j", "val")


def quad_weights(r: Column, s: Column) -> list[Column]:
    return [(1.0 - r) * (1.0 - s), r * (1.0 - s), r * s, (1.0 - r) * s]


def quad_map(c: str, r: Column, s: Column) -> Column:
    """Bilinear map of coordinate c (columns c0 .. c3)."""
    return sum((w * F.col(f"{c}{k}") for k, w in enumerate(quad_weights(r, s))), F.lit(0.0))


def quad_jacobian(c: str, along: int, r: Column, s: Column) -> Column:
    """Derivative of coordinate c along r (0) or s (1)."""
    p = [F.col(f"{c}{k}") for k in range(4)]
    if along == 0:
        return -(1.0 - s) * p[0] + (1.0 - s) * p[1] + s * p[2] - s * p[3]
    return -(1.0 - r) * p[0] - r * p[1] + r * p[2] + (1.0 - r) * p[3]


def hex_map(c: str, r: Column, s: Column, t: Column) -> Column:
    """Trilinear map of coordinate c (columns c0 .. c7)."""
    q = quad_weights(r, s)
    return sum((w * ((1.0 - t) * F.col(f"{c}{k}") + t * F.col(f"{c}{k + 4}")) for k, w in enumerate(q)), F.lit(0.0))
