"""Stencils, neighbour sums, matrix products and n-body forces."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.operators.scan import BLOCK, block_of


def shifted(df: DataFrame, val: str, offsets: Sequence[int], idx: str = "idx", block: int = BLOCK) -> DataFrame:
    """1-D neighbours as columns ``val_m1``, ``val_p1``, ...: a window inside each block of indices.

    Each block also gets the rows beside it that its stencil reaches (a halo), so the window never leaves its block
    and no task sees more than a block. NULL beyond the ends.
    """
    reach = max(abs(o) for o in offsets)
    if reach > block:
        raise ValueError("the stencil reaches beyond the next block")
    own, at = block_of(F.col(idx), block), F.col(idx) % block
    place = lambda b, mine: F.struct(b.alias("block"), F.lit(mine).alias("own"))
    places = F.array(place(own, True), F.when(at >= block - reach, place(own + 1, False)), F.when(at < reach, place(own - 1, False)))
    dealt = df.withColumn("__p", F.explode(F.array_compact(places))).select(*df.columns, F.col("__p.block").alias("block"), F.col("__p.own").alias("own"))
    w = Window.partitionBy("block").orderBy(idx)
    name = lambda o: f"{val}_{'m' if o < 0 else 'p'}{abs(o)}"
    out = dealt.withColumns({name(o): F.lag(val, -o).over(w) for o in offsets})
    return out.where("own").drop("block", "own")


def neighbours(grid: DataFrame, offsets: Sequence[tuple[tuple[int, ...], float]], dims: Sequence[str], shape: Sequence[int], val: str, out: str) -> DataFrame:
    """Weighted sum over the neighbours that exist: sources are copied to their targets, one shuffle, linear.

    Adds ``out`` (sum) and ``out_n`` (how many neighbours there are) to each element.
    """
    steps = F.explode(F.array(*[F.struct(*[F.lit(o).alias(f"d_{d}") for d, o in zip(dims, off, strict=True)], F.lit(float(w)).alias("w")) for off, w in offsets])).alias("s")
    sent = grid.select(*dims, val, steps)
    # a source at p contributes to the target p - offset
    sent = sent.select(*[(F.col(d) - F.col(f"s.d_{d}")).alias(d) for d in dims], (F.col(val) * F.col("s.w")).alias("x"))
    inside = reduce(lambda a, b: a & b, [(F.col(d) >= 0) & (F.col(d) < n) for d, n in zip(dims, shape, strict=True)])
    summed = sent.where(inside).groupBy(*dims).agg(F.sum("x").alias(out), F.count("*").alias(f"{out}_n"))
    return grid.join(summed, list(dims), "left").withColumns({out: F.coalesce(out, F.lit(0.0)), f"{out}_n": F.coalesce(f"{out}_n", F.lit(0))})


MOORE = [((a, b), 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
CROSS = [((-1, 0), 1.0), ((1, 0), 1.0), ((0, -1), 1.0), ((0, 1), 1.0)]


def interior(dims: Sequence[str], shape: Sequence[int], margin: int = 1) -> Column:
    """Whether an element is at least ``margin`` from every border."""
    return reduce(lambda a, b: a & b, [(F.col(d) >= margin) & (F.col(d) < n - margin) for d, n in zip(dims, shape, strict=True)])


def box_blur(grid: DataFrame, shape: Sequence[int], val: str = "val", dims: Sequence[str] = ("i", "j")) -> DataFrame:
    """3 x 3 mean inside; borders are copied."""
    got = neighbours(grid, [*MOORE, ((0, 0), 1.0)], dims, shape, val, "s")
    return got.withColumn("out", F.when(interior(dims, shape), F.col("s") / 9.0).otherwise(F.col(val))).drop("s", "s_n")


def separable_blur(grid: DataFrame, shape: Sequence[int], val: str = "val", dims: Sequence[str] = ("i", "j"), radius: int = 2) -> DataFrame:
    """(2 radius + 1)-tap mean along rows, then columns; elements nearer a border than the radius are copied in each pass."""
    out = grid.withColumn("out", F.col(val).cast("double"))
    for along, across, n in ((dims[1], dims[0], shape[1]), (dims[0], dims[1], shape[0])):
        w = Window.partitionBy(across).orderBy(along).rowsBetween(-radius, radius)
        inside = (F.col(along) >= radius) & (F.col(along) < n - radius)
        out = out.withColumn("__m", F.avg("out").over(w)).withColumn("out", F.when(inside, F.col("__m")).otherwise(F.col("out"))).drop("__m")
    return out


def sobel(grid: DataFrame, shape: Sequence[int], val: str = "val", dims: Sequence[str] = ("i", "j")) -> DataFrame:
    """Gradient magnitude inside; 0 on borders."""
    gx = [((a, b), float(b * (2 - abs(a)))) for a in (-1, 0, 1) for b in (-1, 1)]
    gy = [((a, b), float(a * (2 - abs(b)))) for b in (-1, 0, 1) for a in (-1, 1)]
    both = neighbours(neighbours(grid, gx, dims, shape, val, "gx").drop("gx_n"), gy, dims, shape, val, "gy").drop("gy_n")
    size = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return both.withColumn("out", F.when(interior(dims, shape), size).otherwise(0.0)).drop("gx", "gy")


def laplacian(grid: DataFrame, shape: Sequence[int], val: str = "val", dims: Sequence[str] = ("i", "j")) -> DataFrame:
    """5-point Laplacian inside; 0 on borders."""
    got = neighbours(grid, CROSS, dims, shape, val, "s")
    return got.withColumn("out", F.when(interior(dims, shape), F.col("s") - 4.0 * F.col(val)).otherwise(0.0)).drop("s", "s_n")


def jacobi_step(grid: DataFrame, shape: Sequence[int], val: str = "val", dims: Sequence[str] = ("i", "j")) -> DataFrame:
    """Mean of the four neighbours inside; borders stay."""
    got = neighbours(grid, CROSS, dims, shape, val, "s")
    return got.withColumn(val, F.when(interior(dims, shape), F.col("s") / 4.0).otherwise(F.col(val).cast("double"))).drop("s", "s_n")


def heat_step(grid: DataFrame, shape: Sequence[int], rate: float, val: str = "val", dims: Sequence[str] = ("i", "j")) -> DataFrame:
    """val + rate * Laplacian inside; borders stay."""
    return laplacian(grid, shape, val, dims).withColumn(val, F.col(val) + rate * F.col("out")).drop("out")


def wave_step(df: DataFrame, n: int, c2: float, prev: str = "prev", curr: str = "curr", idx: str = "idx") -> DataFrame:
    """1-D wave equation: (curr, 2 curr - prev + c2 * Laplacian) become (prev, curr); ends stay 0."""
    got = shifted(df, curr, (-1, 1), idx)
    lap = F.col(f"{curr}_m1") - 2.0 * F.col(curr) + F.col(f"{curr}_p1")
    nxt = F.when((F.col(idx) > 0) & (F.col(idx) < n - 1), 2.0 * F.col(curr) - F.col(prev) + c2 * lap).otherwise(0.0)
    return got.select(idx, F.col(curr).alias(prev), nxt.alias(curr))


def life_step(grid: DataFrame, shape: Sequence[int], val: str = "val", dims: Sequence[str] = ("i", "j")) -> DataFrame:
    """Conway's rule without wrapping."""
    got = neighbours(grid, MOORE, dims, shape, val, "s")
    alive = (F.col("s") == 3) | ((F.col(val) == 1) & (F.col("s") == 2))
    return got.withColumn(val, alive.cast("int")).drop("s", "s_n")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, k, val) x (k, j, val) to (i, j, val): a join on k, partial sums before the shuffle."""
    both = a.select("i", "k", F.col("val").cast("double").alias("x")).join(b.select("k", "j", F.col("val").cast("double").alias("y")), "k")
    return both.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("val"))


def _pair_forces(softening: float, tile: int):
    """A pair of blocks, as an Arrow table of bodies with their ``side``, to each body's force by the other block's (side 0 alone: by its own)."""

    def meet(bodies):
        import numpy as np
        import pyarrow as pa

        side = bodies["side"].to_numpy()
        rows = [np.flatnonzero(side == k) for k in (0, 1)]
        own = not bodies["other"][0].as_py()
        if own:
            rows[1] = rows[0]
        every = np.stack([bodies[c].to_numpy() for c in ("x", "y", "z", "m")])
        left, right = (every[:, r] for r in rows)
        by_right, by_left = (np.zeros((3, v.shape[1])) for v in (left, right))
        held = np.empty((5, min(tile, left.shape[1]) * min(8 * tile, right.shape[1])))
        with np.errstate(all="ignore"):
            for a in range(0, left.shape[1], tile):
                p = left[:, a : a + tile]
                for b in range(0, right.shape[1], 8 * tile):
                    q = right[:, b : b + 8 * tile]
                    *d, r2, s = (h[: p.shape[1] * q.shape[1]].reshape(p.shape[1], q.shape[1]) for h in held)
                    for c in range(3):
                        np.subtract(q[c], p[c, :, None], out=d[c])
                        np.multiply(d[c], d[c], out=s if c else r2)
                        if c:
                            r2 += s
                    r2 += softening
                    np.sqrt(r2, out=s)
                    r2 *= s
                    if not softening:
                        r2[r2 == 0] = np.inf
                    np.divide(1.0, r2, out=r2)
                    for c in range(3):
                        np.multiply(d[c], r2, out=s)
                        by_right[c, a : a + tile] += p[3] * np.einsum("ij,j->i", s, q[3])  # not @, whose threads would be beside the session's cores
                        if not own:
                            by_left[c, b : b + 8 * tile] -= q[3] * np.einsum("i,ij->j", p[3], s)
        both = [(rows[0], by_right)] if own else [(rows[0], by_right), (rows[1], by_left)]
        ids = pa.chunked_array([x for r, _ in both for x in bodies["id"].take(pa.array(r)).chunks], bodies["id"].type)
        return pa.table({"id": ids, **{f"f{c}": pa.array(np.concatenate([f[k] for _, f in both])) for k, c in enumerate("xyz")}})

    return meet


def nbody_forces(bodies: DataFrame, softening: float = 0.01, size: int = 16384, tile: int = 64) -> DataFrame:
    """(id, x, y, z, m) to (id, fx, fy, fz) of all pairs, the whole sum of which is the operator.

    Bodies are cut into blocks of about ``size``, 8 at least of more than some thousands; each two blocks meet once, in one group of rows, on Arrow columns and
    in tiles, so nothing is broadcast and no pair is a row. What one body does to another is turned round for the other; a body
    meets itself with zero force. One with a NULL acts on none and has NULL forces.
    """
    cols = ["x", "y", "z", "m"]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    b = bodies.select("id", *[F.col(c).cast("double").alias(c) for c in cols])
    n = b.count()
    blocks = max(1, min(8, -(-n // 1024)), -(-n // size))
    own = F.pmod(F.xxhash64("id", *cols), F.lit(blocks)).cast("int")
    dealt = b.where(whole).withColumn("own", own).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("id", *cols, F.least("own", "to").alias("bi"), F.greatest("own", "to").alias("bj"), (F.col("own") > F.col("to")).cast("int").alias("side"), (F.col("own") != F.col("to")).alias("other"))
    dealt = dealt.repartition(min(blocks * (blocks + 1), 2000), "bi", "bj")  # twice the groups: few of them share a task
    kinds = T.StructType([b.schema["id"], *[T.StructField(f"f{c}", T.DoubleType()) for c in "xyz"]])
    met = dealt.groupBy("bi", "bj").applyInArrow(_pair_forces(softening, tile), kinds)
    none = b.where(~whole).select("id", *[F.lit(None).cast("double").alias(f"f{c}") for c in "xyz"])
    return met.unionByName(none).groupBy("id").agg(*[F.sum(f"f{c}").alias(f"f{c}") for c in "xyz"])
