"""Time stepping: loops of a step over frames, with lineage cut at intervals, and in-situ pipelines over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import stencil
from fieldloom.sources.scratch import materialized


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], n: int, every: int = 5) -> DataFrame:
    """``step`` applied n times; the state is written and read back after every few, so plans stay short and an executor
    that is lost costs a few steps."""
    for k in range(1, n + 1):
        state = step(state)
        if k % every == 0 and k < n:
            state = materialized(state)
    return state


def until(state: DataFrame, step: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame], bool], limit: int = 100) -> tuple[DataFrame, int]:
    """``step`` until ``done`` holds or ``limit`` is reached; the state and the number of steps."""
    for k in range(limit):
        if done(state):
            return state, k
        state = materialized(step(state))
    return state, limit


def jacobi(grid: DataFrame, shape: tuple[int, int], n: int) -> DataFrame:
    return iterate(grid, lambda g: stencil.jacobi_step(g, shape), n)


def heat(grid: DataFrame, shape: tuple[int, int], rate: float, n: int) -> DataFrame:
    return iterate(grid, lambda g: stencil.heat_step(g, shape, rate), n)


def life(grid: DataFrame, shape: tuple[int, int], n: int) -> DataFrame:
    return iterate(grid, lambda g: stencil.life_step(g, shape), n)


def wave(state: DataFrame, size: int, c2: float, n: int) -> DataFrame:
    """(idx, prev, curr); each step shifts the time levels."""
    return iterate(state, lambda s: stencil.wave_step(s, size, c2), n)


def nbody(bodies: DataFrame, dt: float, n: int, softening: float = 0.01) -> DataFrame:
    """(id, x .. z, vx .. vz, m): velocities first, then positions by the new velocities."""

    def step(b: DataFrame) -> DataFrame:
        both = b.join(stencil.nbody_forces(b.select("id", "x", "y", "z", "m"), softening), "id")
        both = both.withColumns({f"v{c}": F.col(f"v{c}") + dt * F.col(f"f{c}") / F.col("m") for c in "xyz"})
        return both.withColumns({c: F.col(c) + dt * F.col(f"v{c}") for c in "xyz"}).select(b.columns)

    return iterate(bodies, step, n, every=1)


def propagate_boxes(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Boxes of a tree's inner nodes from its leaves' (node, lo, hi), level by level until none is open.

    ``nodes``: (node, left, right). Each round completes the nodes whose two children are known.
    """
    known = leaves
    left = nodes
    while True:
        kids = left.select("node", F.explode(F.array("left", "right")).alias("child"))
        ready = kids.join(known.withColumnRenamed("node", "child"), "child").groupBy("node").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("n = 2").drop("n")
        ready = materialized(ready)
        if ready.isEmpty():
            return known
        known = known.unionByName(ready)
        left = materialized(left.join(ready.select("node"), "node", "left_anti"))


def in_situ(stream: DataFrame, extract: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs ``extract`` on each micro-batch of a stream and gives the result to ``sink`` with the batch's number; a sink that
    overwrites by number makes a replayed batch harmless. Returns the query."""
    w = stream.writeStream.foreachBatch(lambda df, k: sink(extract(df), k)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def windowed(stream: DataFrame, time: str, value: str, width: str, late: str, by: list[str] | None = None) -> DataFrame:
    """Count and sum of a value in event-time windows, rows later than ``late`` dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *(by or [])).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
