"""Colour tables and transfer functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control points of the presets, evenly spaced over [0, 1].
PRESETS = {
    "viridis": [(0.267004, 0.004874, 0.329415), (0.282327, 0.140926, 0.457517), (0.253935, 0.265254, 0.529983), (0.206756, 0.371758, 0.553117), (0.163625, 0.471133, 0.558148), (0.127568, 0.566949, 0.550556), (0.134692, 0.658636, 0.517649), (0.477504, 0.821444, 0.318195), (0.993248, 0.906157, 0.143936)],
    "cool_to_warm": [(0.230, 0.299, 0.754), (0.552, 0.600, 0.880), (0.866, 0.866, 0.950), (1.000, 1.000, 1.000), (0.950, 0.866, 0.866), (0.880, 0.600, 0.552), (0.706, 0.016, 0.150)],
    "inferno": [(0.001462, 0.000466, 0.013866), (0.087411, 0.044556, 0.224813), (0.258234, 0.038571, 0.406485), (0.416331, 0.090834, 0.432943), (0.578040, 0.148039, 0.404001), (0.735683, 0.215906, 0.329651), (0.882371, 0.319610, 0.212519), (0.978422, 0.557937, 0.034931), (0.988362, 0.998364, 0.644924)],
    "plasma": [(0.050383, 0.029803, 0.527975), (0.254627, 0.013882, 0.615419), (0.417642, 0.000564, 0.658390), (0.562738, 0.051545, 0.641509), (0.692840, 0.165141, 0.564522), (0.798216, 0.280197, 0.469538), (0.881443, 0.392529, 0.383229), (0.949217, 0.517763, 0.295662), (0.940015, 0.975158, 0.131326)],
    "grayscale": [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0)],
    "rainbow": [(0.0, 0.0, 1.0), (0.0, 1.0, 1.0), (0.0, 1.0, 0.0), (1.0, 1.0, 0.0), (1.0, 0.0, 0.0)],
}


def lut(preset: str, n: int = 256) -> np.ndarray:
    """(n, 3) colours between a preset's control points."""
    if preset not in PRESETS:
        raise ValueError(f"unknown colour table {preset!r}")
    p = np.array(PRESETS[preset])
    x, at = np.linspace(0, 1, len(p)), np.linspace(0, 1, n)
    return np.stack([np.interp(at, x, p[:, c]) for c in range(3)], 1)


def literal(a: np.ndarray) -> Column:
    """A small table as an array of arrays."""
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in a])


class ColourTable:
    """Linear interpolation between the entries of a table over a value range."""

    def __init__(self, preset: str = "viridis", n: int = 256, range_: tuple[float, float] | None = None):
        self.table, self.range = lut(preset, n), range_

    def resolved(self, df: DataFrame, val: str) -> tuple[float, float]:
        """The given range, or the values' own (one aggregate)."""
        if self.range is not None:
            return self.range
        r = df.agg(F.min(val), F.max(val)).first()
        return float(r[0]), float(r[1])

    def map(self, df: DataFrame, val: str, names=("r", "g", "b")) -> DataFrame:
        """Adds colours; a degenerate range divides by 1."""
        lo, hi = self.resolved(df, val)
        inv = 1.0 / (hi - lo) if hi > lo else 1.0
        n = len(self.table)
        f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(val).cast("double") - lo) * inv)) * float(n - 1)
        out = df.withColumn("__f", f).withColumn("__k", F.least(F.lit(n - 2), F.col("__f").cast("int")))
        out = out.withColumns({"__a": F.get(literal(self.table), F.col("__k")), "__b": F.get(literal(self.table), F.col("__k") + 1), "__w": F.col("__f") - F.col("__k")})
        ch = lambda c: F.get("__a", F.lit(c)) + F.col("__w") * (F.get("__b", F.lit(c)) - F.get("__a", F.lit(c)))
        return out.withColumns({name: ch(c) for c, name in enumerate(names)}).drop("__f", "__k", "__a", "__b", "__w")


class TransferFunction:
    """Colour and opacity by the entry at or below a value's place; no interpolation."""

    def __init__(self, preset: str = "viridis", opacity: Callable[[float], float] | None = None, n: int = 256, range_: tuple[float, float] = (0.0, 1.0)):
        alpha = [float((opacity or (lambda t: 0.5 * t))(t)) for t in np.linspace(0, 1, n)]
        self.table, self.range = np.column_stack([lut(preset, n), alpha]), range_

    @classmethod
    def from_numpy(cls, rgba: np.ndarray, range_: tuple[float, float] = (0.0, 1.0)) -> TransferFunction:
        a = np.asarray(rgba, float)
        if a.ndim != 2 or a.shape[1] != 4:
            raise ValueError("a transfer function is (n, 4)")
        out = cls.__new__(cls)
        out.table, out.range = a, range_
        return out

    def entry(self, val: Column) -> Column:
        """array(r, g, b, a)."""
        n, (lo, hi) = len(self.table), self.range
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (val - lo) / ((hi - lo) or 1.0)))
        return F.get(literal(self.table), F.least(F.lit(n - 1), (t * float(n - 1)).cast("int")))
