"""Cameras: one ray a pixel, and the projection to the screen."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Camera:
    """Rays start at ``pos + odx * x + ody * y`` and run along ``corner + dx * x + dy * y`` (pixel centres, y down)."""

    pos: np.ndarray
    corner: np.ndarray
    dx: np.ndarray
    dy: np.ndarray
    odx: np.ndarray
    ody: np.ndarray
    width: int
    height: int
    right: np.ndarray
    up: np.ndarray
    forward: np.ndarray
    half: tuple[float, float]
    parallel: bool

    def rays(self, spark: SparkSession, jitter: tuple[Column, Column] | None = None) -> DataFrame:
        """(pid, px, py, ox .. dz), directions normalised."""
        df = spark.range(self.width * self.height).select(F.col("id").alias("pid"))
        df = df.withColumns({"px": F.col("pid") % self.width, "py": F.call_function("div", F.col("pid"), F.lit(self.width).cast("bigint"))})
        return self.shoot(df, jitter)

    def shoot(self, df: DataFrame, jitter: tuple[Column, Column] | None = None) -> DataFrame:
        x, y = (F.col(c) + 0.5 + (jitter[k] if jitter else 0.0) for k, c in enumerate(("px", "py")))
        lin = lambda a, b, c, k: F.lit(float(a[k])) + float(b[k]) * x + float(c[k]) * y
        df = df.withColumns({f"o{a}": lin(self.pos, self.odx, self.ody, k) for k, a in enumerate("xyz")} | {f"d{a}": lin(self.corner, self.dx, self.dy, k) for k, a in enumerate("xyz")})
        size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
        return df.withColumn("__n", size).withColumns({f"d{a}": F.col(f"d{a}") / F.col("__n") for a in "xyz"}).drop("__n")

    def mvp(self, near: float = 0.01, far: float = 1000.0) -> np.ndarray:
        """World to clip coordinates."""
        centre = self.pos
        if self.parallel:
            centre = self.pos + self.odx * self.width / 2 + self.ody * self.height / 2
        view = np.eye(4)
        for r, axis in enumerate((self.right, self.up, -self.forward)):
            view[r, :3], view[r, 3] = axis, -axis @ centre
        p = np.zeros((4, 4))
        p[0, 0], p[1, 1] = 1 / self.half[0], 1 / self.half[1]
        if self.parallel:
            p[2, 2], p[2, 3], p[3, 3] = -2 / (far - near), -(far + near) / (far - near), 1
        else:
            p[2, 2], p[2, 3], p[3, 2] = -(far + near) / (far - near), -2 * far * near / (far - near), -1
        return p @ view

    def project(self, points: DataFrame) -> DataFrame:
        """Adds screen place sx, sy, depth and visible (not behind the camera)."""
        m = self.mvp()
        row = lambda r: sum((float(m[r, k]) * F.col(c) for k, c in enumerate("xyz")), F.lit(float(m[r, 3])))
        df = points.withColumn("__w", row(3)).withColumn("visible", F.col("__w") >= 0.001).withColumn("__w", F.greatest(F.lit(0.001), F.col("__w")))
        return df.withColumns({"sx": (row(0) / F.col("__w") * 0.5 + 0.5) * float(self.width), "sy": (0.5 - row(1) / F.col("__w") * 0.5) * float(self.height), "depth": row(2) / F.col("__w")}).drop("__w")


def _frame(position, look_at, up):
    pos, f = np.asarray(position, float), np.asarray(look_at, float) - np.asarray(position, float)
    f = f / np.linalg.norm(f)
    r = np.cross(f, np.asarray(up, float))
    r = r / np.linalg.norm(r)
    return pos, f, r, np.cross(r, f)


def perspective(position, look_at, up=(0, 1, 0), fov: float = 45.0, width: int = 512, height: int = 512) -> Camera:
    pos, f, r, u = _frame(position, look_at, up)
    hh = math.tan(math.radians(fov) / 2)
    hw = hh * width / height
    zero = np.zeros(3)
    return Camera(pos, f - r * hw + u * hh, r * (2 * hw / width), -u * (2 * hh / height), zero, zero, width, height, r, u, f, (hw, hh), False)


def orthographic(position, look_at, up=(0, 1, 0), view_height: float = 10.0, width: int = 512, height: int = 512) -> Camera:
    pos, f, r, u = _frame(position, look_at, up)
    hh = view_height / 2
    hw = hh * width / height
    zero = np.zeros(3)
    return Camera(pos - r * hw + u * hh, f, zero, zero, r * (2 * hw / width), -u * (2 * hh / height), width, height, r, u, f, (hw, hh), True)
