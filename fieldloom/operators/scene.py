"""Scenes: actors, materials, lights, and their preparation for rendering."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.colour import ColourTable
from fieldloom.operators.mesh import merge_meshes, transform_normals, transform_points, vertex_normals

#: Material kinds.
MATTE, MIRROR, GLASS = 0, 1, 2


@dataclass(frozen=True)
class Material:
    kind: int = MATTE
    ior: float = 1.5


@dataclass(frozen=True)
class Light:
    """A point light at ``xyz`` (falls off with the squared distance) or a directional one towards ``xyz``."""

    xyz: tuple[float, float, float]
    intensity: float = 1.0
    colour: tuple[float, float, float] = (1.0, 1.0, 1.0)
    directional: bool = False


@dataclass
class Actor:
    """Points (pt_id, x, y, z[, r, g, b][, scalars][, nx, ny, nz]) and triangles; colours: points' own, else scalars
    through a table, else uniform."""

    points: DataFrame
    tris: DataFrame
    colour: tuple[float, float, float] = (0.8, 0.8, 0.8)
    material: Material = Material()
    mode: str = "solid"
    transform: np.ndarray | None = None
    scalars: str | None = None
    table: ColourTable | None = None
    smooth: bool = True


@dataclass
class Scene:
    actors: list[Actor] = field(default_factory=list)
    lights: list[Light] = field(default_factory=list)
    background: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def lit(self) -> list[Light]:
        """The lights; one at (10, 10, 10) where there are none."""
        return self.lights or [Light((10.0, 10.0, 10.0), 100.0)]

    def materials(self, actors: list[Actor]) -> list[Material]:
        """Distinct materials in the order in which actors first use them."""
        return list(dict.fromkeys(a.material for a in actors))

    def prepare(self, mode: str = "solid") -> tuple[DataFrame, DataFrame] | None:
        """Merged points (pt_id, x .. nz, r, g, b) and triangles (tri_id, v0 .. v2, kind, ior) of the actors of a mode."""
        actors = [a for a in self.actors if a.mode == mode]
        if not actors:
            return None
        meshes = []
        for a in actors:
            p = a.points
            if not {"nx", "ny", "nz"} <= set(p.columns):
                n = vertex_normals(p, a.tris) if a.smooth else None
                p = p.join(n, "pt_id") if n is not None else p.withColumns({f"n{c}": F.lit(0.0) for c in "xyz"})
            if a.transform is not None:
                p = transform_normals(transform_points(p, a.transform), a.transform)
            if not {"r", "g", "b"} <= set(p.columns):
                if a.scalars:
                    p = (a.table or ColourTable()).map(p, a.scalars)
                else:
                    p = p.withColumns({c: F.lit(float(v)) for c, v in zip("rgb", a.colour, strict=True)})
            p = p.select("pt_id", "x", "y", "z", "nx", "ny", "nz", "r", "g", "b")
            meshes.append((p, a.tris.select("tri_id", "v0", "v1", "v2", F.lit(a.material.kind).alias("kind"), F.lit(float(a.material.ior)).alias("ior"))))
        return meshes[0] if len(meshes) == 1 else merge_meshes(meshes)
