"""Unstructured-grid XML of results that the driver holds; larger ones go to ``df.write``."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame


def _write(path: str, xyz: np.ndarray, cells: np.ndarray, kind: int) -> None:
    n, width = cells.shape
    row = lambda a: " ".join(map(str, np.asarray(a).ravel().tolist()))
    arrays = f'<DataArray type="Int64" Name="connectivity" format="ascii">{row(cells)}</DataArray><DataArray type="Int64" Name="offsets" format="ascii">{row(np.arange(1, n + 1) * width)}</DataArray><DataArray type="UInt8" Name="types" format="ascii">{row(np.full(n, kind))}</DataArray>'
    pts = f'<DataArray type="Float64" NumberOfComponents="3" format="ascii">{row(xyz)}</DataArray>'
    Path(path).write_text(f'<VTKFile type="UnstructuredGrid" version="0.1"><UnstructuredGrid><Piece NumberOfPoints="{len(xyz)}" NumberOfCells="{n}"><Points>{pts}</Points><Cells>{arrays}</Cells></Piece></UnstructuredGrid></VTKFile>')


def write_triangles(path: str, points: DataFrame, tris: DataFrame) -> None:
    """Points (pt_id dense from 0, x, y, z) and triangles (v0, v1, v2)."""
    xyz = points.orderBy("pt_id").select("x", "y", "z").toPandas().to_numpy()
    _write(path, xyz, tris.orderBy("tri_id").select("v0", "v1", "v2").toPandas().to_numpy(), 5)


def write_lines(path: str, segments: DataFrame) -> None:
    """Segments (ax, ay, bx, by)."""
    s = segments.select("ax", "ay", "bx", "by").toPandas().to_numpy()
    xyz = np.zeros((2 * len(s), 3))
    xyz[:, :2] = s.reshape(-1, 2)
    _write(path, xyz, np.arange(2 * len(s)).reshape(-1, 2), 3)
