"""Analytic scalar fields over coordinate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gyroid(x: Column, y: Column, z: Column) -> Column:
    return F.sin(x) * F.cos(y) + F.sin(y) * F.cos(z) + F.sin(z) * F.cos(x)


def sphere(x: Column, y: Column, z: Column, radius: float) -> Column:
    """Positive inside."""
    return radius * radius - (x * x + y * y + z * z)


def plane(z: Column) -> Column:
    return z


def rings(x: Column, y: Column, waves: float) -> Column:
    """Concentric rings in [0, 1]."""
    return 0.5 + 0.5 * F.sin(F.sqrt(x * x + y * y) * waves)


def wavelet(x: Column, y: Column, z: Column, peak: float = 255.0, deviation: float = 0.5) -> Column:
    """A Gaussian bump with ripples along the axes."""
    g = F.exp(-(x * x + y * y + z * z) / (2.0 * deviation * deviation))
    return peak * g + 10.0 * F.sin(x * 6.0) + 18.0 * F.sin(y * 3.0) + 5.0 * F.cos(z * 0.5)
