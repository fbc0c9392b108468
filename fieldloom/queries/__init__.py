"""Registered queries and their SQL oracles, one module per operator family."""

from __future__ import annotations

from fieldloom.queries import arrays, elementwise, geometry, kernels, rendering, stats

_MODULES = (elementwise, stats, arrays, geometry, rendering, kernels)

QUERIES: dict = {}
ORACLES: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
