"""Runs functions of this package on executors, whether or not the package is installed there."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shipped(module: str, name: str, *last, **params):
    """A picklable ``f(x) == module.name(x, *last, **params)`` that imports the module where it runs."""
    root = ROOT

    def run(first):
        import importlib
        import inspect
        import sys as _sys

        try:
            m = importlib.import_module(module)
        except ModuleNotFoundError:
            _sys.path.insert(0, root)
            m = importlib.import_module(module)
        f = getattr(m, name)
        if not inspect.isgeneratorfunction(f):
            return f(first, *last, **params)
        ship = importlib.import_module("fieldloom.llm.ship")
        return ship.tidied(f(ship.sliced(first), *last, **params))

    return run


def sliced(batches, rows: int = 1000):
    """Arrow batches of few rows, which bounds the Python objects made of one."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidied(batches):
    """The batches; after the last, what a task has freed goes back to the system, as workers live on and others need it."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pair_shipped(module: str, name: str, *last):
    """``f(x, y) == module.name(x, y, *last)``, for functions of two frames."""
    one = shipped(module, "_second", name, last)

    def run(first, second):
        return one((first, second))

    return run


register_pickle_by_value(sys.modules[__name__])
