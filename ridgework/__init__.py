"""Terrain analytics over tiled rasters, written as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from ridgework.grid import Grid
from ridgework.layer import Layer

# Arrow kernels travel to the executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Grid", "Layer"]
