"""Small rasters as numpy arrays, and back."""

import numpy as np

from ridgework import Grid
from ridgework.operators.tiling import cells_to_tiles, tiles_to_cells

SMALL = Grid(tile_size=4, xmin=0.0, ymax=0.0, res=10.0)


def layer_of(spark, array, grid=SMALL, zoom=3):
    rows = [(int(c), int(r), float(z)) for (r, c), z in np.ndenumerate(array) if not np.isnan(z)]
    return cells_to_tiles(spark.createDataFrame(rows, "c int, r int, z double"), grid, zoom)


def array_of(layer, shape):
    out = np.full(shape, np.nan)
    for row in tiles_to_cells(layer).collect():
        assert np.isnan(out[row.r, row.c]), "a cell came twice"
        out[row.r, row.c] = row.z
    return out


def rough(shape, seed, holes=0.1):
    rng = np.random.default_rng(seed)
    array = np.floor(rng.random(shape) * 1000) / 10
    array[rng.random(shape) < holes] = np.nan
    return array


def points_at(spark, cells, grid=SMALL):
    rows = [((c + 0.5) * grid.res, -(r + 0.5) * grid.res) for c, r in cells]
    return spark.createDataFrame(rows, "x double, y double")
