"""Operators that look at the 3x3 window of each cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridgework.functions.keys import cell_center, zorder_key
from ridgework.layer import TILE_SCHEMA, Layer
from ridgework.operators.arrow_tiles import column, slices, tile_batch, tile_block
from ridgework.operators.tiling import padded_block, with_halo


def slope(layer: Layer, z_factor: float = 1.0) -> Layer:
    """Steepness in degrees by Horn's (1981) gradient, seamless across tiles.

    A missing neighbour takes the centre's value; a NoData centre stays NoData.
    """
    grid = layer.grid
    ts, eight_res = grid.tile_size, 8.0 * grid.res

    def gradient(batches):
        for batch in slices(batches, grid.cells_per_tile):
            centre = tile_block(batch, ts)
            padded = padded_block(batch, ts, centre)

            def window(dx: int, dy: int) -> np.ndarray:
                near = padded[:, 1 + dy:1 + dy + ts, 1 + dx:1 + dx + ts]
                return np.where(np.isnan(near), centre, near)

            west = window(-1, -1) + 2.0 * window(-1, 0) + window(-1, 1)
            east = window(1, -1) + 2.0 * window(1, 0) + window(1, 1)
            north = window(-1, -1) + 2.0 * window(0, -1) + window(1, -1)
            south = window(-1, 1) + 2.0 * window(0, 1) + window(1, 1)
            gx, gy = (east - west) * z_factor / eight_res, (south - north) * z_factor / eight_res
            steep = np.degrees(np.arctan(np.sqrt(gx * gx + gy * gy)))
            yield tile_batch(batch, np.where(np.isnan(centre), np.nan, steep))

    return layer.with_tiles(with_halo(layer).mapInArrow(gradient, TILE_SCHEMA))


def boundary_cells(layer: Layer, across_tiles: bool = False) -> DataFrame:
    """Cells ``c, r`` that are positive with a NoData or non-positive cell in their 3x3 window.

    By default the window ends at the tile, whose outside counts as positive, so no shuffle is
    needed; ``across_tiles`` looks into the neighbouring tiles, where an absent tile is NoData.
    """
    ts = layer.grid.tile_size

    def rim(batches):
        for batch in slices(batches, ts * ts):
            block = np.floor(tile_block(batch, ts))
            if across_tiles:
                padded = np.floor(padded_block(batch, ts, block))
            else:
                padded = np.pad(block, ((0, 0), (1, 1), (1, 1)), constant_values=1.0)
            empty = ~(padded > 0)
            touched = np.zeros(block.shape, dtype=bool)
            for dy in range(3):
                for dx in range(3):
                    touched |= empty[:, dy:dy + ts, dx:dx + ts]
            tile, r, c = np.nonzero((block > 0) & touched)
            col, row = (column(batch, k).to_numpy() for k in ("col", "row"))
            yield pa.RecordBatch.from_arrays(
                [pa.array((col[tile] * ts + c).astype(np.int32)), pa.array((row[tile] * ts + r).astype(np.int32))],
                ["c", "r"],
            )

    source = with_halo(layer) if across_tiles else layer.keyed
    return source.mapInArrow(rim, "c int, r int")


def boundary_points(layer: Layer, altitude: float, across_tiles: bool = False) -> DataFrame:
    """Viewpoints at ``altitude`` on the middle of every boundary cell, looking all round."""
    x, y = cell_center("c", "r", layer.grid)
    return boundary_cells(layer, across_tiles).select(
        zorder_key("c", "r").alias("vp_id"),
        x.alias("x"), y.alias("y"), *standing_at(altitude),
    )


def standing_at(altitude: float) -> list:
    return [
        F.lit(float(altitude)).alias("view_height"),
        F.lit(0.0).alias("angle"),
        F.lit(-1.0).alias("fov"),
        F.lit(float("-inf")).alias("altitude"),
    ]
