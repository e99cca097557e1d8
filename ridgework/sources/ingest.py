"""Loose elevation samples into a tiled layer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridgework.functions.geo import to_web_mercator
from ridgework.functions.keys import cell_center, map_to_cell, tile_of
from ridgework.functions.values import is_data
from ridgework.grid import Grid
from ridgework.layer import TILE_SCHEMA, Layer
from ridgework.operators.arrow_tiles import CELLS_AT_ONCE, column, list_array, numbers
from ridgework.operators.tiling import tiles_to_cells

# Samples a task looks at together before it passes on the nearest of each cell.
SAMPLES_AT_ONCE = 1 << 20
_SAMPLE = ("c", "r", "d2", "lon", "lat", "z")


def _first_per_cell(rows: np.ndarray) -> np.ndarray:
    """Of rows ``c, r, d2, lon, lat, z`` (as the rows of an array) the first of each cell in the order of the other four."""
    rows = rows[:, np.lexsort(rows[[5, 4, 3, 2, 0, 1]])]
    fresh = np.append(True, np.any(rows[:2, 1:] != rows[:2, :-1], axis=0)) if rows.shape[1] else []
    return rows[:, np.flatnonzero(fresh)]


def _candidates(samples: DataFrame, grid: Grid) -> DataFrame:
    """``col, row`` and, of the samples of every task that lie nearest to a cell's middle, ``c, r, d2, lon, lat, z``."""
    x, y = to_web_mercator("lon", "lat")
    c, r = map_to_cell("x", "y", grid)
    cx, cy = cell_center("c", "r", grid)
    placed = (
        samples.where(is_data("z"))
        .select("lon", "lat", "z", x.alias("x"), y.alias("y"))
        .withColumns({"c": c, "r": r})
        .where(F.col("c").isNotNull() & F.col("r").isNotNull())
    )
    off_x, off_y = F.col("x") - cx, F.col("y") - cy
    ranked = placed.select(*[F.col(name).cast("double") for name in ("c", "r")], (off_x * off_x + off_y * off_y).alias("d2"), *[
        F.col(name).cast("double") for name in ("lon", "lat", "z")])

    def reduce(batches):
        held, count = [], 0
        for batch in batches:
            held.append(np.stack([numbers(values) for values in batch.columns]))
            count += batch.num_rows
            if count >= SAMPLES_AT_ONCE:
                yield batch_of(_first_per_cell(np.concatenate(held, axis=1)))
                held, count = [], 0
        if count:
            yield batch_of(_first_per_cell(np.concatenate(held, axis=1)))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(values) for values in rows], list(_SAMPLE))

    reduced = ranked.mapInArrow(reduce, ", ".join(f"{name} double" for name in _SAMPLE))
    return reduced.withColumns({"col": tile_of("c", grid), "row": tile_of("r", grid)})


def nearest_tiles(samples: DataFrame, grid: Grid) -> DataFrame:
    """Tile rows with, in every cell, the sample nearest to its middle (of equally near ones the least ``lon, lat, z``).

    Every task first keeps one sample per cell of a million; what is left is shuffled once, by tile, and comes to
    the tile's task in tile order, which reduces it again as it streams by. No tile's samples are gathered, so neither
    a cell nor a tile that holds most of the samples needs more memory than others.
    """
    ts = grid.tile_size

    def tiles_of(rows):
        keys = np.floor(rows[:2] / ts).astype(np.int64)
        (cols, rows_), owner = np.unique(keys, axis=1, return_inverse=True)
        block = np.full((len(cols), ts * ts), np.nan)
        block[owner.ravel(), (np.mod(rows[1], ts) * ts + np.mod(rows[0], ts)).astype(np.int64)] = rows[5]
        return pa.RecordBatch.from_arrays([pa.array(cols.astype(np.int32)), pa.array(rows_.astype(np.int32)), list_array(block)], ["col", "row", "cells"])

    def gather(batches):
        held = np.empty((6, 0))
        for batch in batches:
            # Tiles come one after the other, so only the last one of a batch may go on in the next.
            last = [column(batch, name)[batch.num_rows - 1].as_py() for name in ("col", "row")] if batch.num_rows else None
            held = _first_per_cell(np.concatenate([held, np.stack([numbers(column(batch, name)) for name in _SAMPLE])], axis=1))
            open_ = (np.floor(held[0] / ts) == last[0]) & (np.floor(held[1] / ts) == last[1]) if last else np.ones(held.shape[1], bool)
            if not open_.all():
                yield from (tiles_of(part) for part in _pieces(held[:, ~open_], ts))
            held = held[:, open_]
        if held.shape[1]:
            yield tiles_of(held)

    dealt = _candidates(samples, grid).repartition("col", "row").sortWithinPartitions("col", "row")
    return dealt.mapInArrow(gather, TILE_SCHEMA)


def _pieces(rows: np.ndarray, ts: int):
    """Whole tiles of a batch, in parts whose cells keep to the usual size of a kernel's temporaries."""
    keys = np.floor(rows[:2] / ts)
    rows = rows[:, np.lexsort(keys)]
    keys = np.floor(rows[:2] / ts)
    starts = np.flatnonzero(np.append(True, np.any(keys[:, 1:] != keys[:, :-1], axis=0)))
    step = max(CELLS_AT_ONCE // (ts * ts), 1)
    cuts = starts[::step]
    for low, high in zip(cuts, np.append(cuts[1:], rows.shape[1])):
        yield rows[:, low:high]


def nearest_samples(samples: DataFrame, grid: Grid) -> DataFrame:
    """Rows ``c, r, z`` with the sample nearest to each cell's middle."""
    return tiles_to_cells(Layer(nearest_tiles(samples, grid), grid))


def ingest_samples(samples: DataFrame, zoom: int, tile_size: int = 256) -> Layer:
    """Reproject ``lon, lat, z`` samples and grid them on the zoomed Web Mercator layout."""
    grid = Grid.zoomed(zoom, tile_size)
    return Layer(nearest_tiles(samples, grid), grid, zoom)
