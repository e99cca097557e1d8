"""Between cell rows, tile rows and tile rows with a one-cell border."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ridgework.functions.keys import index_in_tile, tile_of
from ridgework.grid import Grid
from ridgework.layer import TILE_SCHEMA, Layer
from ridgework.operators.arrow_tiles import column, list_array, members, numbers, slices, tile_block
from ridgework.session import stream_join


def cells_to_tiles(cells: DataFrame, grid: Grid, zoom: int = 0) -> Layer:
    """Gather rows ``c, r, z`` (one per cell) into tiles.

    A group holds at most ``tile_size**2`` rows, since a cell occurs once; NoData cells are not
    shipped, and a tile without data has no row.
    """
    size = grid.cells_per_tile

    def scatter(batches):
        for batch in slices(batches, size):
            owner, pairs = members(column(batch, "packed"))
            block = np.full((batch.num_rows, size), np.nan)
            block[owner, numbers(pairs.field("at"))] = numbers(pairs.field("z"))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "col"), column(batch, "row"), list_array(block)], ["col", "row", "cells"]
            )

    packed = (
        cells.where(F.col("z").isNotNull() & ~F.isnan("z"))
        .select(
            tile_of("c", grid).alias("col"),
            tile_of("r", grid).alias("row"),
            F.struct(index_in_tile("c", "r", grid).alias("at"), F.col("z").cast("double").alias("z")).alias("cell"),
        )
        .groupBy("col", "row")
        .agg(F.collect_list("cell").alias("packed"))
    )
    return Layer(packed.mapInArrow(scatter, TILE_SCHEMA), grid, zoom)


def tiles_to_cells(layer: Layer, keep_nodata: bool = False) -> DataFrame:
    """One row ``c, r, z`` per cell; NoData cells only on request."""
    ts = layer.grid.tile_size
    cells = layer.tiles.select("col", "row", F.posexplode("cells").alias("at", "z")).select(
        (F.col("col") * ts + F.pmod("at", F.lit(ts))).cast("int").alias("c"),
        (F.col("row") * ts + F.floor(F.col("at") / F.lit(float(ts)))).cast("int").alias("r"),
        "z",
    )
    return cells if keep_nodata else cells.where(F.col("z").isNotNull())


def retile(layer: Layer, tile_size: int) -> Layer:
    """The same cells in tiles of another size.

    Tiles are cut where they lie into sub-tiles, whose side is the greatest that divides both sizes, and
    only sub-tiles with data are shuffled, once, to the tiles they belong to.
    """
    old, grid = layer.grid.tile_size, replace(layer.grid, tile_size=tile_size)
    if old == tile_size:
        return layer
    side = math.gcd(old, tile_size)
    cuts, joins = old // side, tile_size // side

    def cut(batches):
        for batch in slices(batches, old * old):
            parts = tile_block(batch, old).reshape(batch.num_rows, cuts, side, cuts, side).transpose(0, 1, 3, 2, 4).reshape(-1, side * side)
            kept = np.flatnonzero(~np.isnan(parts).all(axis=1))
            tile, place = np.divmod(kept, cuts * cuts)
            col, row = (numbers(column(batch, name))[tile] * cuts for name in ("col", "row"))
            yield pa.RecordBatch.from_arrays(
                [pa.array((col + place % cuts).astype(np.int32)), pa.array((row + place // cuts).astype(np.int32)), list_array(parts[kept])],
                ["col", "row", "cells"],
            )

    def join(batches):
        for batch in slices(batches, tile_size * tile_size):
            owner, parts = members(column(batch, "parts"))
            block = np.full((batch.num_rows, joins, joins, side, side), np.nan)
            values = numbers(parts.field("cells").flatten()).reshape(-1, side, side)
            block[owner, numbers(parts.field("down")), numbers(parts.field("along"))] = values
            whole = block.transpose(0, 1, 3, 2, 4).reshape(batch.num_rows, tile_size, tile_size)
            yield pa.RecordBatch.from_arrays([column(batch, "col"), column(batch, "row"), list_array(whole)], ["col", "row", "cells"])

    small = layer.keyed.mapInArrow(cut, TILE_SCHEMA)
    if joins == 1:
        return Layer(small, grid, layer.zoom)
    part = F.struct(F.pmod("row", F.lit(joins)).alias("down"), F.pmod("col", F.lit(joins)).alias("along"), "cells")
    owner = [F.floor(F.col(name) / F.lit(float(joins))).cast("int").alias(name) for name in ("col", "row")]
    gathered = small.select(part.alias("part"), *owner).groupBy("col", "row").agg(F.collect_list("part").alias("parts"))
    return Layer(gathered.mapInArrow(join, TILE_SCHEMA), grid, layer.zoom)


def _edge_row(r: int, ts: int) -> Column:
    return F.slice("cells", r * ts + 1, ts)


def _edge_column(c: int, ts: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(ts - 1)), lambda i: F.element_at("cells", (i * ts + c + 1).cast("int")))


def _corner(c: int, r: int, ts: int) -> Column:
    return F.array(F.element_at("cells", r * ts + c + 1))


def rim(ts: int) -> Column:
    """The strips ``(ox, oy, strip)`` of ``cells`` that adjoin each of the eight tiles around."""
    at = {-1: 0, 1: ts - 1}

    def strip(ox: int, oy: int) -> Column:
        if oy == 0:
            return _edge_column(at[ox], ts)
        return _edge_row(at[oy], ts) if ox == 0 else _corner(at[ox], at[oy], ts)

    return F.array(*[
        F.struct(F.lit(ox).alias("ox"), F.lit(oy).alias("oy"), strip(ox, oy).alias("strip"))
        for ox in (-1, 0, 1) for oy in (-1, 0, 1) if (ox, oy) != (0, 0)
    ])


def with_halo(layer: Layer) -> DataFrame:
    """Tile rows with ``halo``: the adjoining strips ``(dx, dy, strip)`` of up to eight neighbours.

    Each tile sends its rim, about ``4 / tile_size`` of its cells, to the neighbours; whole tiles
    are shuffled once, to meet the strips sent to them. A stored layer keeps the rims in a column
    of their own, so sending them does not read the cells.
    """
    sent = F.col("rim") if layer.stored else rim(layer.grid.tile_size)
    halo = (
        layer.tiles.select("col", "row", F.inline(sent))
        .select(
            (F.col("col") + F.col("ox")).alias("col"),
            (F.col("row") + F.col("oy")).alias("row"),
            F.struct((-F.col("ox")).alias("dx"), (-F.col("oy")).alias("dy"), "strip").alias("side"),
        )
        .groupBy("col", "row")
        .agg(F.collect_list("side").alias("halo"))
    )
    return stream_join(layer.keyed, halo, ["col", "row"], "left", is_small=False)


def padded_block(batch: pa.RecordBatch, tile_size: int, block: np.ndarray, outside: float = np.nan) -> np.ndarray:
    """``block`` grown by one cell on each side and filled from the ``halo`` column."""
    padded = np.full((block.shape[0], tile_size + 2, tile_size + 2), outside)
    padded[:, 1:-1, 1:-1] = block
    owner, sides = members(column(batch, "halo"))
    if len(owner) == 0:
        return padded
    dx, dy = numbers(sides.field("dx")), numbers(sides.field("dy"))
    span = {-1: slice(0, 1), 0: slice(1, -1), 1: slice(-1, None)}
    for x in (-1, 0, 1):
        for y in (-1, 0, 1):
            chosen = np.flatnonzero((dx == x) & (dy == y))
            if len(chosen):
                values = numbers(sides.field("strip").take(pa.array(chosen)).flatten())
                shape = (len(chosen), 1 if y else tile_size, 1 if x else tile_size)
                padded[owner[chosen], span[y], span[x]] = values.reshape(shape)
    return padded
