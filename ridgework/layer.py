"""A layer: tile rows plus the grid that places them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ridgework.grid import Grid

# What every in-flight tile DataFrame carries. NoData is NULL inside ``cells``.
TILE_SCHEMA = "col int, row int, cells array<double>"


@dataclass(frozen=True)
class Layer:
    """``tiles`` has one row per tile key: ``col, row, cells`` (see ``TILE_SCHEMA``).

    ``stored`` says that ``tiles`` reads straight from Parquet with a ``zkey`` column, so an
    operator that scans it many times need not write its own copy first. Stored tiles lie in one
    partition folder per ``block``, which is ``zkey`` without its low ``block_bits`` bits.
    """

    tiles: DataFrame
    grid: Grid
    zoom: int = 0
    stored: bool = False
    block_bits: int = 0

    def with_tiles(self, tiles: DataFrame) -> "Layer":
        return replace(self, tiles=tiles, stored=False, block_bits=0)

    @property
    def keyed(self) -> DataFrame:
        return self.tiles.select("col", "row", "cells")
