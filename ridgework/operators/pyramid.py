"""Coarser levels of a layer."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ridgework.layer import Layer
from ridgework.operators.arrow_tiles import column, list_array, slices, tile_block
from ridgework.operators.tiling import retile

METHODS = ("nearest", "mean", "max", "min")


def _shrink(block: np.ndarray, method: str) -> np.ndarray:
    """Halve each side of the tiles in ``block``; NoData cells take no part in a statistic."""
    if method == "nearest":
        return block[:, 1::2, 1::2]
    count, side = block.shape[0], block.shape[1] // 2
    fours = block.reshape(count, side, 2, side, 2).transpose(0, 1, 3, 2, 4).reshape(count, side, side, 4)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return {"mean": np.nanmean, "max": np.nanmax, "min": np.nanmin}[method](fours, axis=-1)


def coarsen(layer: Layer, method: str = "nearest") -> Layer:
    """The next coarser level.

    Tiles shrink to a quarter where they lie; only quarters are shuffled to their parent, which
    joins at most four of them.
    """
    return Layer(coarser_tiles(layer.keyed, layer.grid.tile_size, method, []), layer.grid.coarser(), layer.zoom - 1)


def coarser_tiles(tiles: DataFrame, ts: int, method: str, of: list[str]) -> DataFrame:
    """The next coarser level of tile rows ``*of, col, row, cells``, apart for each value of the bigint columns ``of``."""
    if method not in METHODS:
        raise ValueError(f"unknown resampling {method!r}; known: {', '.join(METHODS)}")
    if ts % 2:
        raise ValueError("a pyramid needs an even tile size")
    half = ts // 2

    def quarter(batches):
        for batch in slices(batches, ts * ts):
            small = _shrink(tile_block(batch, ts), method)
            kept = np.flatnonzero(~np.isnan(small).all(axis=(1, 2)))
            yield pa.RecordBatch.from_arrays(
                [column(batch, k).take(pa.array(kept)) for k in (*of, "col", "row")] + [list_array(small[kept])],
                [*of, "col", "row", "cells"],
            )

    place = (F.pmod("row", F.lit(2)) * 2 + F.pmod("col", F.lit(2))).cast("int")
    parents = (
        tiles.select(*of, "col", "row", "cells")
        .mapInArrow(quarter, "".join(f"{name} bigint, " for name in of) + "col int, row int, cells array<double>")
        .groupBy(*of, F.shiftright("col", 1).alias("col"), F.shiftright("row", 1).alias("row"))
        .agg(F.map_from_entries(F.collect_list(F.struct(place.alias("place"), "cells"))).alias("quarters"))
    )

    def part(which: int) -> Column:
        blank = F.array_repeat(F.lit(None).cast("double"), half * half)
        return F.coalesce(F.try_element_at("quarters", F.lit(which)), blank)

    def strip(left: Column, right: Column) -> Column:
        def row(i: Column) -> Column:
            at = (i * half + 1).cast("int")
            return F.concat(F.slice(left, at, half), F.slice(right, at, half))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(half - 1)), row))

    split = parents.select(*of, "col", "row", *[part(i).alias(f"q{i}") for i in range(4)])
    cells = F.concat(strip(F.col("q0"), F.col("q1")), strip(F.col("q2"), F.col("q3")))
    return split.select(*of, "col", "row", cells.alias("cells"))


def pyramid(layer: Layer, to_zoom: int = 1, method: str = "nearest") -> Iterator[Layer]:
    """The layer itself and every coarser level down to ``to_zoom``, each made from the last."""
    yield layer
    while layer.zoom > to_zoom:
        layer = coarsen(layer, method)
        yield layer


def store_pyramid(
    catalog, layer: Layer, name: str, to_zoom: int = 1, method: str = "nearest", overwrite: bool = False, tile_size: int | None = None,
) -> None:
    """Write every level of the pyramid, in tiles of ``tile_size`` if given; each level is made from the stored one below it."""
    layer = layer if tile_size is None else retile(layer, tile_size)
    catalog.write_layer(layer, name, overwrite=overwrite)
    for zoom in range(layer.zoom - 1, to_zoom - 1, -1):
        catalog.write_layer(coarsen(catalog.read_layer(name, zoom + 1), method), name, overwrite=overwrite)


def ensure_partitions(layer: Layer, least: int = 128) -> Layer:
    """Spread the tiles over at least ``least`` partitions.

    A layer that already has enough is left alone. A stored layer counts the splits of its files and any
    other one the partitions that its plan names, so nothing is run to find out; where the plan names none
    the tiles are dealt out.
    """
    if layer.stored:
        there = layer.tiles.rdd.getNumPartitions()
    else:
        there = layer.tiles._jdf.queryExecution().sparkPlan().outputPartitioning().numPartitions()
    if there >= least:
        return layer
    return layer.with_tiles(layer.keyed.repartition(least, "col", "row"))
