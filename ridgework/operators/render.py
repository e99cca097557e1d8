"""Colouring a layer by class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ridgework.functions.ramps import DEFAULT_RAMP, ramp_stops
from ridgework.layer import Layer
from ridgework.operators.arrow_tiles import column, slices, tile_block
from ridgework.operators.stats import CLASSES, Classes, class_table, classes_of, layer_classes
from ridgework.session import checked_broadcast


def render_tiles(layer: Layer, classes: Classes, ramp: str = DEFAULT_RAMP) -> DataFrame:
    """Rows ``col, row, argb array<int>``: one packed colour per cell, 0 for NoData.

    Colours run linearly between the ramp's stops over the classes and are rounded half up.
    """
    ts = layer.grid.tile_size

    def paint(batches):
        for batch in slices(batches, ts * ts):
            yield _painted(batch, ["col", "row"], ts, _colours(tile_block(batch, ts).ravel(), classes, ramp))

    return layer.keyed.mapInArrow(paint, "col int, row int, argb array<int>")


def _colours(z: np.ndarray, classes: Classes, ramp: str) -> np.ndarray:
    stops = np.array(ramp_stops(ramp), dtype=np.float64)
    last, steps = len(stops) - 1, max(classes.count - 1, 1)
    data = ~np.isnan(z)
    at = classes.index_array(z[data]) * float(last) / float(steps)
    left = np.minimum(np.floor(at), last - 1).astype(np.int64)
    low, high = stops[left], stops[left + 1]
    rgb = np.floor(low + (high - low) * (at - left)[:, None] + 0.5).astype(np.uint32)
    argb = np.zeros(len(z), dtype=np.uint32)
    argb[data] = np.uint32(255 << 24) | rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]
    return argb


def _painted(batch: pa.RecordBatch, keys: list[str], ts: int, argb: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(ts * ts))
    cells = pa.ListArray.from_arrays(offsets, pa.array(argb.view(np.int32)))
    return pa.RecordBatch.from_arrays([*[column(batch, key) for key in keys], cells], [*keys, "argb"])


def render_stored(catalog, names: list[str], zoom: int, ramp: str = DEFAULT_RAMP, n: int = CLASSES) -> DataFrame:
    """Rows ``layer, col, row, argb`` of stored layers of one tile size, each coloured by what is stored about it.

    A layer's classes are the breaks of its stored histogram, else the whole numbers up to its stored count of viewpoints,
    else 0 and 1. All layers are one scan; the classes, one row a layer, come to the tiles by a join.
    """
    sizes = {catalog.grid(name, zoom).tile_size for name in names}
    if len(sizes) != 1:
        raise ValueError("layers of several tile sizes")
    ts = sizes.pop()
    facts = checked_broadcast(class_table(catalog, n).where(F.col("layer").isin(names)), 8 * n + 64)

    def paint(batches):
        known = {}
        for batch in slices(batches, ts * ts):
            blocks = tile_block(batch, ts).reshape(batch.num_rows, -1)
            argb = np.zeros(blocks.shape, dtype=np.uint32)
            layers = column(batch, "layer").to_pylist()
            for i, name in enumerate(layers):
                if name not in known:
                    known[name] = classes_of(column(batch, "breaks")[i].as_py(), column(batch, "upto")[i].as_py())
                argb[i] = _colours(blocks[i], known[name], ramp)
            yield _painted(batch, ["layer", "col", "row"], ts, argb.ravel())

    tiles = catalog.read_layers(names, zoom).join(facts, "layer", "left")
    return tiles.mapInArrow(paint, "layer string, col int, row int, argb array<int>")


def pixels(painted: DataFrame, ts: int) -> DataFrame:
    """Rows ``c, r, red, green, blue, alpha`` (and ``layer``, if there is one) for every cell of painted tiles."""

    def channel(shift: int) -> Column:
        return F.shiftrightunsigned("argb", shift).bitwiseAND(F.lit(255))

    owner = [name for name in painted.columns if name == "layer"]
    return painted.select(*owner, "col", "row", F.posexplode("argb").alias("at", "argb")).select(
        *owner, (F.col("col") * ts + F.pmod("at", F.lit(ts))).alias("c"),
        (F.col("row") * ts + F.floor(F.col("at") / F.lit(float(ts)))).cast("int").alias("r"),
        channel(16).alias("red"), channel(8).alias("green"), channel(0).alias("blue"), channel(24).alias("alpha"),
    )


def render_layer(layer: Layer, classes: Classes, ramp: str = DEFAULT_RAMP) -> DataFrame:
    """Rows ``c, r, red, green, blue, alpha`` for every cell; NoData is fully transparent."""
    return pixels(render_tiles(layer, classes, ramp), layer.grid.tile_size)


def render_tile(
    catalog, name: str, zoom: int, col: int, row: int, classes: Classes | None = None, ramp: str = DEFAULT_RAMP,
) -> DataFrame:
    """The coloured cells of one stored tile, by the classes stored about its layer if none are given."""
    tile, classes = catalog.read_tile(name, zoom, col, row), classes or layer_classes(catalog, name)
    return render_layer(Layer(tile, catalog.grid(name, zoom), zoom), classes, ramp)
