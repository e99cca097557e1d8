"""Keeping part of a layer: by tile key or by polygon."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ridgework.functions.keys import tile_of
from ridgework.grid import Grid
from ridgework.layer import TILE_SCHEMA, Layer
from ridgework.operators.arrow_tiles import column, members, numbers, slices, tile_batch, tile_block
from ridgework.operators.pruning import at_keys, in_blocks_of
from ridgework.session import broadcastable, discard, spread, stage, stream_join
from ridgework.sources.vectors import polygon_edges

# Upper estimate of one span inside a tile's list.
SPAN_BYTES = 64
# Tile columns are covered in pieces of 64, the bits of a long.
PIECE_BITS = 6


def filter_keys(layer: Layer, keys: DataFrame) -> Layer:
    """Tiles whose key is among ``keys`` (``col, row``)."""
    return layer.with_tiles(at_keys(layer, keys))


def _in_cells(vertices: DataFrame, grid: Grid) -> DataFrame:
    """Edges ``geom_id, ax, ay, bx, by`` counted in cells right and down from the grid's corner."""
    to_u = lambda x: (F.col(x) - F.lit(grid.xmin)) / F.lit(grid.res)
    to_v = lambda y: (F.lit(grid.ymax) - F.col(y)) / F.lit(grid.res)
    return polygon_edges(vertices).select(
        "geom_id", to_u("ax").alias("ax"), to_v("ay").alias("ay"), to_u("bx").alias("bx"), to_v("by").alias("by")
    )


def _cut(y: Column) -> Column:
    """Where an edge crosses the height ``y``; NULL for a level edge."""
    return (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)) + F.col("ax")


def outline_tiles(edges: DataFrame, ts: int) -> DataFrame:
    """Tiles ``geom_id, row, col`` that an edge runs through or passes within one cell at the side."""
    rows = edges.withColumn("row", F.explode(F.sequence(
        F.floor(F.least("ay", "by") / ts).cast("int"), F.floor(F.greatest("ay", "by") / ts).cast("int")
    )))
    top = F.greatest(F.least("ay", "by"), (F.col("row") * ts).cast("double"))
    bottom = F.least(F.greatest("ay", "by"), ((F.col("row") + 1) * ts).cast("double"))
    ends = rows.select("geom_id", "row", F.coalesce(_cut(top), "ax").alias("u"), F.coalesce(_cut(bottom), "bx").alias("v"))
    column_of = lambda x: F.floor(x / ts).cast("int")
    return ends.select("geom_id", "row", F.explode(F.sequence(
        column_of(F.least("u", "v") - 1), column_of(F.greatest("u", "v") + 1)
    )).alias("col")).distinct()


def outline_lines(vertices: DataFrame, grid: Grid) -> DataFrame:
    """Lines of the outline's tiles: ``geom_id, row, line, col, enter, flips, next``.

    Even-odd rule over all rings of one ``geom_id``. Every edge marks, on each cell row it crosses, the
    column from which inside and outside change places; flips are reduced to one parity per cell row, column and
    geometry. ``flips`` are those inside the tile, ``enter`` is the parity carried to its left side, a prefix
    sum along one line of cells of one geometry, and ``next`` is the next tile of the outline on the row.
    Tiles off the outline do not appear, so a line holds no more rows than the outline has tiles on it.
    """
    ts = grid.tile_size
    edges = _in_cells(vertices, grid)
    # Cell row r is crossed when exactly one end lies below its middle line r + 0.5.
    first = F.ceil(F.least("ay", "by") - F.lit(0.5))
    last = F.ceil(F.greatest("ay", "by") - F.lit(0.5)) - 1
    flips = (
        edges.where(first <= last)
        .withColumn("r", F.explode(F.sequence(first, last)))
        .select("geom_id", "r", F.ceil(_cut(F.col("r") + F.lit(0.5)) - F.lit(0.5)).alias("k"))
        .groupBy("geom_id", "r", "k")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") % 2 == 1)
        .select(
            "geom_id", tile_of("r", grid).alias("row"), F.pmod("r", F.lit(ts)).cast("int").alias("line"),
            tile_of("k", grid).alias("col"), F.pmod("k", F.lit(ts)).cast("int").alias("at"),
        )
    )
    every = outline_tiles(edges, ts).select(
        "geom_id", "row", F.explode(F.sequence(F.lit(0), F.lit(ts - 1))).alias("line"), "col", F.lit(None).cast("int").alias("at")
    )
    line = ["geom_id", "row", "line"]
    along = Window.partitionBy(*line).orderBy("col")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    dealt = spread(flips.unionByName(every), line)
    met = dealt.groupBy(*line, "col").agg(F.array_sort(F.collect_list("at")).alias("flips"))
    return met.select(
        *line, "col", (F.coalesce(F.sum(F.size("flips")).over(before), F.lit(0)) % 2).cast("int").alias("enter"), "flips",
        F.lead("col").over(along).alias("next"),
    )


def outline_spans(lines: DataFrame, ts: int) -> DataFrame:
    """``col, row, whole, spans`` of the outline's tiles: runs ``line, start, stop`` of cells that are inside.

    Runs of several geometries may overlap. A tile covered on every line carries a flag in place of its runs.
    """
    turns = F.concat(F.when(F.col("enter") == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), "flips")
    runs = (
        lines.select("row", "line", "col", turns.alias("turns"))
        .where(F.size("turns") > 0)
        .select("col", "row", "line", F.explode(F.sequence(F.lit(0), F.size("turns") - 1, F.lit(2))).alias("i"), "turns")
        .select("col", "row", "line", F.get("turns", F.col("i")).alias("start"), F.coalesce(F.get("turns", F.col("i") + 1), F.lit(ts)).alias("stop"))
        .where("start < stop")
    )
    covered = F.size(F.collect_set(F.when((F.col("start") == 0) & (F.col("stop") == ts), F.col("line")))) == ts
    found = runs.groupBy("col", "row").agg(covered.alias("whole"), F.collect_list(F.struct("line", "start", "stop")).alias("spans"))
    return found.withColumn("spans", F.when(F.col("whole"), F.slice("spans", 1, 0)).otherwise(F.col("spans")))


def inner_cover(lines: DataFrame) -> DataFrame:
    """Tiles off the outline that are inside, as ``row, piece, bits``: one bit for each of 64 columns.

    No edge runs through such a tile, so its first line speaks for all of it.
    """
    after = (F.col("enter") + F.size("flips")) % 2 == 1
    runs = lines.where((F.col("line") == 0) & after & (F.col("next") > F.col("col") + 1)).select(
        "row", (F.col("col") + 1).alias("lo"), (F.col("next") - 1).alias("hi"))
    pieces = runs.withColumn("piece", F.explode(F.sequence(F.shiftright("lo", PIECE_BITS), F.shiftright("hi", PIECE_BITS))))
    inside = pieces.selectExpr(
        "row", "piece", f"greatest(lo - shiftleft(piece, {PIECE_BITS}), 0) as lo", f"least(hi - shiftleft(piece, {PIECE_BITS}), 63) as hi")
    bits = F.expr("shiftleft(shiftrightunsigned(-1L, 63 - (hi - lo)), lo)")
    return inside.groupBy("row", "piece").agg(F.bit_or(bits).alias("bits"))


def covered_keys(cover: DataFrame) -> DataFrame:
    """The tiles of ``inner_cover`` one by one, ``col, row``."""
    inside = F.expr("filter(sequence(0, 63), j -> (shiftright(bits, j) & 1L) = 1L)")
    return cover.select("row", "piece", F.explode(inside).alias("j")).select((F.col("j") + F.shiftleft("piece", PIECE_BITS)).alias("col"), "row")


def mask_layer(layer: Layer, vertices: DataFrame) -> Layer:
    """Cells whose middle is outside every area become NoData; tiles left empty are dropped.

    Cells are looked at along the outline only; what lies within is kept by whole tiles.
    """
    ts = layer.grid.tile_size

    def cut(batches):
        for batch in slices(batches, ts * ts):
            owner, spans = members(column(batch, "spans"))
            line, start, stop = (numbers(spans.field(k)) for k in ("line", "start", "stop"))
            flips = np.zeros((batch.num_rows, ts, ts + 1), dtype=np.int32)
            np.add.at(flips, (owner, line, start), 1)
            np.add.at(flips, (owner, line, stop), -1)
            inside = np.cumsum(flips, axis=2)[:, :, :ts] > 0
            inside[numbers(column(batch, "whole")).astype(bool)] = True
            yield tile_batch(batch, np.where(inside, tile_block(batch, ts), np.nan))

    lines = stage(outline_lines(vertices, layer.grid), "outline")
    spans, cover = stage(outline_spans(lines, ts), "spans"), stage(inner_cover(lines), "cover")
    discard(lines)
    parts = spans.select("col", "row", F.size("spans").alias("n"), F.lit(0).alias("pieces")).unionByName(
        cover.select(F.explode(F.array(F.shiftleft("piece", PIECE_BITS), F.shiftleft("piece", PIECE_BITS) + 63)).alias("col"), "row", F.lit(0).alias("n"), F.lit(1).alias("pieces"))
    )
    around = parts.agg(
        F.min("col").alias("west"), F.max("col").alias("east"), F.min("row").alias("north"),
        F.max("row").alias("south"), F.count("*").alias("tiles"), F.sum(F.col("n") + F.col("pieces")).alias("n"),
    ).first()
    if not around.tiles:
        return layer.with_tiles(layer.keyed.where(F.lit(False)))
    side = 1 << min(layer.block_bits // 2, PIECE_BITS)
    corners = cover.select(F.explode(F.sequence(F.shiftleft("piece", PIECE_BITS), F.shiftleft("piece", PIECE_BITS) + 63, F.lit(side))).alias("col"), "row")
    near = in_blocks_of(layer, spans.select("col", "row").unionByName(corners), (around.west, around.north, around.east, around.south))
    whole, none = F.coalesce("whole", F.lit(False)), F.array().cast(spans.schema["spans"].dataType)
    if broadcastable(around.tiles + around.n, SPAN_BYTES):
        met = near.withColumn("piece", F.shiftright("col", PIECE_BITS)).join(F.broadcast(cover), ["row", "piece"], "left").join(F.broadcast(spans), ["col", "row"], "left")
        within = F.coalesce(F.expr(f"(shiftright(bits, col - shiftleft(piece, {PIECE_BITS})) & 1L) = 1L"), F.lit(False))
    else:
        # One list of both, so that the tiles are shuffled once.
        listed = spans.join(covered_keys(cover).withColumn("within", F.lit(True)), ["col", "row"], "full")
        met = stream_join(near, listed, ["col", "row"], "inner", False)
        within = F.coalesce("within", F.lit(False))
    kept = met.select("col", "row", "cells", (whole | within).alias("whole"), F.when(whole | within, none).otherwise(F.coalesce("spans", none)).alias("spans"))
    masked = kept.where(F.col("whole") | (F.size("spans") > 0)).mapInArrow(cut, TILE_SCHEMA)
    return layer.with_tiles(masked.where(F.exists("cells", lambda z: z.isNotNull())))
