"""Reading part of a layer: filters that reach the partition folders of a stored one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ridgework.functions.keys import zorder_key
from ridgework.functions.zcurve import box_intervals, coarse_intervals, in_intervals
from ridgework.layer import Layer
from ridgework.session import broadcastable, fits, stage, stream_join

KEY_BYTES = 48
_KEY = ["col", "row"]


def block_column(bits: int):
    return F.shiftright(zorder_key("col", "row"), bits)


def in_box(layer: Layer, west: int, north: int, east: int, south: int) -> DataFrame:
    """Tile rows ``col, row, cells`` in a box of keys (inclusive).

    A stored layer opens only the blocks that the box meets: the box is turned into intervals of blocks.
    """
    tiles = layer.tiles.where(F.col("col").between(west, east) & F.col("row").between(north, south))
    if layer.stored:
        tiles = tiles.where(in_intervals("block", box_intervals(west, north, east, south, layer.block_bits)))
    return tiles.select("col", "row", "cells")


def at_keys(layer: Layer, keys: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Tile rows whose key is among ``keys`` (``col, row``), within a box known to hold them if given.

    On a stored layer the keys' blocks prune the partition folders: by their ends when planning, and
    one by one while running, since the broadcast of the keys is what the scan waits for. The keys and their
    blocks are stored first: a block that is still an expression of the key would be put in place of ``block`` at both
    ends of every interval, in a filter on the keys that takes the driver a heap of its own to compile.
    """
    wanted = keys.select(*_KEY).distinct()
    if not layer.stored:
        tiles = layer.keyed if box is None else in_box(layer, *box)
        return stream_join(tiles, wanted, _KEY, "left_semi", fits(wanted, KEY_BYTES))
    wanted = stage(wanted.withColumn("home", block_column(layer.block_bits)), "keys").withColumnRenamed("home", "block")
    ends = wanted.agg(F.count("*").alias("n"), F.min("block").alias("lo"), F.max("block").alias("hi")).first()
    if not ends.n:
        return layer.keyed.where(F.lit(False))
    among = F.col("block").between(ends.lo, ends.hi)
    tiles = layer.tiles.where(among)
    if box is not None:
        tiles = tiles.where(in_intervals("block", box_intervals(*box, layer.block_bits)))
    met = stream_join(tiles, wanted.where(among), ["block", *_KEY], "left_semi", broadcastable(ends.n, KEY_BYTES))
    return met.select(*_KEY, "cells")


def in_blocks_of(layer: Layer, keys: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Tile rows in a box, of a stored layer only those in a block that holds one of ``keys`` (``col, row``).

    The blocks' broadcast prunes the partition folders while running; too many blocks prune by the box alone.
    """
    tiles = in_box(layer, *box)
    if not layer.stored:
        return tiles
    blocks = keys.select(block_column(layer.block_bits).alias("block")).distinct()
    if not fits(blocks, KEY_BYTES):
        return tiles
    west, north, east, south = box
    among = layer.tiles.where(in_intervals("block", box_intervals(west, north, east, south, layer.block_bits)))
    met = among.join(F.broadcast(blocks), "block", "left_semi")
    return met.where(F.col("col").between(west, east) & F.col("row").between(north, south)).select(*_KEY, "cells")


def at_runs(layer: Layer, runs: DataFrame) -> DataFrame:
    """Tile rows whose position on the Z curve lies in ``runs`` (``lo, hi``).

    A bounded list of intervals that hold the runs filters the scan; the tiles left meet the runs by block.
    """
    spans = coarse_intervals(runs)
    bits = layer.block_bits
    tiles = layer.tiles if layer.stored else layer.keyed.withColumn("zkey", zorder_key(*_KEY))
    if layer.stored:
        tiles = tiles.where(in_intervals("block", [(low >> bits, high >> bits) for low, high in spans]))
    tiles = tiles.where(in_intervals("zkey", spans)).withColumn("piece", F.shiftright("zkey", 16))
    held = runs.select(F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))).alias("piece"), "lo", "hi")
    small = fits(held, KEY_BYTES)
    near = F.broadcast(held) if small else held
    return tiles.join(near, (tiles["piece"] == near["piece"]) & F.col("zkey").between(F.col("lo"), F.col("hi")), "left_semi").select(*_KEY, "cells")
