"""Least accumulated travel cost from start points over a friction layer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridgework.functions.keys import map_to_cell, tile_of, zorder_key
from ridgework.grid import Grid
from ridgework.layer import TILE_SCHEMA, Layer
from ridgework.operators.arrow_tiles import column, list_array, numbers, slices
from ridgework.session import broadcastable, drop_folder, fits, merge_join, scratch_dir, spread, stage, stream_join
from ridgework.sources.catalog import block_shift, z_ordered

# Cells of a block that one task settles at once; about 8 MB each of friction and cost.
SETTLE_CELLS = 1 << 20
# Folders of a level of the history that are merged into one of the next.
FAN = 4
MAIL_BYTES = 40
KEY_BYTES = 32
_BLOCK = ["hc", "hr"]

# A round's output: the settled block as its reached tiles, each its number in the block followed by the costs of its
# cells, and, per block alongside, the rim cells it should hear of.
_MAIL = "array<struct<hc: int, hr: int, letters: array<struct<c: int, r: int, cost: double, f: double>>>>"
_ROUND = f"hc int, hr int, cost array<double>, mail {_MAIL}"
_DIAGONAL = 1.4142135623730951
# Width of the frame around a tile: one cell for the neighbours' rims and one nobody enters.
_FRAME = 2
# Width of a bucket of costs, in steps over mean friction.
_BUCKET_STEPS = 2.0


def _spread(friction, cost, sources, res, max_cost):
    """Lower ``cost`` in place from the flat positions ``sources`` until nothing improves.

    ``friction`` and ``cost`` are framed blocks; the frame sends but never receives. Cells wait in buckets of
    cost: those within a typical step of the cheapest one waiting go first, together, so that few
    cells are lowered again later.
    """
    width = friction.shape[1]
    f, best = friction.ravel(), cost.ravel()
    enter = np.zeros(friction.shape, dtype=bool)
    enter[_FRAME:-_FRAME, _FRAME:-_FRAME] = friction[_FRAME:-_FRAME, _FRAME:-_FRAME] >= 0
    enter = enter.ravel()
    passable = f[enter]
    bucket = _BUCKET_STEPS * res * float(np.mean(passable)) if len(passable) else 0.0
    steps = [(dy * width + dx, _DIAGONAL if dx and dy else 1.0) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
    waits = np.zeros(best.shape, dtype=bool)
    waits[sources] = True
    while True:
        sources = np.flatnonzero(waits)
        if not len(sources):
            return
        offered = best[sources]
        sources = sources[offered <= offered.min() + bucket]
        waits[sources] = False
        for offset, length in steps:
            target = sources + offset
            reached = best[sources] + (f[sources] + f[target]) / 2.0 * length * res
            better = enter[target] & (reached < best[target]) & (reached <= max_cost)
            lowered = target[better]
            best[lowered] = reached[better]
            waits[lowered] = True


def _placed(grid: Grid):
    """Takes a settled block's ``cost`` apart: the numbers of its reached tiles and their cells."""
    width = 1 + grid.cells_per_tile

    def apart(cost):
        tiles = numbers(cost).reshape(-1, width)
        return tiles[:, 0].astype(np.int64), tiles[:, 1:]
    return apart


def _relax(grid: Grid, levels: int, max_cost: float):
    """Kernel of one round: settle each block with the mail it got, and write to the blocks alongside."""
    ts, wide, side, placed = grid.tile_size, grid.tile_size << levels, 1 << levels, _placed(grid)

    def rim(step, start, length):
        """Positions of the block's first or last line, or of any, in a part of it."""
        if step == 0:
            return np.arange(length)
        at = (0 if step < 0 else wide - 1) - start
        return np.arange(at, at + 1) if 0 <= at < length else np.arange(0)

    def outgoing(col, row, north, west, lower, cost, friction):
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if not (dx or dy):
                    continue
                r, c = np.meshgrid(rim(dy, north, lower.shape[0]), rim(dx, west, lower.shape[1]), indexing="ij")
                r, c = r.ravel(), c.ravel()
                sent = lower[r, c]
                r, c = r[sent], c[sent]
                if len(r):
                    yield (col + dx, row + dy), (col * wide + west + c, row * wide + north + r, cost[r, c], friction[r, c])

    def lists(lengths, values):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)

    def post(sent):
        """The ``mail`` column from, per block, its ``(address, letters)`` pairs."""
        addresses = np.array([to for block in sent for to, _ in block], dtype=np.int32).reshape(-1, 2)
        parts = [letters for block in sent for _, letters in block]
        flat = [np.concatenate(values) for values in zip(*parts)] if parts else [np.empty(0)] * 4
        letters = pa.StructArray.from_arrays(
            [pa.array(a.astype(t)) for a, t in zip(flat, [np.int32, np.int32, np.float64, np.float64])],
            ["c", "r", "cost", "f"],
        )
        mail = pa.StructArray.from_arrays(
            [pa.array(addresses[:, 0]), pa.array(addresses[:, 1]), lists([len(part[0]) for part in parts], letters)],
            ["hc", "hr", "letters"],
        )
        return lists([len(block) for block in sent], mail)

    def settled(batch):
        """One block: only the part of it that its tiles span is laid out."""
        col, row = (column(batch, name)[0].as_py() for name in _BLOCK)
        tiles, known, mail = column(batch, "tiles")[0].values, column(batch, "cost")[0], column(batch, "mail")[0].values
        down, along = numbers(tiles.field("row")) - (row << levels), numbers(tiles.field("col")) - (col << levels)
        top, left = int(down.min()), int(along.min())
        high, broad = (int(down.max()) + 1 - top) * ts, (int(along.max()) + 1 - left) * ts
        north, west = top * ts, left * ts
        core = slice(_FRAME, _FRAME + high), slice(_FRAME, _FRAME + broad)
        friction = np.full((high + 2 * _FRAME, broad + 2 * _FRAME), np.nan)
        cost = np.full(friction.shape, np.inf)
        laid, costs = (np.full((high // ts, ts, broad // ts, ts), empty) for empty in (np.nan, np.inf))
        laid[down - top, :, along - left] = numbers(tiles.field("cells").flatten()).reshape(-1, ts, ts)
        if known.is_valid:
            place, old = placed(known.values)
            old = old.reshape(-1, ts, ts)
            costs[place // side - top, :, place % side - left] = np.where(np.isnan(old), np.inf, old)
        friction[core], cost[core] = laid.reshape(high, broad), costs.reshape(high, broad)
        before = cost[core].copy()
        c = numbers(mail.field("c")).astype(np.int64) - (col * wide + west) + _FRAME
        r = numbers(mail.field("r")).astype(np.int64) - (row * wide + north) + _FRAME
        # Mail beside no tile says nothing here.
        met = (c >= 1) & (c < friction.shape[1] - 1) & (r >= 1) & (r < friction.shape[0] - 1)
        at = (r * friction.shape[1] + c)[met]
        offered, f = numbers(mail.field("cost"))[met], numbers(mail.field("f"))[met]
        foreign = ~np.isnan(f)
        friction.ravel()[at[foreign]] = f[foreign]
        use = (offered < cost.ravel()[at]) & (friction.ravel()[at] >= 0) & (offered <= max_cost)
        # Several blocks may offer one cell a cost.
        np.minimum.at(cost.ravel(), at[use], offered[use])
        _spread(friction, cost, at[use], grid.res, max_cost)
        after = cost[core]
        lower = after < before
        if not lower.any():
            return None
        sent = list(outgoing(col, row, north, west, lower & (after < max_cost), after, friction[core]))
        parts = after.reshape(high // ts, ts, broad // ts, ts).transpose(0, 2, 1, 3)
        i, j = np.nonzero((parts < np.inf).any(axis=(2, 3)))
        reached = parts[i, j]
        reached[np.isinf(reached)] = np.nan
        tiles = np.column_stack([(i + top) * side + j + left, reached.reshape(len(i), ts * ts)])
        return pa.RecordBatch.from_arrays(
            [column(batch, "hc"), column(batch, "hr"), list_array(tiles[None]), post([sent])], ["hc", "hr", "cost", "mail"])

    def kernel(batches):
        """A block at a time, whatever the number of blocks a task has."""
        for batch in batches:
            for i in range(batch.num_rows):
                found = settled(batch.slice(i, 1))
                if found is not None:
                    yield found
    return kernel


def _tiles_of_blocks(grid: Grid, levels: int):
    """Kernel: the reached tiles of settled blocks."""
    ts, side, placed = grid.tile_size, 1 << levels, _placed(grid)

    def kernel(batches):
        for batch in slices(batches, (ts << levels) ** 2):
            costs = column(batch, "cost")
            owner = np.repeat(np.arange(batch.num_rows), numbers(costs.value_lengths()) // (1 + ts * ts))
            place, cells = placed(costs.flatten())
            down, along = np.divmod(place, side)
            col, row = ((numbers(column(batch, name))[owner].astype(np.int64) << levels) for name in _BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array((col + along).astype(np.int32)), pa.array((row + down).astype(np.int32)), list_array(cells)],
                ["col", "row", "cells"],
            )
    return kernel


class History:
    """The settled blocks of all rounds, as a log that is merged while it grows.

    Every round appends a folder. Once a level holds ``FAN`` older folders they become one of the next
    level, which keeps of every block its last state; so the folders to look a block up in, and
    the keys read for it, do not grow with the number of rounds.
    """

    def __init__(self, spark, run: str):
        self.spark, self.run, self.made = spark, run, 0
        self.levels: list[list[int]] = [[]]

    def append(self, settled: DataFrame) -> DataFrame:
        """Store a round and give it back as stored."""
        age = self._store(settled.select("hc", "hr", "cost", "mail"), 0)
        for level, ages in enumerate(self.levels):
            # The newest folder still holds mail to be read.
            older = [a for a in ages if a != age]
            if len(older) >= FAN:
                merged = self._last(self._read(older), older).withColumn("mail", F.lit(None).cast(_MAIL))
                self._store(merged.select("hc", "hr", "cost", "mail"), level + 1)
                self.levels[level] = [a for a in ages if a not in older]
                for a in older:
                    drop_folder(self.spark, f"{self.run}/age={a}")
        return self._read([age])

    def _store(self, rows: DataFrame, level: int) -> int:
        age, self.made = self.made, self.made + 1
        rows.write.parquet(f"{self.run}/age={age}")
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(age)
        return age

    def _read(self, ages: list[int]) -> DataFrame:
        paths = [f"{self.run}/age={age}" for age in ages]
        return self.spark.read.schema(f"{_ROUND}, age int").option("basePath", self.run).parquet(*paths)

    def _last(self, rows: DataFrame, ages: list[int], keys: DataFrame | None = None, few: bool = False) -> DataFrame:
        """``hc, hr, cost`` of each block, or of those in ``keys``, from the last folder that has it.

        Found from the keys alone; costs are read only in folders that are some block's last. A folder of a
        higher level is older than all of lower ones, whatever its number.
        """
        order = {age: i for i, age in enumerate(a for level in reversed(self.levels) for a in level)}
        rank = F.create_map(*[F.lit(v) for age in ages for v in (age, order[age])])[F.col("age")]
        last = rows.select("hc", "hr", "age", rank.alias("rank"))
        if keys is not None:
            last = stream_join(last, keys, _BLOCK, "left_semi", few)
        last = stage(last.groupBy(*_BLOCK).agg(F.max_by("age", "rank").alias("age")), "last")
        needed = [row.age for row in last.select("age").distinct().collect()]
        costs = rows.where(F.col("age").isin(needed)).select(*_BLOCK, "age", "cost")
        return stream_join(costs, last, [*_BLOCK, "age"], "inner", fits(last, KEY_BYTES)).drop("age")

    def last(self, keys: DataFrame | None = None, few: bool = False) -> DataFrame:
        ages = [age for level in self.levels for age in level]
        return self._last(self._read(ages), ages, keys, few)


def settle_levels(grid: Grid, bits: int) -> int:
    """Block sides are ``2 ** levels`` tiles: the most that keeps to ``SETTLE_CELLS`` and within a stored block."""
    levels = 0
    while (grid.tile_size << (levels + 1)) ** 2 <= SETTLE_CELLS and 2 * (levels + 1) <= bits:
        levels += 1
    return levels


def travel_cost(friction: Layer, points: DataFrame, max_cost: float) -> Layer:
    """Cost of the cheapest eight-way path from any of ``points`` (``x, y``), up to ``max_cost``.

    A step costs the mean friction of its two cells times its length on the map. NoData and
    negative friction cannot be entered, and a start there is dropped. Cells not reached are NULL.

    Runs in rounds over square blocks of tiles. In each, blocks that got mail settle completely, in a task each, and post
    the rim cells that became cheaper to the blocks alongside; the search ends when no mail is left, so rounds count the
    blocks a path crosses, not its tiles. A round reads the tiles of blocks that got mail alone, by their folders; what a round
    settled is a Parquet folder in the shared scratch space, so a lost executor never repeats an earlier round.
    """
    spark, grid = friction.tiles.sparkSession, friction.grid
    bits = friction.block_bits if friction.stored else block_shift(grid)
    if friction.stored:
        ground = friction.tiles
    else:
        ground = stage(z_ordered(friction, bits).select("col", "row", "zkey", "cells", "block"), "friction", by=("block",))
    levels = settle_levels(grid, bits)
    home = [F.shiftright(name, levels).alias(block) for name, block in zip(("col", "row"), _BLOCK)]
    history = History(spark, scratch_dir(spark, "travel_cost"))

    c, r = map_to_cell("x", "y", grid)
    starts = points.select(c.alias("c"), r.alias("r")).distinct()
    begin = F.struct("c", "r", F.lit(0.0).alias("cost"), F.lit(None).cast("double").alias("f"))
    at = [F.shiftright(tile_of(name, grid), levels).alias(block) for name, block in zip("cr", _BLOCK)]
    mail = stage(starts.select(*at, F.array(begin).alias("letters")), "starts")

    rounds = 0
    while True:
        # Any tile of a block tells the stored block around it.
        corner = zorder_key(F.shiftleft("hc", levels), F.shiftleft("hr", levels))
        boxes = stage(mail.groupBy(*_BLOCK).agg(F.sum(F.size("letters")).alias("letters")).withColumn(
            "block", F.shiftright(corner, bits)), "blocks")
        front = boxes.agg(
            F.count("*").alias("n"), F.sum("letters").alias("letters"), F.min("block").alias("lo"), F.max("block").alias("hi")).first()
        if not front.n:
            break
        among = F.col("block").between(front.lo, front.hi)
        keys = boxes.where(among).select("block", *_BLOCK)
        few = broadcastable(front.n, KEY_BYTES)
        near = ground.where(among).select("block", *home, "col", "row", "cells")
        near = spread(stream_join(near, keys, ["block", *_BLOCK], "left_semi", few), _BLOCK, front.n)
        blocks = near.groupBy(*_BLOCK).agg(F.collect_list(F.struct("col", "row", "cells")).alias("tiles"))
        inbox = mail.groupBy(*_BLOCK).agg(F.flatten(F.collect_list("letters")).alias("mail"))
        work = stream_join(blocks, inbox, _BLOCK, "inner", broadcastable(front.letters, MAIL_BYTES))
        if rounds:
            light = broadcastable(front.n, 8 * (grid.tile_size << levels) ** 2)
            work = merge_join(work, history.last(keys.select(*_BLOCK), few), _BLOCK, "left", is_small=light)
        else:
            work = work.withColumn("cost", F.lit(None).cast("array<double>"))
        mail = history.append(work.mapInArrow(_relax(grid, levels, max_cost), _ROUND)).select(F.inline("mail"))
        rounds += 1
    if not rounds:
        return friction.with_tiles(friction.keyed.where(F.lit(False)))
    return friction.with_tiles(history.last().mapInArrow(_tiles_of_blocks(grid, levels), TILE_SCHEMA))
