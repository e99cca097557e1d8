"""Which cells can be seen from a set of viewpoints.

Rays run from a viewpoint to every cell on the rim of the square of reach ``R`` around it (the R2
scheme of Franklin and Ray, 1994) and sample the nearest cell at each of ``R`` steps. A step is
seen when its gradient is no lower than that of every step before it. That running maximum splits
at tile borders, so the work is two passes over the tiles in reach with one small exchange:

1. each tile reports, per ray crossing it, the highest gradient inside the tile;
2. the reports of some thousand rays of a viewpoint meet and give the highest gradient before each tile;
3. each tile, told what its rays met before, marks its seen cells.

Only reports are exchanged, about ``R / tile_size`` of them per ray, never single steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ridgework.functions.keys import index_in_tile, map_to_cell, tile_of
from ridgework.grid import EARTH_RADIUS, Grid
from ridgework.layer import Layer
from ridgework.operators.arrow_tiles import CELLS_AT_ONCE, column, list_array, members, numbers, slices, tile_block
from ridgework.operators.pruning import at_keys
from ridgework.session import broadcastable, checked_broadcast, fits, merge_join, spread, stage, stream_join

OPERATORS = ("OR", "AND", "DEBUG")
HEIGHT_MODES = ("above_ground", "absolute")

# A unit is one tile with some of the viewpoints that reach it. Its viewpoints are limited so
# that neither their number nor the number of their rays grows with the data.
UNIT_VIEWPOINTS = 256
UNIT_RAYS = 1 << 20
# Rays handled at once inside a kernel: more where tiles are small.
RAYS_AT_ONCE = 1024
STEPS_AT_ONCE = 1 << 16
# Rays of one viewpoint whose reports travel in one row and meet in one group.
REPORT_RAYS = 4096
# Rays' reports sorted at once, but for those of one group.
REPORTS_AT_ONCE = 1 << 18
# Partial results of one tile added up in one group.
FAN_IN = 64
VIEWPOINT_BYTES = 160

# The sides of a rim: whether steps advance along rows, which way, and how far past the corner the first ray is.
_SIDES = np.array([(1, -1, 0), (0, 1, 0), (1, 1, 1), (0, -1, 1)])

_TILE = ["col", "row"]
_SEEN_FROM = ("vp", "c", "r", "eye", "n", "angle", "fov", "altitude", "far", "reach")
_VIEW = ("view_height", "angle", "fov", "altitude", "far")


def _schema(unit: list[str], rest: str) -> str:
    return ", ".join([f"{name} bigint" for name in unit] + [rest])


def reach_in_cells(max_distance: float, grid: Grid) -> int:
    return int(math.floor(max_distance / grid.res))


def _locate(viewpoints: DataFrame, grid: Grid, of: list[str]) -> DataFrame:
    """Viewpoints by cell; equal ones become one row with their number ``n``."""
    c, r = map_to_cell("x", "y", grid)
    by = [*of, "c", "r", *_VIEW]
    located = viewpoints.select(*of, c.alias("c"), r.alias("r"), *_VIEW).groupBy(*by).agg(F.count("*").alias("n"))
    return located.withColumn("reach", F.floor(F.col("far") / F.lit(grid.res)).cast("int"))


def _near(terrain: Layer, keys: DataFrame, box, margin: int) -> DataFrame:
    """Tiles at ``keys``, which lie within ``margin`` cells of the box around all viewpoints; reaches the scan's folders."""
    ts = terrain.grid.tile_size
    around = ((box.west - margin) // ts, (box.north - margin) // ts, (box.east + margin) // ts, (box.south + margin) // ts)
    return at_keys(terrain, keys, around)


def _with_eye(located: DataFrame, terrain: Layer, box, height_mode: str, of: list[str]) -> DataFrame:
    """Adds ``eye``, the height rays start from, and a row number ``vp``.

    The ground is looked up once per cell, of which a tile holds a bounded number, and then joined
    to the viewpoints, however many stand on one cell.
    """
    grid = terrain.grid
    if height_mode == "absolute":
        placed = located.withColumn("eye", F.col("view_height"))
    else:
        small = broadcastable(box.rows, VIEWPOINT_BYTES)
        spots = located.select("c", "r").distinct().withColumns({"col": tile_of("c", grid), "row": tile_of("r", grid)})
        ground = stream_join(_near(terrain, spots, box, 0), spots, _TILE, "inner", small).select(
            "c", "r", F.element_at("cells", index_in_tile("c", "r", grid) + 1).alias("ground")
        ).where(F.col("ground").isNotNull())
        placed = located.join(F.broadcast(ground) if small else ground, ["c", "r"]).withColumn(
            "eye", F.col("view_height") + F.col("ground")
        )
    return placed.select(F.monotonically_increasing_id().alias("vp"), *of, *_SEEN_FROM[1:])


def _pairs(seers: DataFrame, grid: Grid) -> DataFrame:
    """One row per viewpoint and tile key within its reach."""
    ts = grid.tile_size

    def keys(at: str) -> Column:
        return F.explode(F.sequence(*[
            F.floor((F.col(at) + sign * F.col("reach")) / F.lit(float(ts))).cast("int") for sign in (-1, 1)
        ]))

    def gap(at: str, key: str) -> Column:
        low = F.col(key) * ts
        return F.greatest(low - F.col(at), F.col(at) - (low + (ts - 1)), F.lit(0)).cast("double")

    off = F.sqrt(gap("c", "col") * gap("c", "col") + gap("r", "row") * gap("r", "row"))
    return (
        seers.withColumn("col", keys("c")).withColumn("row", keys("r"))
        .where(off * F.lit(grid.res) <= F.col("far"))
    )


def _units(pairs: DataFrame, terrain: Layer, box, per_unit: int, of: list[str]) -> tuple[DataFrame, list[str], int]:
    """Tiles joined to the viewpoints reaching them, the key of these units, and the most per tile.

    A unit is a tile for one request. Viewpoints crowding one are dealt over several salts, and that
    tile alone is repeated once per salt, so a crowd becomes many tasks.
    """
    owner = [*of, *_TILE]
    crowd = stage(pairs.groupBy(*owner).count(), "crowd")
    busiest = crowd.agg(F.max("count").alias("most"), F.sum("count").alias("all"), F.count("*").alias("units")).first()
    most, total = busiest.most or 0, busiest["all"] or 0
    tiles = _near(terrain, crowd, box, box.margin)
    unit, salts = owner, max(math.ceil(most / per_unit), 1)
    small = salts == 1 and broadcastable(total, VIEWPOINT_BYTES)
    if salts > 1:
        unit = [*owner, "salt"]
        hot = crowd.where(F.col("count") > per_unit).select(*owner, F.ceil(F.col("count") / per_unit).cast("int").alias("salts"))
        pairs = pairs.join(checked_broadcast(hot, row_bytes=32), owner, "left").withColumn(
            "salt", F.pmod(F.xxhash64("vp"), F.coalesce("salts", F.lit(1))).cast("int")
        ).drop("salts")
    crews = pairs.groupBy(*unit).agg(F.collect_list(F.struct(*_SEEN_FROM)).alias("crew"))
    if small:
        return spread(stream_join(tiles, crews, _TILE, "inner", is_small=True), unit, busiest.units), unit, salts
    slots = crowd.select(*owner, F.explode(F.sequence(F.lit(0), F.ceil(F.col("count") / per_unit).cast("int") - 1)).alias("salt"))
    reached = stream_join(tiles, slots.select(*unit), _TILE, "inner", fits(crowd, VIEWPOINT_BYTES))
    return stream_join(spread(reached, unit), crews, unit, "inner", is_small=False), unit, salts


def _fans(seers: dict[str, np.ndarray], key: tuple[int, int], ts: int, reach: int):
    """Which rays of viewpoints of one ``reach`` cross a tile: the four sides of their rims as rows, viewpoint by viewpoint.

    Of each: its viewpoint, where the tile begins along the axis that advances by one cell per step and across
    it, the first and last step there, and the first ray (by its offset on the rim) and the number of rays.
    """
    who = np.repeat(np.arange(len(seers["c"])), len(_SIDES))
    along, sign, shift = (np.tile(values, len(seers["c"])) for values in _SIDES.T)
    first = shift - reach
    beside, below = key[0] * ts - seers["c"][who], key[1] * ts - seers["r"][who]
    lead, low = np.where(along, below, beside), np.where(along, beside, below)
    ends = np.sort([sign * lead, sign * (lead + ts - 1)], axis=0)
    nearest, farthest = np.maximum(ends[0], 1), np.minimum(ends[1], reach)
    k = nearest[:, None] + np.arange(ts)
    within = k <= farthest[:, None]
    # floor((2 k j + R) / 2R) >= m  exactly when  j >= ceil((2 R m - R) / 2k)
    least = np.where(within, -((reach - 2 * reach * low[:, None]) // (2 * k)), 4 * reach).min(axis=1)
    beyond = np.where(within, -((reach - 2 * reach * (low[:, None] + ts)) // (2 * k)), -4 * reach).max(axis=1)
    start, stop = np.maximum(least, first), np.minimum(beyond, first + 2 * reach)
    return who, lead, low, nearest, farthest, start, np.maximum(stop - start, 0)


def _crossings(seers: dict[str, np.ndarray], key: tuple[int, int], ts: int, reach: int):
    """Steps of viewpoints' rays that fall in a tile, in blocks of rays, which may be of several viewpoints.

    Yields ``(who, ray, dx, dy, k, d2, index, inside)``: per ray its viewpoint, number, rim offset and first step here;
    per step (first axis) and ray (second axis) the squared distance in cells, the cell and whether it lies in the tile.
    The four sides of the rim differ in which axis advances by one cell per step, and which way.
    """
    who, lead, low, nearest, farthest, start, count = _fans(seers, key, ts, reach)
    upto = np.cumsum(count)
    at_once = max(RAYS_AT_ONCE, STEPS_AT_ONCE // ts)
    for block in range(0, int(upto[-1]) if len(upto) else 0, at_once):
        place = np.arange(block, min(block + at_once, upto[-1]))
        fan = np.searchsorted(upto, place, side="right")
        j = start[fan] + place - (upto - count)[fan]
        side = fan % len(_SIDES)
        along, sign, shift = _SIDES[side].T
        k = nearest[fan] + np.arange(int((farthest - nearest)[fan].max()) + 1)[:, None]
        across = (2 * k * j + reach) // (2 * reach)
        ahead, over = sign * k - lead[fan], across - low[fan]
        inside = (k <= farthest[fan]) & (over >= 0) & (over < ts)
        index = np.where(inside, over * np.where(along, 1, ts) + ahead * np.where(along, ts, 1), 0)
        dx, dy = np.where(along, j, sign * reach), np.where(along, sign * reach, j)
        yield who[fan], side * 2 * reach + (j + reach - shift), dx, dy, k[0], k * k + across * across, index, inside


def _gradients(cells, seers, key, grid, curvature):
    """Per block of rays: ``who, ray, k, usable, index, gradient, target gradient``; seers are all of one reach."""
    ts, reach = grid.tile_size, int(seers["reach"][0])
    filtered = bool((seers["fov"] > -1.0).any())
    for who, ray, dx, dy, k, d2, index, inside in _crossings(seers, key, ts, reach):
        eye = seers["eye"][who]
        z = cells[index]
        d = np.sqrt(d2.astype(np.float64)) * grid.res
        usable = inside & (d <= seers["far"][who]) & ~np.isnan(z)
        if filtered:
            fov = seers["fov"][who]
            toward = dx * seers["cos"][who] - dy * seers["sin"][who]
            usable &= ~(fov > -1.0) | (toward / np.sqrt((dx * dx + dy * dy).astype(np.float64)) >= fov)
        drop = d * d / (2.0 * EARTH_RADIUS) if curvature else 0.0
        gradient = np.where(usable, (z - drop - eye) / d, -np.inf)
        # An object that does not rise above the ground is seen exactly where the ground is.
        target = gradient
        altitude = seers["altitude"][who]
        if (altitude > -np.inf).any():
            target = (np.fmax(z, altitude) - drop - eye) / d
        yield who, ray, k, usable, index, gradient, target


def _crews(crew: pa.Array, ts: int):
    """The viewpoints of a unit as arrays by name, in groups of one reach whose counts stay small beside the tile's batch."""
    seers = {name: numbers(crew.field(name)).astype(np.int64) for name in ("vp", "c", "r", "n", "reach")}
    # A missing number raises, as in any sum.
    given = {name: [float(value) for value in crew.field(name).to_pylist()] for name in ("eye", "fov", "altitude", "far")}
    angles = crew.field("angle").to_pylist()
    given |= {name: [of(angle) if fov > -1.0 else 0.0 for angle, fov in zip(angles, given["fov"])] for name, of in (("cos", math.cos), ("sin", math.sin))}
    seers |= {name: np.array(values) for name, values in given.items()}
    size = max(CELLS_AT_ONCE // (ts * ts), 1)
    for reach in np.unique(seers["reach"]):
        chosen = np.flatnonzero(seers["reach"] == reach)
        for first in range(0, len(chosen), size):
            yield {name: values[chosen[first:first + size]] for name, values in seers.items()}


def _tile_units(batch: pa.RecordBatch, ts: int):
    """Per row of a batch: its key, flat cells and groups of viewpoints."""
    blocks = tile_block(batch, ts)
    crews = column(batch, "crew")
    keys = zip(column(batch, "col").to_pylist(), column(batch, "row").to_pylist())
    for i, key in enumerate(keys):
        yield i, key, blocks[i].ravel(), _crews(crews[i].values, ts)


def _reports(unit: list[str], grid: Grid, curvature: bool):
    """Kernel of the first pass: highest gradient of each ray inside each tile."""
    def kernel(batches):
        for batch in slices(batches, grid.cells_per_tile):
            for i, key, cells, crews in _tile_units(batch, grid.tile_size):
                found = {"vp": [], "ray": [], "k": [], "top": []}
                for seers in crews:
                    for who, ray, k, usable, _, gradient, _ in _gradients(cells, seers, key, grid, curvature):
                        met = np.flatnonzero(usable.any(axis=0))
                        found["vp"].append(seers["vp"][who[met]])
                        found["ray"].append(ray[met])
                        found["k"].append(k[met] + usable.argmax(axis=0)[met])
                        found["top"].append(gradient.max(axis=0)[met])
                flat = {name: np.concatenate(parts) for name, parts in found.items() if parts}
                if not len(flat.get("vp", ())):
                    continue
                # Rays come viewpoint by viewpoint and in order.
                vp, part = flat["vp"], flat["ray"] // REPORT_RAYS
                first = np.flatnonzero(np.append(True, (np.diff(vp) != 0) | (np.diff(part) != 0)))
                keys = [pa.array(np.full(len(first), column(batch, n)[i].as_py(), dtype=np.int64)) for n in unit]
                lists = [_lists(first, flat["ray"]), _lists(first, flat["k"].astype(np.int32)), _lists(first, flat["top"])]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(vp[first]), pa.array(part[first]), *lists], [*unit, "vp", "part", "ray", "k", "top"])
    return kernel


def _lists(first: np.ndarray, values: np.ndarray) -> pa.Array:
    """``values`` as lists that begin at the places ``first``."""
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)).astype(np.int32)), pa.array(values))


def _few_reports(batches):
    """Cut incoming batches to about ``REPORTS_AT_ONCE`` reports."""
    for batch in batches:
        held = len(column(batch, "met").flatten().field("ray").flatten())
        step = max(batch.num_rows * REPORTS_AT_ONCE // max(held, 1), 1)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _before(unit: list[str]):
    """Kernel between the passes: of the reports of some rays, the highest gradient each met before each unit."""
    def kernel(batches):
        for batch in _few_reports(batches):
            owner, reports = members(column(batch, "met"))
            piece, ray = members(reports.field("ray"))
            ray, k, top = numbers(ray), numbers(reports.field("k").flatten()), numbers(reports.field("top").flatten())
            order = np.lexsort((k, ray, owner[piece]))
            piece, ray, top = piece[order], ray[order], top[order]
            new = np.append(True, (np.diff(owner[piece]) != 0) | (np.diff(ray) != 0))[: len(ray)]
            start = np.flatnonzero(new)
            place = np.arange(len(ray)) - np.repeat(start, np.diff(np.append(start, len(ray))))
            highest = np.full(len(ray), -np.inf)
            # One step per unit a ray crosses, for all rays together.
            by_place = np.argsort(place, kind="stable")
            for at in np.split(by_place, np.cumsum(np.bincount(place)))[1:-1]:
                highest[at] = np.maximum(highest[at - 1], top[at - 1])
            later = np.flatnonzero(~new)
            later = later[np.argsort(piece[later], kind="stable")]
            if not len(later):
                continue
            first = np.flatnonzero(np.append(True, np.diff(piece[later]) != 0))
            told = pa.array(piece[later][first])
            yield pa.RecordBatch.from_arrays(
                [reports.field(name).take(told) for name in unit]
                + [column(batch, "vp").take(pa.array(owner[piece[later][first]])), _lists(first, ray[later]), _lists(first, highest[later])],
                [*unit, "vp", "ray", "top"],
            )
    return kernel


def _earlier(told: pa.Array | None, seers: dict[str, np.ndarray]) -> np.ndarray:
    """Per viewpoint (a row each), the highest gradient each of its rays met before this tile."""
    earlier = np.full((len(seers["vp"]), 8 * int(seers["reach"][0])), -np.inf)
    if told is not None:
        row, ray = members(told.field("ray"))
        vp, ray, top = numbers(told.field("vp"))[row], numbers(ray), numbers(told.field("top").flatten())
        order = np.argsort(seers["vp"])
        at = order[np.minimum(np.searchsorted(seers["vp"], vp, sorter=order), len(order) - 1)]
        own = seers["vp"][at] == vp
        earlier[at[own], ray[own]] = top[own]
    return earlier


def _sightings(unit: list[str], grid: Grid, curvature: bool):
    """Kernel of the second pass: how many viewpoints see each cell; NULL where none reaches it."""
    ts = grid.tile_size

    def kernel(batches):
        for batch in slices(batches, grid.cells_per_tile):
            told = column(batch, "told")
            counts, kept = [], []
            for i, key, cells, crews in _tile_units(batch, ts):
                total, reached = np.zeros(ts * ts), np.zeros(ts * ts, dtype=bool)
                for seers in crews:
                    seen = np.zeros((len(seers["vp"]), ts * ts), dtype=bool)
                    earlier = _earlier(told[i].values if told[i].is_valid else None, seers)
                    for who, ray, _, usable, index, gradient, target in _gradients(cells, seers, key, grid, curvature):
                        highest = np.maximum.accumulate(np.vstack([earlier[who, ray], gradient]), axis=0)[:-1]
                        sees = usable & (target >= highest)
                        seen[np.broadcast_to(who, sees.shape)[sees], index[sees]] = True
                        reached[index[usable]] = True
                    c, r = seers["c"] - key[0] * ts, seers["r"] - key[1] * ts
                    here = np.flatnonzero((c >= 0) & (c < ts) & (r >= 0) & (r < ts))
                    own = r[here] * ts + c[here]
                    here, own = here[~np.isnan(cells[own])], own[~np.isnan(cells[own])]
                    seen[here, own] = reached[own] = True
                    total += seers["n"].astype(np.float64) @ seen
                if reached.any():
                    kept.append(i)
                    counts.append(np.where(reached, total, np.nan))
            if kept:
                rows = pa.array(kept)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, n).take(rows).cast(pa.int64()) for n in unit] + [list_array(np.stack(counts))],
                    [*unit, "cells"],
                )
    return kernel


def _merge_salts(counts: DataFrame, salts: int, unit: list[str]) -> DataFrame:
    """Add the units of each tile, at most ``FAN_IN`` per group and level."""

    def add(table: pa.Table) -> pa.Table:
        """Cell-wise sum of the rows of one group; NULL only where all are NULL."""
        parts = numbers(table.column("cells").combine_chunks().flatten()).reshape(table.num_rows, -1)
        sums = np.where(np.isnan(parts).all(axis=0), np.nan, np.nansum(parts, axis=0))
        first = table.slice(0, 1)
        return pa.table([first.column(n) for n in unit] + [list_array(sums[None, :])], names=[*unit, "cells"])

    while salts > 1:
        salts = math.ceil(salts / FAN_IN)
        step = F.floor(F.col("salt") / F.lit(float(FAN_IN))).cast("bigint")
        counts = counts.withColumn("salt", step).groupBy(*unit).applyInArrow(add, _schema(unit, "cells array<double>"))
    return counts


def _seen(terrain: Layer, viewpoints: DataFrame, curvature: bool, operator: str, height_mode: str, of: list[str]) -> DataFrame | None:
    """Rows ``*of, col, row, cells`` from viewpoints that carry ``far`` and the columns ``of``; None without any."""
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}; known: {', '.join(OPERATORS)}")
    if height_mode not in HEIGHT_MODES:
        raise ValueError(f"unknown height mode {height_mode!r}; known: {', '.join(HEIGHT_MODES)}")
    grid = terrain.grid
    located = stage(_locate(viewpoints, grid, of), "viewpoints")
    box = located.agg(
        F.min("c").alias("west"), F.max("c").alias("east"), F.min("r").alias("north"),
        F.max("r").alias("south"), F.count("*").alias("rows"), F.max("reach").alias("margin"), F.min("reach").alias("least"),
    ).first()
    if not box.rows:
        return None
    if box.least < 1:
        raise ValueError("max_distance is below one cell")
    seers = stage(_with_eye(located, terrain, box, height_mode, of), "seers")

    per_unit = min(max(UNIT_RAYS // (8 * box.margin), 1), UNIT_VIEWPOINTS)
    units, unit, salts = _units(_pairs(seers, grid), terrain, box, per_unit, of)

    reports = units.mapInArrow(
        _reports(unit, grid, curvature), _schema(unit, "vp bigint, part bigint, ray array<bigint>, k array<int>, top array<double>"))
    met = reports.groupBy("vp", "part").agg(F.collect_list(F.struct(*unit, "ray", "k", "top")).alias("met"))
    told = (
        met.mapInArrow(_before(unit), _schema(unit, "vp bigint, ray array<bigint>, top array<double>"))
        .groupBy(*unit)
        .agg(F.collect_list(F.struct("vp", "ray", "top")).alias("told"))
    )
    informed = merge_join(units, told, unit, "left", is_small=False)
    marked = informed.mapInArrow(_sightings(unit, grid, curvature), _schema(unit, "cells array<double>"))
    counts = _merge_salts(marked, salts, unit)

    if operator == "DEBUG":
        value = F.col("cells")
    elif operator == "OR":
        value = F.transform("cells", lambda n: F.when(n.isNotNull(), (n > 0).cast("double")))
    else:
        everyone = seers.groupBy(*of).agg(F.sum("n").cast("double").alias("everyone"))
        counts = counts.join(checked_broadcast(everyone, 32), of) if of else counts.crossJoin(F.broadcast(everyone))
        value = F.transform("cells", lambda n: F.when(n.isNotNull(), (n >= F.col("everyone")).cast("double")))
    return counts.select(*of, F.col("col").cast("int"), F.col("row").cast("int"), value.alias("cells"))


def viewshed(
    terrain: Layer,
    viewpoints: DataFrame,
    max_distance: float,
    curvature: bool = True,
    operator: str = "OR",
    height_mode: str = "above_ground",
) -> Layer:
    """Cells in reach of ``viewpoints`` (``x, y, view_height, angle, fov, altitude``).

    ``OR`` gives 1 where any viewpoint sees the cell and ``AND`` where all do, else 0; ``DEBUG``
    gives the number that do. Cells no viewpoint reaches, and NoData cells, are NULL; tiles without
    any reached cell have no row. ``view_height`` counts from the ground, or is the height itself
    with ``height_mode='absolute'``; a viewpoint off the layer or above NoData ground has
    no height in the first case and is ignored, also when ``AND`` counts who is to see a cell.
    ``altitude`` is the height an object in each cell rises to, minus infinity meaning the ground.
    ``fov`` keeps directions whose cosine to ``angle`` (radians, counter-clockwise from east) is at
    least that much; -1 looks all round.
    """
    if reach_in_cells(max_distance, terrain.grid) < 1:
        raise ValueError("max_distance is below one cell")
    far = viewpoints.withColumn("far", F.lit(float(max_distance)))
    found = _seen(terrain, far, curvature, operator, height_mode, [])
    return terrain.with_tiles(terrain.keyed.where(F.lit(False)) if found is None else found)


def viewsheds(
    terrain: Layer,
    viewpoints: DataFrame,
    curvature: bool = True,
    operator: str = "OR",
    height_mode: str = "above_ground",
) -> DataFrame:
    """The viewsheds of many requests by one job: rows ``request, col, row, cells``.

    Viewpoints are as for ``viewshed`` and carry ``request`` (bigint) and ``far``, the request's greatest
    distance. A request is part of the key of every tile, ray and unit, so requests share scans and
    shuffles but no cell; tiles are read once for all requests that reach them.
    """
    found = _seen(terrain, viewpoints, curvature, operator, height_mode, ["request"])
    if found is None:
        return terrain.keyed.where(F.lit(False)).select(F.lit(0).cast("bigint").alias("request"), "*")
    return found


def touched_keys(seen: Layer) -> DataFrame:
    """Keys of the tiles a viewshed reached: those it has a row for, so no cells are read."""
    return seen.tiles.select("col", "row")


def count_points(viewpoints: DataFrame) -> DataFrame:
    return viewpoints.agg(F.count("*").alias("points"))
