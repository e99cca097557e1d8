"""Column arithmetic on tile keys, cells and map positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ridgework.grid import Grid

KEY_BITS = 31


def _int(value: Column) -> Column:
    return value.cast("int")


def zorder_key(col: Column | str, row: Column | str, bits: int = KEY_BITS) -> Column:
    """Position of a non-negative tile key on the Z curve; column bits take the even places."""
    col, row = (F.col(v).cast("bigint") if isinstance(v, str) else v.cast("bigint") for v in (col, row))
    terms = []
    for bit in range(bits):
        mask = F.lit(1 << bit)
        terms.append(F.shiftleft(col.bitwiseAND(mask), bit))
        terms.append(F.shiftleft(row.bitwiseAND(mask), bit + 1))
    return reduce(lambda a, b: a.bitwiseOR(b), terms)


def zorder_of(col: int, row: int) -> int:
    """``zorder_key`` of a single known key."""
    return sum(((col >> bit & 1) | (row >> bit & 1) << 1) << 2 * bit for bit in range(KEY_BITS))


def key_shift(key: Column | str, levels: int) -> Column:
    """One coordinate of the tile key ``levels`` zooms up the pyramid."""
    return F.shiftright(key, levels)


def tile_of(cell: Column | str, grid: Grid) -> Column:
    """Tile coordinate holding a cell coordinate (also right for negative cells)."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    return _int(F.floor(cell / F.lit(float(grid.tile_size))))


def index_in_tile(c: Column | str, r: Column | str, grid: Grid) -> Column:
    """Row-major position of cell ``(c, r)`` inside its tile, from 0."""
    ts = F.lit(grid.tile_size)
    return _int(F.pmod(r, ts) * ts + F.pmod(c, ts))


def cell_center(c: Column | str, r: Column | str, grid: Grid) -> tuple[Column, Column]:
    """Map position of the middle of a cell."""
    c, r = (F.col(v) if isinstance(v, str) else v for v in (c, r))
    half = F.lit(0.5)
    return (
        F.lit(grid.xmin) + (c + half) * F.lit(grid.res),
        F.lit(grid.ymax) - (r + half) * F.lit(grid.res),
    )


def map_to_cell(x: Column | str, y: Column | str, grid: Grid) -> tuple[Column, Column]:
    """Cell that holds a map position."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    return (
        _int(F.floor((x - F.lit(grid.xmin)) / F.lit(grid.res))),
        _int(F.floor((F.lit(grid.ymax) - y) / F.lit(grid.res))),
    )


def key_extent(col: Column | str, row: Column | str, grid: Grid) -> dict[str, Column]:
    """Map extent of a tile as ``xmin, ymin, xmax, ymax`` columns."""
    col, row = (F.col(v) if isinstance(v, str) else v for v in (col, row))
    side = F.lit(grid.tile_size * grid.res)
    return {
        "xmin": F.lit(grid.xmin) + col * side,
        "ymin": F.lit(grid.ymax) - (row + F.lit(1)) * side,
        "xmax": F.lit(grid.xmin) + (col + F.lit(1)) * side,
        "ymax": F.lit(grid.ymax) - row * side,
    }
