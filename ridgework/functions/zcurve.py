"""Intervals of the Z curve: what a box of tile keys covers, and sets of keys as runs of the curve."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ridgework.functions.keys import KEY_BITS, zorder_key, zorder_of

# Intervals a filter lists at most; a box that needs more is covered more coarsely.
MOST_INTERVALS = 64
# Runs end at multiples of 4**RUN_BITS keys, so that sets are handled piece by piece whatever their size.
RUN_BITS = 8


def _wrapped(low: int, high: int) -> list[tuple[int, int]]:
    """A range of signed coordinates as ranges of the unsigned ones that the curve interleaves."""
    size = 1 << KEY_BITS
    if high - low >= size:
        return [(0, size - 1)]
    low, high = low % size, high % size
    return [(low, high)] if low <= high else [(low, size - 1), (0, high)]


def box_intervals(west: int, north: int, east: int, south: int, bits: int, most: int = MOST_INTERVALS) -> list[tuple[int, int]]:
    """Intervals of ``zkey >> bits`` that hold all keys of a box (inclusive), at most ``most`` of them.

    Quadrants of the key space are cut in four while they lie partly in the box; an even ``bits`` stops the
    cutting at the blocks that it leaves.
    """
    if west > east or north > south:
        return []
    boxes = [(w, n, e, s) for w, e in _wrapped(west, east) for n, s in _wrapped(north, south)]
    floor = bits // 2

    def meets(x: int, y: int, side: int) -> bool:
        return any(x <= e and x + side > w and y <= s and y + side > n for w, n, e, s in boxes)

    def inside(x: int, y: int, side: int) -> bool:
        return any(w <= x and x + side - 1 <= e and n <= y and y + side - 1 <= s for w, n, e, s in boxes)

    def intervals(quadrants: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        merged: list[list[int]] = []
        for low, count in sorted((zorder_of(x, y) >> bits, max(1, 1 << max(2 * level - bits, 0))) for level, x, y in quadrants):
            if merged and low <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], low + count - 1)
            else:
                merged.append([low, low + count - 1])
        return [(low, high) for low, high in merged]

    quadrants = [(KEY_BITS, 0, 0)]
    while True:
        finer = []
        for level, x, y in quadrants:
            if level <= floor or inside(x, y, 1 << level):
                finer.append((level, x, y))
                continue
            half = 1 << (level - 1)
            finer += [(level - 1, i, j) for i in (x, x + half) for j in (y, y + half) if meets(i, j, half)]
        if finer == quadrants or len(intervals(finer)) > most:
            return intervals(quadrants)
        quadrants = finer


def in_intervals(value: Column | str, intervals: list[tuple[int, int]]) -> Column:
    """Whether a value lies in one of the intervals; becomes a scan or partition filter."""
    value = F.col(value) if isinstance(value, str) else value
    return reduce(lambda a, b: a | b, [value.between(low, high) for low, high in intervals], F.lit(False))


def key_of_zorder(zkey: Column | str) -> tuple[Column, Column]:
    """The tile key at a position of the Z curve; the upper half of each coordinate is negative."""
    zkey = F.col(zkey) if isinstance(zkey, str) else zkey

    def gathered(first: int) -> Column:
        bits = [F.shiftleft(F.shiftright(zkey, 2 * b + first).bitwiseAND(F.lit(1)), b) for b in range(KEY_BITS)]
        value = reduce(lambda a, b: a.bitwiseOR(b), bits)
        return F.when(value >= 1 << (KEY_BITS - 1), value - (1 << KEY_BITS)).otherwise(value).cast("int")

    return gathered(0), gathered(1)


def _joined(runs: DataFrame, of: list[str] = []) -> DataFrame:
    """Runs ``lo, hi`` with those that touch or overlap made one, within pieces of the curve."""
    along = Window.partitionBy(*of, "piece").orderBy("lo", "hi")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("lo") > F.max("hi").over(before) + 1, F.lit(True)).cast("int")
    return (
        runs.withColumn("piece", F.shiftright("lo", 2 * RUN_BITS))
        .withColumn("fresh", fresh)
        .withColumn("nth", F.sum("fresh").over(along))
        .groupBy(*of, "piece", "nth")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .select(*of, "lo", "hi")
    )


def runs_of_keys(keys: DataFrame, of: list[str] = []) -> DataFrame:
    """The set of tile keys ``col, row`` as runs ``lo, hi`` of consecutive Z-curve positions, apart for each value of ``of``."""
    places = keys.select(*of, zorder_key("col", "row").alias("lo")).distinct()
    return _joined(places.withColumn("hi", F.col("lo")), of)


def keys_of_runs(runs: DataFrame) -> DataFrame:
    """The tile keys ``col, row`` that runs stand for."""
    col, row = key_of_zorder("zkey")
    return runs.select(F.explode(F.sequence("lo", "hi")).alias("zkey")).select(col.alias("col"), row.alias("row"))


def shift_runs(runs: DataFrame, levels: int) -> DataFrame:
    """Runs of the keys ``levels`` zooms up the pyramid: both ends lose two bits a level and keep their signs."""
    signs = sum(1 << 2 * (KEY_BITS - 1 - level) for level in range(levels))

    def up(end: str) -> Column:
        sign = F.shiftright(end, 2 * (KEY_BITS - 1)).bitwiseAND(F.lit(3))
        return F.shiftright(end, 2 * levels).bitwiseOR(sign * F.lit(signs).cast("bigint"))

    return _joined(runs.select(up("lo").alias("lo"), up("hi").alias("hi")).distinct())


def intersect_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Runs of the keys in both sets; runs lie within one piece of the curve, so pieces are joined."""
    piece = F.shiftright("lo", 2 * RUN_BITS)
    one = a.select(piece.alias("piece"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    two = b.select(piece.alias("piece"), F.col("lo").alias("c"), F.col("hi").alias("d"))
    met = one.join(two, "piece").select(F.greatest("a", "c").alias("lo"), F.least("b", "d").alias("hi"))
    return _joined(met.where("lo <= hi"))


def coarse_intervals(runs: DataFrame, most: int = MOST_INTERVALS) -> list[tuple[int, int]]:
    """At most ``most`` intervals of Z-curve positions that hold all runs.

    The curve between the ends is cut into equal pieces, each of which reports the ends of what it holds;
    only that bounded report reaches the driver.
    """
    ends = runs.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if ends.lo is None:
        return []
    width = (ends.hi - ends.lo) // most + 1
    part = lambda end: f"({end} - {ends.lo}L) div {width}L"  # noqa: E731  whole numbers, as positions exceed a double's digits
    spread = runs.select("lo", "hi", F.expr(f"explode(sequence({part('lo')}, {part('hi')})) as part"))
    start = F.col("part") * width + ends.lo
    found = spread.groupBy("part").agg(
        F.min(F.greatest("lo", start)).alias("lo"), F.max(F.least("hi", start + (width - 1))).alias("hi")
    ).orderBy("part").collect()
    out: list[tuple[int, int]] = []
    for part in found:
        if out and part.lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], part.hi)
        else:
            out.append((part.lo, part.hi))
    return out
