"""A mergeable sketch of cell values: groups of neighbouring values, each with its count, mean and ends.

Squeezing a sketch to ``SKETCH`` groups joins neighbours until each has about an equal share of the weight, so the count
of values up to any point is known but for the groups that reach over it. Every squeeze adds one share, ``1 /
SKETCH`` of the cells, to what is unsure, and a value passes one squeeze per doubling of a task's data and one per
``FAN_IN`` tasks: for 10**13 cells in 100,000 tasks about 20, half a percent. The ends make the bounds of
``brackets`` certain whatever the number of squeezes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridgework.layer import Layer
from ridgework.operators.arrow_tiles import column, numbers, slices
from ridgework.session import stage

SKETCH = 4096
FAN_IN = 16
# Cells gathered before a task squeezes them.
GATHERED = 1 << 21
# Groups in order: mean, count, least and greatest value, as the rows of an array.
MEAN, COUNT, LEAST, MOST = range(4)
_FIELDS = "array<double>"
_SCHEMA = f"slot bigint, mean {_FIELDS}, n {_FIELDS}, least {_FIELDS}, most {_FIELDS}, under bigint, over bigint"


def of_values(z: np.ndarray) -> np.ndarray:
    """The exact sketch of finite values: one group per distinct value."""
    values, counts = np.unique(z, return_counts=True)
    return np.stack([values, counts.astype(np.float64), values, values])


def squeezed(groups: np.ndarray, size: int) -> np.ndarray:
    """At most ``size`` groups, each with about an equal share of the count."""
    groups = groups[:, np.lexsort((groups[MOST], groups[MEAN]))]
    same = (groups[LEAST, 1:] == groups[LEAST, :-1]) & (groups[MOST, 1:] == groups[MOST, :-1]) & (groups[LEAST, 1:] == groups[MOST, 1:])
    first = np.flatnonzero(np.append(True, ~same)) if groups.shape[1] else np.zeros(0, np.int64)
    if len(first) > size:
        upto = np.cumsum(groups[COUNT])
        share = np.minimum(((upto - groups[COUNT] / 2) * size / upto[-1]).astype(np.int64), size - 1)
        first = first[np.diff(share[first], prepend=-1) > 0]
    elif len(first) == groups.shape[1]:
        return groups
    if not len(first):
        return groups
    count = np.add.reduceat(groups[COUNT], first)
    return np.stack([
        np.add.reduceat(groups[MEAN] * groups[COUNT], first) / count if len(first) < groups.shape[1] else groups[MEAN], count,
        np.minimum.reduceat(groups[LEAST], first), np.maximum.reduceat(groups[MOST], first),
    ])


class Growing:
    """The sketch of a task: equal numbers of squeezes are joined, like digits that carry."""

    def __init__(self, size: int):
        self.size, self.waiting, self.cells = size, [], 0
        self.levels: dict[int, np.ndarray] = {}
        self.under = self.over = 0

    def add(self, z: np.ndarray) -> None:
        self.under, self.over = self.under + int((z == -np.inf).sum()), self.over + int((z == np.inf).sum())
        self.waiting.append(z[np.isfinite(z)])
        self.cells += len(self.waiting[-1])
        if self.cells >= GATHERED:
            self._carry()

    def _carry(self) -> None:
        groups, level = squeezed(of_values(np.concatenate(self.waiting)), self.size), 0
        self.waiting, self.cells = [], 0
        while level in self.levels:
            groups, level = squeezed(np.concatenate([self.levels.pop(level), groups], axis=1), self.size), level + 1
        self.levels[level] = groups

    def whole(self) -> np.ndarray:
        if self.waiting:
            self._carry()
        parts = list(self.levels.values())
        return squeezed(np.concatenate(parts, axis=1), self.size) if parts else np.zeros((4, 0))


def _row(slot: int, groups: np.ndarray, under: int, over: int) -> dict:
    return {"slot": slot} | dict(zip(("mean", "n", "least", "most"), groups.tolist())) | {"under": under, "over": over}


def _groups(row) -> np.ndarray:
    return np.array([row["mean"], row["n"], row["least"], row["most"]]).reshape(4, -1)


def sketch_of(layer: Layer, size: int | None = None) -> tuple[np.ndarray, int, int]:
    """The sketch of a layer's finite cells, and how many cells are minus and plus infinity.

    Each task reduces its tiles to one sketch in Arrow batches; sketches are merged ``FAN_IN`` at a time. One
    sketch, of bounded size, reaches the driver.
    """
    size = size or SKETCH
    cells_per_tile = layer.grid.cells_per_tile
    schema = pa.schema([("slot", pa.int64()), *[(name, pa.list_(pa.float64())) for name in ("mean", "n", "least", "most")], ("under", pa.int64()), ("over", pa.int64())])

    def grow(batches):
        own = Growing(size)
        for batch in slices(batches, cells_per_tile):
            z = numbers(column(batch, "cells").flatten())
            own.add(z[~np.isnan(z)])
        yield pa.RecordBatch.from_pylist([_row(0, own.whole(), own.under, own.over)], schema=schema)

    # Without type hints: Spark takes a function's hints whole or not at all, and refuses them on some arguments alone.
    def merge(key, table):
        rows = table.to_pylist()
        groups = squeezed(np.concatenate([_groups(row) for row in rows], axis=1), size)
        return pa.Table.from_pylist([_row(key[0].as_py(), groups, sum(r["under"] for r in rows), sum(r["over"] for r in rows))], schema=schema)

    parts = stage(layer.tiles.select("cells").mapInArrow(grow, _SCHEMA).withColumn("slot", F.spark_partition_id().cast("bigint")), "sketches")
    last = parts.agg(F.max("slot")).first()[0]
    while last:
        last //= FAN_IN
        grouped = parts.select(F.floor(F.col("slot") / FAN_IN).cast("bigint").alias("group"), "*").groupBy("group")
        parts = stage(grouped.applyInArrow(merge, _SCHEMA), "sketches")
    row = parts.first()
    return (np.zeros((4, 0)), 0, 0) if row is None else (_groups(row), row["under"], row["over"])


def brackets(groups: np.ndarray, ranks: list[int]) -> list[tuple[float, float]]:
    """Per rank (from 1) two values between which the value of that rank lies, ends included, for certain."""
    by_least, by_most = np.argsort(groups[LEAST], kind="stable"), np.argsort(groups[MOST], kind="stable")
    begun, ended = np.cumsum(groups[COUNT][by_least]), np.cumsum(groups[COUNT][by_most])
    # At most `begun` cells are below the end of a group's start; at least `ended` are up to a group's end.
    low = groups[LEAST][by_least][np.searchsorted(begun, ranks)]
    high = groups[MOST][by_most][np.searchsorted(ended, ranks)]
    return list(zip(low.tolist(), high.tolist()))
