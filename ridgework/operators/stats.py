"""Distributions of cell values and the breaks drawn from them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ridgework.functions.values import class_index, is_data
from ridgework.layer import Layer
from ridgework.operators.arrow_tiles import numbers, slices
from ridgework.operators.sketch import COUNT, brackets, sketch_of, squeezed
from ridgework.session import stage

BINS = 80
CLASSES = 256
# Pieces an interval around an exact break is cut into per pass.
PIECES = 1024


def histogram(layer: Layer, bins: int = BINS) -> DataFrame:
    """One row ``bins array<struct<x, y>>``: at most ``bins`` groups of neighbouring cells by mean and count.

    Groups hold about equal shares; counts add up to the number of cells, and fewer distinct values than
    ``bins`` are counted exactly. Infinities stand at the ends, in groups of their own.
    """
    groups, under, over = sketch_of(layer)
    groups = squeezed(groups, max(bins - (under > 0) - (over > 0), 1))
    pairs = [(float("-inf"), float(under))] * (under > 0) + list(zip(*groups[:2].tolist())) + [(float("inf"), float(over))] * (over > 0)
    return layer.tiles.sparkSession.createDataFrame([(pairs,)], "bins array<struct<x: double, y: double>>")


def fixed_width_histogram(layer: Layer, width: float) -> DataFrame:
    """Exact counts ``bin, n`` of cells with ``floor(z / width) = bin``, counted per batch of tiles before anything is shuffled."""
    cells = layer.grid.cells_per_tile

    def count(batches):
        for batch in slices(batches, cells):
            z = numbers(batch.column(0).flatten())
            bins, counts = np.unique(np.floor(z[~np.isnan(z)] / float(width)).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(counts)], ["bin", "n"])

    return layer.tiles.select("cells").mapInArrow(count, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))


def quantile_breaks(layer: Layer, n: int = CLASSES) -> DataFrame:
    """One row ``breaks array<double>``: ``n`` values that cut the cells into equal counts, from one scan.

    Break ``i`` is no less than the value of rank ``ceil(i / n * count)`` and above it by what the sketch
    is unsure of at most (see ``sketch``); the last is the greatest cell.
    """
    groups, under, over = sketch_of(layer)
    total = int(groups[COUNT].sum()) + under + over
    ranks = [-(-i * total // n) for i in range(1, n + 1)] if total else []
    finite = [rank - under for rank in ranks if under < rank <= total - over]
    upper = [high for _, high in brackets(groups, finite)] if finite else []
    breaks = [float("-inf")] * sum(rank <= under for rank in ranks) + upper + [float("inf")] * sum(rank > total - over for rank in ranks)
    return layer.tiles.sparkSession.createDataFrame([(breaks,)], "breaks array<double>")


def exact_breaks(layer: Layer, n: int = CLASSES) -> tuple[float, ...]:
    """``n`` breaks where break ``i`` is exactly the value of rank ``ceil(i / n * count)``, from two scans of the cells.

    The first scan makes a sketch, whose ends bracket every break for certain. The second counts the cells below each
    bracket and, per value, those inside, which is all that is stored. There an interval
    around each break is narrowed: every pass cuts the open intervals into ``PIECES`` equal pieces and keeps the piece
    each break lies in; a piece holding one distinct value settles its breaks. A pass groups at most
    ``n * PIECES`` pieces, whatever the number of cells or how often a value repeats.
    """
    groups, under, over = sketch_of(layer)
    total = int(groups[COUNT].sum()) + under + over
    if not total:
        return ()
    ranks = [-(-i * total // n) for i in range(1, n + 1)]
    # Infinities stand at the ends; the search between is over finite values.
    settled = {rank: float("-inf") for rank in ranks if rank <= under}
    settled |= {rank: float("inf") for rank in ranks if rank > total - over}
    wanted = sorted(set(ranks) - set(settled))
    bracketed = dict(zip(wanted, brackets(groups, [rank - under for rank in wanted]))) if wanted else {}
    settled |= {rank: low for rank, (low, high) in bracketed.items() if low == high}
    wanted = [rank for rank in wanted if rank not in settled]
    if wanted:
        values, todo = _inside(layer, [bracketed[rank] for rank in wanted], wanted, under)
        while todo:
            for (low, high, _), inside in todo.items():
                settled.update({rank: low for rank in inside if low == high})
            todo = {key: inside for key, inside in todo.items() if key[0] < key[1]}
            if todo:
                todo = _narrow(values, todo)
    return tuple(settled[rank] for rank in ranks)


def _inside(layer: Layer, spans: list[tuple[float, float]], ranks: list[int], under: int) -> tuple[DataFrame, dict]:
    """The second scan: values ``z, n`` inside the brackets, stored, and the ranks to seek in each of their united spans."""
    united: list[list[float]] = []
    for low, high in sorted(spans):
        if united and low <= united[-1][1]:
            united[-1][1] = max(united[-1][1], high)
        else:
            united.append([low, high])
    lows, highs = np.array(united).T
    cells = layer.grid.cells_per_tile

    def count(batches):
        """Per span what is inside, value by value, and as ``z`` NULL what lies between it and the span before."""
        for batch in slices(batches, cells):
            z = numbers(batch.column(0).flatten())
            z, n = np.unique(z[np.isfinite(z)], return_counts=True)
            at = np.searchsorted(highs, z)
            within = (at < len(lows)) & (z >= lows[np.minimum(at, len(lows) - 1)])
            before = np.bincount(at[~within], weights=n[~within], minlength=len(lows) + 1)[: len(lows)].astype(np.int64)
            slots = np.flatnonzero(before)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([at[within], slots]).astype(np.int32)),
                pa.array(np.concatenate([z[within], np.full(len(slots), np.nan)]), from_pandas=True),
                pa.array(np.concatenate([n[within], before[slots]]).astype(np.int64)),
            ], ["at", "z", "n"])

    counted = layer.tiles.select("cells").mapInArrow(count, "at int, z double, n bigint").groupBy("at", "z").agg(F.sum("n").alias("n"))
    values = stage(counted, "values-inside")
    sums = {row["at"]: row for row in values.groupBy("at").agg(
        F.sum(F.when(F.col("z").isNull(), F.col("n")).otherwise(0)).alias("before"), F.sum(F.when(F.col("z").isNotNull(), F.col("n")).otherwise(0)).alias("held"),
        F.min("z").alias("low"), F.max("z").alias("high"),
    ).collect()}
    todo, below = {}, under
    for at in range(len(lows)):
        row = sums.get(at)
        if row is None:
            continue
        below += row["before"]
        inside = [rank for rank in ranks if below < rank <= below + row["held"]]
        if inside:
            todo[(row["low"], row["high"], below)] = inside
        below += row["held"]
    return values.where("z is not null").select("z", "n"), todo


def _narrow(values: DataFrame, todo: dict) -> dict:
    """One pass over values with their counts: the piece of its interval that holds each rank."""
    spans = sorted(todo)
    lows, highs = (np.array([span[i] for span in spans]) for i in range(2))

    def count_pieces(batches):
        for batch in batches:
            z, n = (numbers(batch.column(i)) for i in range(2))
            at = np.minimum(np.searchsorted(highs, z), len(highs) - 1)
            inside = (z >= lows[at]) & (z <= highs[at])
            z, n, at = z[inside], n[inside], at[inside]
            piece = np.floor((z - lows[at]) / (highs[at] - lows[at]) * PIECES).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a) for a in (at.astype(np.int32), piece, n, z)], ["at", "piece", "n", "z"])

    below = F.array(*[F.lit(span[2]) for span in spans])
    ranks = F.array(*[F.array(*[F.lit(rank) for rank in todo[span]]) for span in spans])
    upto = Window.partitionBy("at").orderBy("piece")
    pieces = (
        values.mapInArrow(count_pieces, "at int, piece bigint, n bigint, z double")
        .groupBy("at", "piece")
        .agg(F.sum("n").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))
        .withColumn("last", F.sum("n").over(upto) + F.get(below, F.col("at")))
        .withColumn("ranks", F.filter(
            F.get(ranks, F.col("at")), lambda rank: (rank > F.col("last") - F.col("n")) & (rank <= F.col("last"))
        ))
        .where(F.size("ranks") > 0)
    )
    return {(row.low, row.high, row["last"] - row.n): list(row.ranks) for row in pieces.collect()}


def breaks_from_bins(bins: Column | str, n: int = CLASSES) -> Column:
    """``n`` equal-count breaks of a stored histogram (``array<struct<x, y>>`` ordered by x).

    Break ``i`` is the first bin at which the running count reaches ``i / n`` of the total.
    """
    bins = F.col(bins) if isinstance(bins, str) else bins
    start = F.struct(F.lit(0.0).alias("upto"), F.array().cast("array<struct<x: double, upto: double>>").alias("seen"))

    def add(state: Column, one: Column) -> Column:
        upto = state["upto"] + one["y"]
        return F.struct(upto.alias("upto"), F.concat(
            state["seen"], F.array(F.struct(one["x"].alias("x"), upto.alias("upto")))
        ).alias("seen"))

    def breaks(state: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.get(F.filter(
            state["seen"], lambda s: s["upto"] * F.lit(float(n)) >= i * state["upto"]
        ), 0)["x"])

    return F.aggregate(bins, start, add, breaks)


@dataclass(frozen=True)
class Classes:
    """Class breaks: either listed, or the whole numbers ``0 .. upto``."""

    breaks: tuple[float, ...] = ()
    upto: int | None = None

    @property
    def count(self) -> int:
        return self.upto + 1 if self.upto is not None else len(self.breaks)

    def index(self, z: Column | str) -> Column:
        """Class of a value: the first break not below it, or the last class."""
        if self.upto is None:
            return class_index(z, self.breaks)
        z = F.col(z) if isinstance(z, str) else z
        return F.when(is_data(z), F.least(F.greatest(F.ceil(z), F.lit(0)), F.lit(self.upto)).cast("int"))

    def index_array(self, z: np.ndarray) -> np.ndarray:
        """The same for an array of data values inside a task."""
        if self.upto is not None:
            return np.clip(np.ceil(z), 0, self.upto)
        return np.searchsorted(np.array(self.breaks[:-1]), z)


def class_table(catalog, n: int = CLASSES) -> DataFrame:
    """``layer, breaks, upto`` of every layer with attributes: breaks of its stored histogram, else its count of viewpoints."""
    wanted = (F.col("zoom") == 0) & F.col("name").isin("histogram", "points")
    bins = F.from_json("value", "array<struct<x: double, y: double>>")
    return catalog.attributes().where(wanted).groupBy("layer").agg(
        F.max(F.when(F.col("name") == "histogram", breaks_from_bins(bins, n))).alias("breaks"),
        F.max(F.when(F.col("name") == "points", F.col("value").cast("int"))).alias("upto"),
    ).withColumn("upto", F.when(F.coalesce(F.size("breaks"), F.lit(0)) <= 0, F.col("upto")))


def classes_of(breaks, upto) -> Classes:
    """The classes that stored facts give: breaks, else whole numbers up to a count, else 0 and 1."""
    if breaks:
        return Classes(breaks=tuple(breaks))
    return Classes(breaks=(0.0, 1.0)) if upto is None else Classes(upto=upto)


def layer_classes(catalog, name: str, n: int = CLASSES) -> Classes:
    """Classes of a stored pyramid: from its histogram, else its viewpoint count, else 0 and 1."""
    stored = class_table(catalog, n).where(F.col("layer") == name).first()
    return classes_of(None, None) if stored is None else classes_of(stored.breaks, stored.upto)


def store_histogram(catalog, layer: Layer, name: str, zoom: int = 0, bins: int = BINS) -> None:
    """Save the histogram of a layer as an attribute of a possibly different ``(name, zoom)``."""
    catalog.write_attributes(histogram(layer, bins).select(
        F.lit(name).alias("layer"), F.lit(zoom).alias("zoom"), F.lit("histogram").alias("name"),
        F.to_json("bins").alias("value"),
    ))
