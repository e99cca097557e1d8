"""The outline of a polygon as cells of a small grid, and as viewpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ridgework.operators.focal import standing_at
from ridgework.session import checked_broadcast
from ridgework.sources.vectors import polygon_edges

OUTLINE_CELLS = 512


def outline_cells(vertices: DataFrame, cells: int = OUTLINE_CELLS) -> DataFrame:
    """Cells ``geom_id, gc, gr`` touched by each outline on a ``cells`` x ``cells`` grid laid over
    its envelope, with the envelope ``x0, y1`` and cell sides ``sx, sy``.

    Each edge is walked in whole cell steps along its longer side. Cells are made distinct before
    anything else happens, so there are at most ``cells**2`` per polygon.
    """
    envelope = vertices.groupBy("geom_id").agg(
        F.min("x").alias("x0"), F.max("y").alias("y1"),
        ((F.max("x") - F.min("x")) / cells).alias("sx"), ((F.max("y") - F.min("y")) / cells).alias("sy"),
    )
    edges = polygon_edges(vertices).join(checked_broadcast(envelope, row_bytes=64), "geom_id")

    def place(offset: Column, side: Column) -> Column:
        at = F.when(side > 0, F.floor(offset / F.nullif(side, F.lit(0.0)))).otherwise(F.lit(0))
        return F.least(at, F.lit(cells - 1))

    ends = edges.select(
        "geom_id", "x0", "y1", "sx", "sy",
        place(F.col("ax") - F.col("x0"), F.col("sx")).alias("c0"),
        place(F.col("y1") - F.col("ay"), F.col("sy")).alias("r0"),
        place(F.col("bx") - F.col("x0"), F.col("sx")).alias("c1"),
        place(F.col("y1") - F.col("by"), F.col("sy")).alias("r1"),
    )
    n = F.greatest(F.abs(F.col("c1") - F.col("c0")), F.abs(F.col("r1") - F.col("r0")))

    def walk(start: str, stop: str) -> Column:
        step = F.floor((2 * F.col("k") * (F.col(stop) - F.col(start)) + F.col("n")) / (2.0 * F.greatest("n", F.lit(1))))
        return (F.col(start) + step).cast("int")

    return (
        ends.withColumn("n", n)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
        .select("geom_id", "x0", "y1", "sx", "sy", walk("c0", "c1").alias("gc"), walk("r0", "r1").alias("gr"))
        .distinct()
    )


def rasterize_boundary(vertices: DataFrame, altitude: float, cells: int = OUTLINE_CELLS) -> DataFrame:
    """Viewpoints at ``altitude`` on the middle of every outline cell, looking all round."""
    half = F.lit(0.5)
    x = F.col("x0") + (F.col("gc") + half) * F.col("sx")
    y = F.col("y1") - (F.col("gr") + half) * F.col("sy")
    return outline_cells(vertices, cells).select(
        F.xxhash64("geom_id", "gc", "gr").alias("vp_id"), x.alias("x"), y.alias("y"), *standing_at(altitude)
    )
