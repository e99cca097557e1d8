"""Terrain and vector stand-ins derived from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgework import Grid, Layer
from ridgework.operators.tiling import cells_to_tiles

GRID = Grid(tile_size=16, xmin=0.0, ymax=0.0, res=1000.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def terrain_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``c, r, z`` on a grid 100 cells wide; NoData is NULL."""
    return table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey % 100 as int) c",
        "cast(floor(o_orderkey / 100.0) as int) r",
        "case when o_orderstatus = 'P' and o_orderkey % 7 = 0 then cast(null as double) "
        "else 20.0D * abs((o_orderkey % 40) - 20) + o_totalprice / 10000.0D end z",
    )


def terrain(spark: SparkSession, sf_dir: str, grid: Grid = GRID, zoom: int = 3) -> Layer:
    return cells_to_tiles(terrain_cells(spark, sf_dir), grid, zoom)


def friction(spark: SparkSession, sf_dir: str, grid: Grid = GRID, zoom: int = 3) -> Layer:
    cells = terrain_cells(spark, sf_dir).where("z is not null").selectExpr("c", "r", "1.0D + floor(z / 100.0D) z")
    return cells_to_tiles(cells, grid, zoom)


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers, placed on middles of cells over the whole height of the grid."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "*",
        "((s_suppkey * 37) % 100 + 0.5D) * 1000.0D x",
        "-(floor(s_suppkey * 3 / 2.0D) + 0.5D) * 1000.0D y",
    )


def supplier_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed triangle per supplier, as vertex rows in map units."""
    corners = "stack(4, 0, 0.0D, 0.0D, 1, 7000.0D, 1500.0D, 2, 2500.0D, 9000.0D, 3, 0.0D, 0.0D) as (seq, dx, dy)"
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey geom_id", "s_nationkey", "(s_suppkey * 37) % 100 * 1000.0D x0",
        "-(floor(s_suppkey * 3 / 2.0D) * 1000.0D) y0", corners,
    ).selectExpr(
        "geom_id", "0 part", "0 ring", "seq", "x0 + dx x",
        "y0 - dy - s_nationkey * 100.0D * (seq % 3) y",
    )
