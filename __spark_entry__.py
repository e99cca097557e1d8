"""Registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

import terrain_oracle
from ridgework import Layer
from ridgework.functions.geo import to_web_mercator as mercator
from ridgework.functions.keys import cell_center as center, key_shift as shift, map_to_cell as to_cell, zorder_key as zkey
from ridgework.functions import zcurve
from ridgework.functions.values import class_index as classify, is_data as has_data, is_positive, or_default as optional
from ridgework.operators import (
    travel_cost as cost_ops, focal, masking, outline, pyramid as levels, render, stats, tiling, viewshed as sight,
)
from ridgework.operators.tiling import tiles_to_cells
from ridgework.plans import workflows
from ridgework.session import scratch_dir
from ridgework.sources import vectors
from ridgework.sources.catalog import Catalog, done_layers, tile_extents
from ridgework.sources.ingest import ingest_samples as grid_samples
from terrain_fixtures import GRID, friction, supplier_points, supplier_rings, table, terrain, terrain_cells

try:
    from ridgework.llm import queries as corpus
except ImportError as missing:
    # Only the subpackage itself may be absent; a missing wheel must not hide its queries.
    if missing.name not in ("ridgework.llm", "ridgework.llm.queries"):
        raise
    corpus = None

ZOOM = 3
BREAKS = stats.Classes(breaks=tuple(2.0 * i for i in range(225)))


def fresh_catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, scratch_dir(spark, "catalog"))


def stored_terrain(spark: SparkSession, sf: str) -> Catalog:
    catalog = fresh_catalog(spark)
    catalog.write_layer(terrain(spark, sf), "terrain")
    return catalog


def top_cell(spark: SparkSession, sf: str):
    """The highest cell of the terrain; the first in column order if several."""
    cells = terrain_cells(spark, sf).where("z is not null")
    return cells.agg(F.min_by(F.struct("c", "r"), F.struct(-F.col("z"), "c", "r")).alias("at")).first()["at"]


def rounded(layer: Layer, digits: int) -> DataFrame:
    return tiles_to_cells(layer).select("c", "r", F.round("z", digits).alias("z"))


def stored_levels(catalog: Catalog, name: str, digits: int | None = None) -> DataFrame:
    parts = [tiles_to_cells(catalog.read_layer(name, zoom)).select(F.lit(zoom).alias("zoom"), "c", "r", "z") for zoom in (3, 2, 1)]
    rows = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return rows if digits is None else rows.withColumn("z", F.round("z", digits))


# Sources and sinks

def read_layer(spark, sf):
    return tiles_to_cells(stored_terrain(spark, sf).read_layer("terrain", ZOOM))


def read_tile(spark, sf):
    at = top_cell(spark, sf)
    tile = stored_terrain(spark, sf).read_tile("terrain", ZOOM, at.c // GRID.tile_size, at.r // GRID.tile_size)
    return tiles_to_cells(Layer(tile, GRID, ZOOM))


def write_layer(spark, sf):
    tiles = stored_terrain(spark, sf).read_layer("terrain", ZOOM).tiles
    data = F.filter("cells", lambda z: z.isNotNull())
    total = F.aggregate(data, F.lit(0.0), lambda a, b: a + b)
    return tiles.select("col", "row", "zkey", F.size(data).cast("bigint").alias("n"), F.round(total, 4).alias("total"))


def copy_layer(spark, sf):
    catalog = stored_terrain(spark, sf)
    catalog.copy_layer("terrain", "terrain-copy", ZOOM)
    return tiles_to_cells(catalog.read_layer("terrain-copy", ZOOM))


def dump_layer(spark, sf):
    catalog, folder = stored_terrain(spark, sf), scratch_dir(spark, "dump")
    catalog.dump_layer("terrain", ZOOM, folder)
    return catalog.read_dump("terrain", ZOOM, folder)


def lonlat(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_custkey",
        "(cast(o_orderkey % 100 as int) - 50) * 1.7D lon", "(cast(floor(o_orderkey / 100.0) as int) - 750) * 0.11D lat",
        "case when o_orderstatus = 'P' and o_orderkey % 7 = 0 then cast(null as double) "
        "else 20.0D * abs((o_orderkey % 40) - 20) + o_totalprice / 10000.0D end z",
    )


def ingest_samples(spark, sf):
    samples = lonlat(spark, sf).selectExpr("lon + (o_custkey % 7 - 3) * 0.0001D lon", "lat", "z")
    return tiles_to_cells(grid_samples(samples, zoom=6, tile_size=16))


def ingest_nan_samples(spark, sf):
    """Samples of which every third is NaN, which counts as none."""
    samples = lonlat(spark, sf).selectExpr(
        "lon + (o_custkey % 7 - 3) * 0.0001D lon", "lat", "if(o_orderkey % 3 = 0, double('NaN'), z) z")
    return tiles_to_cells(grid_samples(samples, zoom=5, tile_size=16))


def stored_attributes(spark, sf):
    """Two attributes per nation, written again for each of its suppliers."""
    catalog = fresh_catalog(spark)
    suppliers = table(spark, sf, "supplier")
    dated = "timestamp_seconds(s_suppkey) written_at"
    catalog.write_attributes(suppliers.selectExpr(
        "concat('layer-', s_nationkey) layer", "0 zoom", "'altitude' name", "cast(s_suppkey * 10 as string) value", dated))
    catalog.write_attributes(suppliers.selectExpr(
        "concat('layer-', s_nationkey) layer", "0 zoom", "'millis' name",
        "cast(if(s_suppkey % 3 = 0, -1, s_suppkey) as string) value", dated))
    return catalog.attributes()


def read_attribute(spark, sf):
    return stored_attributes(spark, sf).select("layer", "name", "value")


def layer_done(spark, sf):
    done = done_layers(stored_attributes(spark, sf))
    return done.select("layer", F.when(F.col("done"), "ok").otherwise("no").alias("status"))


def read_geojson(spark, sf):
    """One document per supplier, in each of the accepted shapes."""
    at = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "x", "y"))),
        lambda v: F.concat(F.lit("["), v["x"].cast("string"), F.lit(","), v["y"].cast("string"), F.lit("]")),
    )
    rings = supplier_rings(spark, sf).groupBy("geom_id").agg(F.concat(F.lit("[["), F.array_join(at, ","), F.lit("]]")).alias("rings"))
    documents = rings.selectExpr("geom_id", """case geom_id % 4
        when 0 then concat('{"type":"Polygon","coordinates":', rings, '}')
        when 1 then concat('{"type":"MultiPolygon","coordinates":[', rings, ']}')
        when 2 then concat('{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":', rings, '}}')
        else concat('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[0,0]}},',
                    '{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[', rings, ']}}]}') end value""")
    return vectors.parse_geojson(documents)


def read_points(spark, sf):
    path = scratch_dir(spark, "points")
    supplier_points(spark, sf).selectExpr("s_suppkey point_id", "x", "y").write.parquet(path)
    return vectors.read_points(spark, path)


def viewpoints_from_args(spark, sf):
    numbers = "array(s_suppkey * 1.0D, s_nationkey * 2.0D, s_acctbal, 0.0D, -1.0D, s_suppkey % 4 * 100.0D)"
    args = table(spark, sf, "supplier").selectExpr("s_suppkey", f"posexplode({numbers}) as (slot, v)")
    return vectors.viewpoints_from_args(args.selectExpr("s_suppkey * 6 + slot pos", "v"))


# Scalars

def to_web_mercator(spark, sf):
    x, y = mercator("lon", "lat")
    return lonlat(spark, sf).select("o_orderkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def key_extent(spark, sf):
    return tile_extents(terrain(spark, sf))


def cell_center(spark, sf):
    x, y = center("c", "r", GRID)
    return terrain_cells(spark, sf).select("c", "r", x.alias("x"), y.alias("y"))


def map_to_cell(spark, sf):
    c, r = to_cell(F.col("c_acctbal") * 7.5, F.col("c_custkey") * -99.5, GRID)
    return table(spark, sf, "customer").select("c_custkey", c.alias("c"), r.alias("r"))


def key_shift(spark, sf):
    return terrain(spark, sf).tiles.select("col", "row", shift("col", 2).alias("up_col"), shift("row", 2).alias("up_row"))


def zorder_key(spark, sf):
    key = zkey(F.col("o_orderkey") % 1000, F.col("o_custkey") % 1000)
    return table(spark, sf, "orders").select("o_orderkey", key.alias("zkey"))


def is_data(spark, sf):
    return terrain_cells(spark, sf).select(
        "c", "r", has_data("z").alias("is_data"), F.coalesce(is_positive(F.col("z") - 200.0), F.lit(False)).alias("positive"))


def class_index(spark, sf):
    return terrain_cells(spark, sf).select("c", "r", classify("z", BREAKS.breaks).alias("class"))


def or_default(spark, sf):
    given = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", optional(given, workflows.MAX_DISTANCE).alias("max_distance"))


# Filters

def supplier_keys(spark, sf):
    c, r = to_cell("x", "y", GRID)
    return supplier_points(spark, sf).select(c.alias("c"), r.alias("r")).selectExpr("c div 16 col", "r div 16 row")


def filter_keys(spark, sf):
    return tiles_to_cells(masking.filter_keys(terrain(spark, sf), supplier_keys(spark, sf).selectExpr("int(col) col", "int(row) row")))


def ring_corners(spark, sf) -> DataFrame:
    """A four-sided ring with a square hole, stretched over the height of the terrain (cell units)."""
    corners = """stack(10,
        0, 0, 10.0D, 1, 0, 1, 80.0D, 2, 0, 2, 60.0D, 7, 0, 3, 15.0D, 6, 0, 4, 10.0D, 1,
        1, 0, 30.0D, 3, 1, 1, 50.0D, 3, 1, 2, 50.0D, 5, 1, 3, 30.0D, 5, 1, 4, 30.0D, 3) as (ring, seq, u, e)"""
    return terrain_cells(spark, sf).agg((F.max("r") + 1).alias("rows")).selectExpr("rows", corners).selectExpr(
        "0 geom_id", "0 part", "ring", "seq", "u", "rows * e / 8.0D v")


def mask_layer(spark, sf):
    area = ring_corners(spark, sf).selectExpr("geom_id", "part", "ring", "seq", "u * 1000 x", "-v * 1000 y")
    return tiles_to_cells(masking.mask_layer(terrain(spark, sf), area))


def mask_overlapping(spark, sf):
    """The terrain inside any supplier's triangle; triangles overlap."""
    return tiles_to_cells(masking.mask_layer(terrain(spark, sf), supplier_rings(spark, sf).select("geom_id", "part", "ring", "seq", "x", "y")))


# Statistics

def histogram(spark, sf):
    return stats.fixed_width_histogram(terrain(spark, sf), 25.0)


def ranks_of(spark, sf, values) -> DataFrame:
    """Rows ``v, below, upto, total``: how many cells are below a value and up to it."""
    cells = terrain_cells(spark, sf).where("z is not null")
    upto = Window.orderBy("z").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = cells.groupBy("z").agg(F.count("*").alias("n")).unionByName(values.select(F.col("v").alias("z"), F.lit(0).cast("bigint").alias("n")))
    summed = counted.groupBy("z").agg(F.sum("n").alias("n")).select("z", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return values.join(summed, F.col("v") == F.col("z")).select("v", (F.col("upto") - F.col("n")).alias("below"), "upto", "total")


def histogram_approx(spark, sf):
    """The 80 bins of the terrain: their number, count and order, and whether each has about its share of the cells."""
    bins = stats.histogram(terrain(spark, sf)).select(F.inline("bins")).select(F.col("x").alias("v"), "y")
    before = F.sum("y").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    met = bins.withColumn("before", F.coalesce(before, F.lit(0.0))).join(ranks_of(spark, sf, bins.select("v")), "v")
    # The middle of a bin lies among the cells the bin counts, give or take what the sketch is unsure of.
    near = (F.col("upto") >= F.col("before") - 0.01 * F.col("total")) & (F.col("below") <= F.col("before") + F.col("y") + 0.01 * F.col("total"))
    return met.agg(
        F.count("*").alias("bins"), F.sum("y").cast("bigint").alias("cells"), F.max("y").cast("bigint").alias("most"), F.bool_and(near).alias("near")
    ).select("bins", "cells", (F.col("most") <= F.col("cells") / 40).alias("even"), "near")


def quantile_breaks(spark, sf):
    catalog = stored_terrain(spark, sf)
    breaks = stats.exact_breaks(catalog.read_layer("terrain", ZOOM))
    return spark.createDataFrame(list(enumerate(breaks, 1)), "i int, break double")


def quantile_breaks_approx(spark, sf):
    """Whether each of the 256 approximate breaks has the rank asked for, give or take one in a hundred cells."""
    breaks = stats.quantile_breaks(terrain(spark, sf)).select(F.posexplode("breaks").alias("i", "v"))
    ranked = breaks.join(ranks_of(spark, sf, breaks.select("v").distinct()), "v")
    wanted, slack = F.ceil((F.col("i") + 1) * F.col("total") / 256), 0.01 * F.col("total")
    return ranked.select((F.col("i") + 1).alias("i"), ((F.col("below") <= wanted + slack) & (F.col("upto") >= wanted - slack)).alias("near"))


def layer_breaks(spark, sf):
    """Breaks of a stored histogram whose bins are 25 wide."""
    bins = stats.fixed_width_histogram(terrain(spark, sf), 25.0)
    catalog = fresh_catalog(spark)
    ordered = F.array_sort(F.collect_list(F.struct((F.col("bin") * 25.0).alias("x"), F.col("n").cast("double").alias("y"))))
    catalog.write_attributes(bins.agg(F.to_json(ordered).alias("value")).selectExpr(
        "'terrain-pyramid' layer", "0 zoom", "'histogram' name", "value"))
    stored = F.from_json("value", "array<struct<x: double, y: double>>")
    return catalog.attributes().select(F.posexplode(stats.breaks_from_bins(stored, 32)).alias("i", "break")).selectExpr("i + 1 i", "`break`")


def count_points(spark, sf):
    return sight.count_points(supplier_points(spark, sf))


def stored_facts(catalog: Catalog, name: str) -> DataFrame:
    """What a stored histogram says in all: ``bins, cells``."""
    bins = F.from_json("value", "array<struct<x: double, y: double>>")
    kept = catalog.attributes().where((F.col("layer") == name) & (F.col("name") == "histogram")).select(F.inline(bins))
    return kept.agg(F.count("*").alias("bins"), F.sum("y").cast("bigint").alias("cells"))


def ensure_partitions(spark, sf):
    return tiles_to_cells(levels.ensure_partitions(terrain(spark, sf), 16))


# Focal

def slope(spark, sf):
    return rounded(focal.slope(terrain(spark, sf)), 6)


def boundary_points(spark, sf):
    return focal.boundary_points(terrain(spark, sf), 300.0).drop("vp_id")


def boundary_points_across_tiles(spark, sf):
    return focal.boundary_points(terrain(spark, sf), 300.0, across_tiles=True).drop("vp_id")


def collect_points(spark, sf):
    """Boundary viewpoints gathered from the tiles of a key set."""
    kept = masking.filter_keys(terrain(spark, sf), supplier_keys(spark, sf).selectExpr("int(col) col", "int(row) row"))
    return focal.boundary_points(kept, 300.0).select("x", "y", "view_height")


# Viewsheds

def supplier_viewpoints(spark, sf, height="greatest(s_acctbal / 100, 0.0D)", angle="0.0D", fov="-1.0D", altitude="cast('-Infinity' as double)"):
    return supplier_points(spark, sf).selectExpr("x", "y", f"{height} view_height", f"{angle} angle", f"{fov} fov", f"{altitude} altitude")


def near_suppliers(spark, sf, viewpoints=None, max_distance=25000.0, **options):
    viewpoints = supplier_viewpoints(spark, sf) if viewpoints is None else viewpoints
    return sight.viewshed(terrain(spark, sf), viewpoints, max_distance, **options)


def viewshed(spark, sf):
    return tiles_to_cells(near_suppliers(spark, sf))


def viewshed_combine_debug(spark, sf):
    return tiles_to_cells(near_suppliers(spark, sf, operator="DEBUG"))


def viewshed_combine_and(spark, sf):
    seers = table(spark, sf, "nation").selectExpr(
        "(n_nationkey * 4 + 0.5D) * 1000 x", "-(n_nationkey % 5 + 0.5D) * 1000 y", "4000.0D + n_nationkey view_height",
        "0.0D angle", "-1.0D fov", "cast('-Infinity' as double) altitude")
    return tiles_to_cells(near_suppliers(spark, sf, seers, 120000.0, operator="AND"))


def viewshed_min_altitude(spark, sf):
    return tiles_to_cells(near_suppliers(spark, sf, supplier_viewpoints(spark, sf, altitude="420.0D + s_nationkey")))


def fov_cut(spark, sf):
    return tiles_to_cells(near_suppliers(spark, sf, supplier_viewpoints(spark, sf, angle="s_nationkey * 0.25D", fov="0.3D")))


def viewshed_absolute(spark, sf):
    seers = supplier_viewpoints(spark, sf, height="300.0D + s_nationkey * 10")
    return tiles_to_cells(near_suppliers(spark, sf, seers, height_mode="absolute"))


def viewshed_flat_earth(spark, sf):
    return tiles_to_cells(near_suppliers(spark, sf, max_distance=12500.0, curvature=False))


def touched_keys(spark, sf):
    return sight.touched_keys(near_suppliers(spark, sf))


# Cost distance

def travel_cost(spark, sf, max_cost=20000.0):
    return rounded(cost_ops.travel_cost(friction(spark, sf), supplier_points(spark, sf), max_cost), 4)


def travel_cost_negative_keys(spark, sf):
    """The same search on ground moved 50 cells west and 40 north, so that keys lie on both sides of zero."""
    cells = terrain_cells(spark, sf).where("z is not null").selectExpr("c - 50 c", "r - 40 r", "1.0D + floor(z / 100.0D) z")
    starts = supplier_points(spark, sf).selectExpr("x - 50000.0D x", "y + 40000.0D y")
    return rounded(cost_ops.travel_cost(tiling.cells_to_tiles(cells, GRID, ZOOM), starts, 20000.0), 4)


def max_cost(spark, sf):
    return travel_cost(spark, sf, 7500.0)


# Levels and outlines

def pyramid(spark, sf):
    catalog = fresh_catalog(spark)
    levels.store_pyramid(catalog, terrain(spark, sf), "terrain")
    return stored_levels(catalog, "terrain")


def resampled(method):
    return lambda spark, sf: rounded(levels.coarsen(terrain(spark, sf), method), 9)


def pyramid_retiled(spark, sf):
    """The tiles of a pyramid stored in tiles of 24 cells, with what they hold."""
    catalog = fresh_catalog(spark)
    levels.store_pyramid(catalog, terrain(spark, sf), "terrain", tile_size=24)
    data = F.filter("cells", lambda z: z.isNotNull())
    parts = [catalog.read_layer("terrain", zoom).tiles.select(
        F.lit(zoom).alias("zoom"), "col", "row", F.size(data).cast("bigint").alias("n"),
        F.round(F.aggregate(data, F.lit(0.0), lambda a, b: a + b), 4).alias("total")) for zoom in (3, 2, 1)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def retiled(spark, sf):
    return tiles_to_cells(tiling.retile(terrain(spark, sf), 40))


def rasterize_boundary(spark, sf):
    points = outline.rasterize_boundary(supplier_rings(spark, sf), 250.0)
    return points.select(F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "view_height", "altitude")


# Rendering

def render_layer(spark, sf):
    return render.render_layer(terrain(spark, sf), BREAKS)


def render_tile(spark, sf):
    at = top_cell(spark, sf)
    return render.render_tile(stored_terrain(spark, sf), "terrain", ZOOM, at.c // GRID.tile_size, at.r // GRID.tile_size, BREAKS)


def render_stored(spark, sf):
    """One terrain under three names, coloured by its stored histogram, by a count of points and by default."""
    catalog, layer = fresh_catalog(spark), terrain(spark, sf)
    for name in ("by-breaks", "by-points", "plain"):
        catalog.write_layer(layer, name)
    bins = stats.fixed_width_histogram(layer, 25.0)
    ordered = F.array_sort(F.collect_list(F.struct((F.col("bin") * 25.0).alias("x"), F.col("n").cast("double").alias("y"))))
    catalog.write_attributes(bins.agg(F.to_json(ordered).alias("value")).selectExpr("'by-breaks' layer", "0 zoom", "'histogram' name", "value"))
    catalog.write_attributes(table(spark, sf, "supplier").agg(F.count("*").cast("string").alias("value")).selectExpr(
        "'by-points' layer", "0 zoom", "'points' name", "value"))
    painted = render.render_stored(catalog, ["by-breaks", "by-points", "plain"], ZOOM, n=32)
    return render.pixels(painted, GRID.tile_size)


# Whole jobs

def observer_many(spark, sf):
    """An observer per nation, every second one looking further; all outputs are stored by one job."""
    catalog = stored_terrain(spark, sf)
    requests = table(spark, sf, "nation").selectExpr(
        "concat('seen-', n_nationkey) output", "(n_nationkey * 4 + 0.5D) * 1000 x", "-(n_nationkey % 5 + 0.5D) * 1000 y",
        "430.0D + n_nationkey altitude", "if(n_nationkey % 2 = 0, 20000.0D, 30000.0D) max_distance")
    workflows.observer_viewsheds(catalog, "terrain", ZOOM, requests)
    names = [row.output for row in requests.select("output").collect()]
    parts = []
    for zoom in (3, 2, 1):
        cells = catalog.read_layers(names, zoom).select("layer", "col", "row", F.posexplode("cells").alias("at", "z")).where("z is not null")
        parts.append(cells.select(
            "layer", F.lit(zoom).alias("zoom"), (F.col("col") * 16 + F.col("at") % 16).alias("c"),
            (F.col("row") * 16 + F.floor(F.col("at") / 16).cast("int")).alias("r"), "z"))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def touched_runs(spark, sf):
    """The keys that every nation's observer touched, from the stored runs, one level up the pyramid."""
    catalog = stored_terrain(spark, sf)
    requests = table(spark, sf, "nation").selectExpr(
        "concat('seen-', n_nationkey) output", "(n_nationkey * 4 + 0.5D) * 1000 x", "-(n_nationkey % 5 + 0.5D) * 1000 y",
        "430.0D altitude", "20000.0D max_distance")
    workflows.observer_viewsheds(catalog, "terrain", ZOOM, requests, to_zoom=ZOOM)
    every = spark.read.schema("lo bigint, hi bigint, layer string").parquet(f"{catalog.root}/keys")
    return zcurve.keys_of_runs(zcurve.shift_runs(every.select("lo", "hi"), 1)).distinct()


def observed_terrain(spark, sf):
    at, catalog = top_cell(spark, sf), stored_terrain(spark, sf)
    workflows.observer_viewshed(catalog, "terrain", "observer", ZOOM, (at.c + 0.5) * GRID.res, -(at.r + 0.5) * GRID.res, 460.0, 40000.0)
    return catalog


def observer_viewshed(spark, sf):
    return stored_levels(observed_terrain(spark, sf), "observer")


def craft_viewshed(spark, sf):
    catalog = observed_terrain(spark, sf)
    workflows.craft_viewshed(catalog, "terrain", "observer", "craft", ZOOM, 20000.0, magic=1)
    return stored_levels(catalog, "craft")


def polygon_viewshed(spark, sf):
    area = ring_corners(spark, sf).selectExpr("geom_id", "part", "ring", "seq", "u * 0.008D x", "-v * 0.008D y")
    catalog = stored_terrain(spark, sf)
    workflows.polygon_viewshed(catalog, "terrain", area, 450.0, "craft", ZOOM, 15000.0)
    return stored_levels(catalog, "craft")


def travel_cost_surface(spark, sf):
    catalog = stored_terrain(spark, sf)
    workflows.travel_cost_surface(catalog, "terrain", ZOOM, supplier_points(spark, sf))
    facts = stored_facts(catalog, "cost-pyramid").select("cells")
    return stored_levels(catalog, "cost-pyramid", 4).join(F.broadcast(facts))


def viewshed_terrain_prep(spark, sf):
    catalog = stored_terrain(spark, sf)
    workflows.viewshed_terrain_prep(catalog, "terrain", ZOOM)
    facts = stored_facts(catalog, "terrain-pyramid")
    return stored_levels(catalog, "terrain-pyramid").join(F.broadcast(facts))


def viewshed_debug(spark, sf):
    catalog, folder = stored_terrain(spark, sf), scratch_dir(spark, "dump")
    workflows.viewshed_debug(catalog, "terrain", "seen", ZOOM, supplier_viewpoints(spark, sf), 25000.0, folder)
    return catalog.read_dump("seen", ZOOM, folder)


def entry(spark: SparkSession) -> DataFrame:
    """The flagship query: what all suppliers together see of the terrain."""
    return viewshed(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        read_layer, read_tile, write_layer, copy_layer, dump_layer, ingest_samples, read_attribute, layer_done,
        read_geojson, read_points, viewpoints_from_args, to_web_mercator, key_extent, cell_center, map_to_cell,
        key_shift, zorder_key, is_data, class_index, or_default, filter_keys, mask_layer, histogram,
        histogram_approx, quantile_breaks, quantile_breaks_approx, layer_breaks, count_points, ensure_partitions, slope, boundary_points,
        pyramid_retiled, retiled, render_stored, observer_many, touched_runs, travel_cost_negative_keys, mask_overlapping, ingest_nan_samples,
        boundary_points_across_tiles, collect_points, viewshed, viewshed_combine_debug, viewshed_combine_and,
        viewshed_min_altitude, fov_cut, viewshed_absolute, viewshed_flat_earth, touched_keys, travel_cost,
        max_cost, pyramid, rasterize_boundary, render_layer, render_tile, observer_viewshed, craft_viewshed,
        polygon_viewshed, travel_cost_surface, viewshed_terrain_prep, viewshed_debug,
    ]
    return {query.__name__: query for query in named} | {
        f"pyramid_{method}": resampled(method) for method in ("mean", "max", "min")
    } | (corpus.queries() if corpus else {})


def oracle_sql() -> dict[str, str]:
    return terrain_oracle.oracle() | (corpus.oracle_sql() if corpus else {})
