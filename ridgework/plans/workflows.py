"""The jobs users run end to end, each from stored layers to stored layers."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ridgework.functions.values import or_default
from ridgework.functions.zcurve import runs_of_keys, shift_runs
from ridgework.operators.travel_cost import travel_cost
from ridgework.operators.focal import boundary_points, slope
from ridgework.operators.outline import rasterize_boundary
from ridgework.operators.pruning import at_runs
from ridgework.operators.pyramid import coarser_tiles, store_pyramid
from ridgework.operators.stats import store_histogram
from ridgework.operators.viewshed import touched_keys, viewshed, viewsheds
from ridgework.session import checked_broadcast, stage
from ridgework.sources.catalog import Catalog
from ridgework.sources.vectors import project_vertices

# Defaults of optional request parameters.
MAX_DISTANCE = 144000.0
MAGIC = 5
MAX_COST = 20000.0


def _millis(since: float) -> int:
    return int((time.monotonic() - since) * 1000)


def observer_viewshed(
    catalog: Catalog, terrain: str, output: str, zoom: int, x: float, y: float, altitude: float,
    max_distance: float = MAX_DISTANCE,
) -> None:
    """Where an object at ``altitude`` can be seen by an observer on the ground at ``(x, y)``.

    Stores the pyramid, then the altitude, the touched tile keys and, last, ``millis``.
    """
    standing = catalog.spark.range(1).select(
        F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(0.0).alias("view_height"),
        F.lit(0.0).alias("angle"), F.lit(-1.0).alias("fov"), F.lit(float(altitude)).alias("altitude"),
    )
    started = time.monotonic()
    seen = viewshed(catalog.read_layer(terrain, zoom), standing, max_distance)
    store_pyramid(catalog, seen, output)
    millis = _millis(started)
    catalog.write_attribute(output, 0, "altitude", float(altitude))
    catalog.write_keys(touched_keys(catalog.read_layer(output, zoom)), output, 0, "touched")
    catalog.write_attribute(output, 0, "millis", millis)


def observer_viewsheds(catalog: Catalog, terrain: str, zoom: int, requests: DataFrame, to_zoom: int = 1) -> None:
    """The same for many observers, rows ``output, x, y, altitude`` and, optionally, ``max_distance``, by one job.

    All outputs and all their zooms are written together, then what is stored about each as above. Outputs are
    new layers; where nothing is in reach an output has no tiles.
    """
    started = time.monotonic()
    given = F.col("max_distance") if "max_distance" in requests.columns else F.lit(None)
    asked = stage(requests.select(
        F.col("output").alias("layer"), F.col("x").cast("double"), F.col("y").cast("double"), F.col("altitude").cast("double"),
        or_default(given.cast("double"), MAX_DISTANCE).alias("far"),
    ).withColumn("request", F.monotonically_increasing_id()), "requests")
    standing = asked.select(
        "request", "x", "y", "altitude", "far", F.lit(0.0).alias("view_height"), F.lit(0.0).alias("angle"), F.lit(-1.0).alias("fov"))
    layer = catalog.read_layer(terrain, zoom)
    level, grid = stage(viewsheds(layer, standing), "seen"), layer.grid
    touched = runs_of_requests(level)
    levels, grids = [level.withColumn("zoom", F.lit(zoom))], {zoom: grid}
    for coarser in range(zoom - 1, to_zoom - 1, -1):
        level = stage(coarser_tiles(level, grid.tile_size, "nearest", ["request"]), "seen")
        grid = grid.coarser()
        levels.append(level.withColumn("zoom", F.lit(coarser)))
        grids[coarser] = grid
    catalog.write_layers(reduce(DataFrame.unionByName, levels), asked, grids)
    fact = lambda name, value: asked.select("layer", F.lit(0).alias("zoom"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    catalog.write_attributes(fact("altitude", F.col("altitude")))
    named = touched.join(checked_broadcast(asked.select("request", "layer"), 256), "request")
    catalog.write_runs(named.select("layer", F.lit(0).alias("zoom"), F.lit("touched").alias("name"), "lo", "hi"))
    catalog.write_attributes(fact("millis", F.lit(_millis(started))))


def runs_of_requests(tiles: DataFrame) -> DataFrame:
    """The keys of each request's tiles as runs ``request, lo, hi``."""
    return runs_of_keys(tiles.select("request", "col", "row"), ["request"])


def craft_points(catalog: Catalog, observer: str, zoom: int, magic: int = MAGIC) -> DataFrame:
    """Viewpoints on the rim of what an earlier observer sees, at that observer's altitude.

    The rim is taken ``magic`` levels up the observer's pyramid, so that there are fewer of them. The observer's
    stored runs of touched keys, moved up as many levels, say which of its tiles are read.
    """
    altitude = catalog.read_attribute(observer, 0, "altitude")
    touched = stage(shift_runs(catalog.read_runs(observer, 0, "touched"), magic), "touched")
    layer = catalog.read_layer(observer, zoom - magic)
    return boundary_points(layer.with_tiles(at_runs(layer, touched)), altitude)


def craft_viewshed(
    catalog: Catalog, terrain: str, observer: str, output: str, zoom: int,
    max_distance: float = MAX_DISTANCE, magic: int = MAGIC,
) -> None:
    """Ground seen from a craft that may be anywhere on the rim of an observer's viewshed."""
    points = craft_points(catalog, observer, zoom, magic)
    started = time.monotonic()
    seen = viewshed(catalog.read_layer(terrain, zoom), points, max_distance, height_mode="absolute")
    store_pyramid(catalog, seen, output)
    catalog.write_attribute(output, 0, "millis", _millis(started))


def polygon_viewshed(
    catalog: Catalog, terrain: str, vertices: DataFrame, altitude: float, output: str, zoom: int,
    max_distance: float = MAX_DISTANCE,
) -> None:
    """Ground seen from a craft at ``altitude`` anywhere on a polygon's outline (degrees)."""
    points = rasterize_boundary(project_vertices(vertices), altitude)
    started = time.monotonic()
    seen = viewshed(catalog.read_layer(terrain, zoom), points, max_distance, height_mode="absolute")
    store_pyramid(catalog, seen, output)
    catalog.write_attribute(output, 0, "millis", _millis(started))


def travel_cost_surface(
    catalog: Catalog, elevation: str, zoom: int, points: DataFrame, max_cost: float = MAX_COST,
    slope_name: str = "slope", cost_name: str = "cost", pyramid_name: str = "cost-pyramid",
) -> None:
    """Slope as friction, cost distance over it, its histogram and its pyramid."""
    catalog.write_layer(slope(catalog.read_layer(elevation, zoom)), slope_name)
    catalog.write_layer(travel_cost(catalog.read_layer(slope_name, zoom), points, max_cost), cost_name)
    cost = catalog.read_layer(cost_name, zoom)
    store_histogram(catalog, cost, pyramid_name)
    store_pyramid(catalog, cost, pyramid_name)


def viewshed_terrain_prep(catalog: Catalog, elevation: str, zoom: int) -> None:
    """Pyramid and histogram of an elevation layer, under ``<elevation>-pyramid``."""
    layer, output = catalog.read_layer(elevation, zoom), f"{elevation}-pyramid"
    store_pyramid(catalog, layer, output)
    store_histogram(catalog, layer, output)


def viewshed_debug(
    catalog: Catalog, elevation: str, output: str, zoom: int, viewpoints: DataFrame, max_distance: float,
    folder: str, operator: str = "OR",
) -> None:
    """A viewshed, stored and then dumped tile by tile."""
    catalog.write_layer(viewshed(catalog.read_layer(elevation, zoom), viewpoints, max_distance, operator=operator), output)
    catalog.dump_layer(output, zoom, folder)
