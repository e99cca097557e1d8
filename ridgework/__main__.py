"""Batch commands: ``python -m ridgework <catalog> <command> <arguments>``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from ridgework.operators.travel_cost import travel_cost
from ridgework.operators.focal import slope
from ridgework.operators.masking import mask_layer
from ridgework.operators.pyramid import ensure_partitions, store_pyramid
from ridgework.operators.stats import store_histogram
from ridgework.operators.viewshed import viewshed
from ridgework.plans import workflows
from ridgework.sources.catalog import Catalog
from ridgework.sources.ingest import ingest_samples
from ridgework.sources.vectors import (
    argument_rows, project_vertices, read_geojson, read_points, viewpoints_from_args,
)

USAGE = """\
viewshed     <input> <output> <zoom> <max distance> AND|DEBUG|OR <x y height angle fov altitude> ...
pyramid      <input> <zoom> <output> <tile size>
mask         <input> <output> <zoom> <geojson>
copy         <input> <output> <zoom>
slope        <input> <output> <zoom>
travel_cost <input> <output> <zoom> <point table> <max cost>
dump         <input> <zoom> <folder>
histogram    <input> <zoom> <output> <output zoom>
ingest       <sample table> <output> <zoom> <tile size>
observer     <terrain> <output> <zoom> <x> <y> <altitude> <max distance>
craft        <terrain> <observer> <output> <zoom> <max distance> <levels up>
polygon      <terrain> <output> <zoom> <geojson> <altitude> <max distance>
prepare      <elevation> <zoom>
surface      <elevation> <zoom> <point table> <max cost>"""


def file_kind(path: str) -> str:
    return "csv" if path.endswith(".csv") else "parquet"


def run_viewshed(catalog, source, target, zoom, max_distance, operator, *points):
    seers = viewpoints_from_args(argument_rows(catalog.spark, points))
    layer = catalog.read_layer(source, int(zoom))
    catalog.write_layer(viewshed(layer, seers, float(max_distance), operator=operator), target)


def run_pyramid(catalog, source, zoom, target, size):
    store_pyramid(catalog, ensure_partitions(catalog.read_layer(source, int(zoom))), target, tile_size=int(size))


def run_mask(catalog, source, target, zoom, geojson):
    area = project_vertices(read_geojson(catalog.spark, geojson))
    catalog.write_layer(mask_layer(catalog.read_layer(source, int(zoom)), area), target)


def run_copy(catalog, source, target, zoom):
    catalog.copy_layer(source, target, int(zoom))


def run_slope(catalog, source, target, zoom):
    catalog.write_layer(slope(catalog.read_layer(source, int(zoom))), target)


def run_travel_cost(catalog, source, target, zoom, points, max_cost):
    starts = read_points(catalog.spark, points, file_kind(points))
    catalog.write_layer(travel_cost(catalog.read_layer(source, int(zoom)), starts, float(max_cost)), target)


def run_dump(catalog, source, zoom, folder):
    catalog.dump_layer(source, int(zoom), folder)


def run_histogram(catalog, source, zoom, target, target_zoom):
    store_histogram(catalog, catalog.read_layer(source, int(zoom)), target, int(target_zoom))


def run_ingest(catalog, samples, target, zoom, size):
    reader = catalog.spark.read.schema("lon double, lat double, z double")
    if file_kind(samples) == "csv":
        rows = reader.option("header", True).option("mode", "FAILFAST").csv(samples)
    else:
        rows = reader.parquet(samples)
    catalog.write_layer(ingest_samples(rows, int(zoom), int(size)), target)


def run_observer(catalog, terrain, target, zoom, x, y, altitude, max_distance):
    workflows.observer_viewshed(catalog, terrain, target, int(zoom), float(x), float(y), float(altitude), float(max_distance))


def run_craft(catalog, terrain, observer, target, zoom, max_distance, levels):
    workflows.craft_viewshed(catalog, terrain, observer, target, int(zoom), float(max_distance), int(levels))


def run_polygon(catalog, terrain, target, zoom, geojson, altitude, max_distance):
    area = read_geojson(catalog.spark, geojson)
    workflows.polygon_viewshed(catalog, terrain, area, float(altitude), target, int(zoom), float(max_distance))


def run_prepare(catalog, elevation, zoom):
    workflows.viewshed_terrain_prep(catalog, elevation, int(zoom))


def run_surface(catalog, elevation, zoom, points, max_cost):
    starts = read_points(catalog.spark, points, file_kind(points))
    workflows.travel_cost_surface(catalog, elevation, int(zoom), starts, float(max_cost))


COMMANDS = {
    "viewshed": run_viewshed, "pyramid": run_pyramid, "mask": run_mask, "copy": run_copy,
    "slope": run_slope, "travel_cost": run_travel_cost, "dump": run_dump, "histogram": run_histogram,
    "ingest": run_ingest, "observer": run_observer, "craft": run_craft, "polygon": run_polygon, "prepare": run_prepare,
    "surface": run_surface,
}


def main(args: list[str], spark: SparkSession | None = None) -> None:
    if len(args) < 2 or args[1] not in COMMANDS:
        raise SystemExit(f"usage: <catalog> <command> <arguments>\n{USAGE}")
    spark = spark or SparkSession.builder.appName("ridgework").getOrCreate()
    COMMANDS[args[1]](Catalog(spark, args[0]), *args[2:])


if __name__ == "__main__":
    main(sys.argv[1:])
