"""Jobs from stored layers to stored layers, and the batch commands."""

import json

import numpy as np
import pytest

from grids import array_of, layer_of, points_at, rough
from ridgework import Grid
from ridgework.__main__ import main
from ridgework.operators.tiling import tiles_to_cells
from ridgework.plans import workflows
from ridgework.sources.catalog import Catalog
from ridgework.sources.ingest import ingest_samples
from ridgework.sources.vectors import parse_geojson

GRID = Grid(4, 0.0, 0.0, 1000.0)


@pytest.fixture
def catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    catalog.write_layer(layer_of(spark, np.zeros((16, 16)), GRID), "flat")
    return catalog


def test_observer_then_craft(spark, catalog):
    workflows.observer_viewshed(catalog, "flat", "seen", 3, 8500.0, -8500.0, 300.0, max_distance=5000.0)
    assert catalog.layer_done("seen") == "ok" and catalog.read_attribute("seen", 0, "altitude") == 300.0
    seen = catalog.read_layer("seen", 3)
    r, c = np.mgrid[0:16, 0:16]
    near = np.hypot(r - 8, c - 8) <= 5
    np.testing.assert_array_equal(array_of(seen, (16, 16)), np.where(near, 1.0, np.nan))
    keys = {tuple(k) for k in catalog.read_keys("seen", 0, "touched").collect()}
    assert keys == {(c // 4, r // 4) for r, c in np.argwhere(near)}

    points = workflows.craft_points(catalog, "seen", 3, magic=1).collect()
    assert points and {p.view_height for p in points} == {300.0}
    workflows.craft_viewshed(catalog, "flat", "seen", "craft", 3, max_distance=3000.0, magic=1)
    assert catalog.layer_done("craft") == "ok"
    for zoom, side in ((3, 16), (2, 8), (1, 4)):
        assert np.nansum(array_of(catalog.read_layer("craft", zoom), (side, side))) > 0


def test_polygon(spark, catalog):
    corners = [[0.02, -0.02], [0.1, -0.03], [0.06, -0.11], [0.02, -0.02]]
    text = json.dumps({"type": "Polygon", "coordinates": [corners]})
    area = parse_geojson(spark.createDataFrame([(0, text)], "geom_id int, value string"))
    workflows.polygon_viewshed(catalog, "flat", area, 100.0, "seen", 3, max_distance=2500.0)
    assert catalog.layer_done("seen") == "ok"
    got = array_of(catalog.read_layer("seen", 3), (16, 16))
    assert got[2, 2] == 1.0 and got[11, 6] == 1.0 and np.isnan(got[15, 15])


def test_cost_surface(spark, catalog):
    z = rough((16, 16), seed=41, holes=0)
    catalog.write_layer(layer_of(spark, z, GRID), "hills")
    workflows.travel_cost_surface(catalog, "hills", 3, points_at(spark, [(3, 3)], GRID))
    cost = array_of(catalog.read_layer("cost", 3), z.shape)
    assert cost[3, 3] == 0 and np.nanmax(cost) <= workflows.MAX_COST
    assert sum(b["y"] for b in catalog.read_attribute("cost-pyramid", 0, "histogram")) == np.isfinite(cost).sum()
    np.testing.assert_array_equal(array_of(catalog.read_layer("cost-pyramid", 3), z.shape), cost)


def test_cost_surface_read_by_many_tasks(spark, tmp_path):
    """A folder per tile, so that the histogram's sketch comes from several tasks."""
    catalog, z = Catalog(spark, str(tmp_path), block_bits=0), rough((32, 32), seed=42, holes=0)
    catalog.write_layer(layer_of(spark, z, GRID), "hills")
    workflows.travel_cost_surface(catalog, "hills", 3, points_at(spark, [(3, 3)], GRID), max_cost=1e9)
    cost = catalog.read_layer("cost", 3)
    assert cost.tiles.rdd.getNumPartitions() > 1
    assert sum(b["y"] for b in catalog.read_attribute("cost-pyramid", 0, "histogram")) == z.size
    np.testing.assert_array_equal(array_of(catalog.read_layer("cost-pyramid", 3), z.shape), array_of(cost, z.shape))


def test_terrain_prep_read_by_many_tasks(spark, tmp_path):
    catalog, z = Catalog(spark, str(tmp_path), block_bits=0), np.floor(rough((32, 32), seed=43) / 5)
    catalog.write_layer(layer_of(spark, z, GRID), "hills")
    workflows.viewshed_terrain_prep(catalog, "hills", 3)
    assert catalog.read_layer("hills", 3).tiles.rdd.getNumPartitions() > 1
    values, counts = np.unique(z[~np.isnan(z)], return_counts=True)
    assert [(b["x"], b["y"]) for b in catalog.read_attribute("hills-pyramid", 0, "histogram")] == list(zip(values, counts))
    np.testing.assert_array_equal(array_of(catalog.read_layer("hills-pyramid", 3), z.shape), z)


def test_batch_commands(spark, catalog, tmp_path):
    z = rough((16, 16), seed=42)
    catalog.write_layer(layer_of(spark, z, GRID), "hills")
    run = lambda *args: main([catalog.root, *map(str, args)], spark)
    run("viewshed", "hills", "seen", 3, 6000, "OR", 8500, -8500, 40, 0, -1, 0, 2500, -2500, 40, 0, -1, 0)
    run("slope", "hills", "slope", 3)
    spark.createDataFrame([(1, 3500.0, -3500.0)], "point_id bigint, x double, y double").write.parquet(str(tmp_path / "points"))
    run("travel_cost", "slope", "cost", 3, tmp_path / "points", 20000)
    run("histogram", "cost", 3, "cost-pyramid", 0)
    run("pyramid", "cost", 3, "cost-pyramid", 4)
    run("copy", "hills", "hills-copy", 3)
    run("dump", "seen", 3, tmp_path / "dump")
    corners = [[0.0, 0.0], [0.06, 0.0], [0.06, -0.06], [0.0, -0.06], [0.0, 0.0]]
    (tmp_path / "area.json").write_text(json.dumps({"type": "Polygon", "coordinates": [corners]}))
    run("mask", "hills", "hills-masked", 3, tmp_path / "area.json")

    np.testing.assert_array_equal(array_of(catalog.read_layer("hills-copy", 3), z.shape), z)
    masked = array_of(catalog.read_layer("hills-masked", 3), z.shape)
    kept = np.zeros(z.shape, dtype=bool)
    kept[:7, :7] = True
    np.testing.assert_array_equal(masked, np.where(kept, z, np.nan))
    assert np.nansum(array_of(catalog.read_layer("seen", 3), z.shape)) > 0
    assert array_of(catalog.read_layer("cost-pyramid", 1), (4, 4)).shape == (4, 4)
    assert len(list((tmp_path / "dump").glob("tile=seen-*"))) > 0


def test_job_commands(spark, catalog, tmp_path):
    run = lambda *args: main([catalog.root, *map(str, args)], spark)
    lines = ["lon,lat,z"] + [f"{0.02 + 0.04 * i},{-0.02 - 0.04 * j},{100 + i * j}" for i in range(12) for j in range(12)]
    (tmp_path / "samples.csv").write_text("\n".join(lines))
    run("ingest", tmp_path / "samples.csv", "loose", 6, 64)
    samples = spark.read.csv(str(tmp_path / "samples.csv"), header=True, schema="lon double, lat double, z double")
    stored = tiles_to_cells(catalog.read_layer("loose", 6)).collect()
    assert sorted(stored) == sorted(tiles_to_cells(ingest_samples(samples, 6, 64)).collect()) and stored
    catalog.write_layer(layer_of(spark, rough((16, 16), seed=7), GRID), "hills")
    run("observer", "hills", "watch", 3, 8500, -8500, 40, 6000)
    run("craft", "hills", "watch", "craft", 3, 6000, 1)
    corners = [[0.0, 0.0], [0.06, 0.0], [0.06, -0.06], [0.0, -0.06], [0.0, 0.0]]
    (tmp_path / "area.json").write_text(json.dumps({"type": "Polygon", "coordinates": [corners]}))
    run("polygon", "hills", "area", 3, tmp_path / "area.json", 900, 4000)
    assert [catalog.layer_done(name) for name in ("watch", "craft", "area")] == ["ok"] * 3
    run("prepare", "hills", 3)
    spark.createDataFrame([(1, 3500.0, -3500.0)], "point_id bigint, x double, y double").write.parquet(str(tmp_path / "points"))
    run("surface", "hills", 3, tmp_path / "points", 20000)
    for name in ("hills-pyramid", "cost-pyramid"):
        assert catalog.read_attribute(name, 0, "histogram")
        assert catalog.read_layer(name, 1).tiles.count() > 0


def test_unknown_command_is_refused(spark, catalog):
    with pytest.raises(SystemExit):
        main([catalog.root, "erode", "hills"], spark)
    with pytest.raises(ValueError):
        main([catalog.root, "viewshed", "flat", "x", "3", "6000", "XOR", "1", "1", "1", "0", "-1", "0"], spark)
