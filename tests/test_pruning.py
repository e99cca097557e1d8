"""Reading few folders of a stored layer, key sets as runs, many outputs by one job, sketches."""

import random

import numpy as np
import pytest

from grids import SMALL, array_of, layer_of, rough
from ridgework import Grid
from ridgework.functions import zcurve
from ridgework.functions.keys import zorder_of
from ridgework.operators import masking, pruning, sketch, stats
from ridgework.operators.tiling import cells_to_tiles, retile, tiles_to_cells
from ridgework.operators.viewshed import viewshed, viewsheds
from ridgework.plans import workflows
from ridgework.sources.catalog import Catalog
from ridgework.sources.ingest import nearest_samples


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folders_read(df):
    return {file.split("block=")[1].split("/")[0] for file in {r[0] for r in df.selectExpr("input_file_name()").collect()}}


@pytest.mark.parametrize("box", [(0, 0, 0, 0), (3, 1, 9, 6), (-5, -3, 2, 4), (-9, 2, -2, 2), (0, 0, 63, 63), (5, 5, 4, 9)])
@pytest.mark.parametrize("bits, most", [(0, 64), (0, 3), (4, 64)])
def test_box_intervals_hold_the_box(box, bits, most):
    west, north, east, south = box
    got = zcurve.box_intervals(*box, bits, most)
    mask = (1 << 31) - 1
    inside = {zorder_of(c & mask, r & mask) >> bits for c in range(west, east + 1) for r in range(north, south + 1)}
    assert len(got) <= most and all(any(lo <= z <= hi for lo, hi in got) for z in inside)
    assert all(a[1] + 1 < b[0] for a, b in zip(got, got[1:]))
    if most == 64 and bits == 0:
        assert sum(hi - lo + 1 for lo, hi in got) == len(inside)


@pytest.fixture
def stored(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"), block_bits=2)
    z = rough((64, 64), seed=51, holes=0)
    catalog.write_layer(layer_of(spark, z), "hills")
    return catalog, catalog.read_layer("hills", 3), z


def test_one_tile_opens_one_folder(stored):
    catalog, layer, z = stored
    tile = catalog.read_tile("hills", 3, 5, 7)
    assert "PartitionFilters: [isnotnull(block" in plan(tile) and len(folders_read(layer.tiles)) == 64
    assert [r.cells for r in tile.collect()] == [z[28:32, 20:24].ravel().tolist()]


def test_keys_and_boxes_open_few_folders(spark, stored):
    _, layer, z = stored
    keys = spark.createDataFrame([(0, 0), (1, 1), (14, 15), (90, 2)], "col int, row int")
    kept = masking.filter_keys(layer, keys)
    assert "dynamicpruning" in plan(kept.tiles) and "block" in plan(kept.tiles).split("PartitionFilters: [")[1].split("]")[0]
    assert np.isfinite(array_of(kept, z.shape)).sum() == 3 * 16
    assert len(folders_read(pruning.in_box(layer, 2, 2, 5, 3))) == 2
    eye = spark.createDataFrame([(45.0, -45.0, 9.0, 0.0, -1.0, float("-inf"))], "x double, y double, view_height double, angle double, fov double, altitude double")
    seen = viewshed(layer, eye, 40.0)
    scans = [line for line in plan(seen.tiles).splitlines() if "FileScan" in line and "block#" in line]
    assert scans and all("PartitionFilters: [isnotnull(block" in line for line in scans)


def test_keys_of_many_blocks_make_a_short_plan(spark, stored):
    """Filters on the blocks of a box reach the keys as filters on a stored column, not on the key's Z-curve expression."""
    _, layer, z = stored
    cells = spark.range(256).selectExpr("cast(id % 16 * 4 as int) c", "cast(id div 16 * 4 as int) r")
    keys = cells.selectExpr("cast(floor(c / 4.0D) as int) col", "cast(floor(r / 4.0D) as int) row").where("col between 3 and 12 and row between 3 and 9")
    kept = pruning.at_keys(layer, keys, (3, 3, 12, 9))
    assert len(zcurve.box_intervals(3, 3, 12, 9, layer.block_bits)) > 4
    optimized = kept._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("shiftleft") == 0 and len(optimized) < 20000
    assert sorted((t.col, t.row) for t in kept.collect()) == sorted((c, r) for c in range(3, 13) for r in range(3, 10))


def test_keys_that_do_not_fit(spark, stored, nothing_fits):
    _, layer, z = stored
    keys = spark.createDataFrame([(0, 0), (14, 15), (14, 15)], "col int, row int")
    assert np.isfinite(array_of(masking.filter_keys(layer, keys), z.shape)).sum() == 2 * 16
    assert pruning.at_keys(layer, keys.limit(0)).count() == 0


def test_runs_of_keys(spark):
    random.seed(4)
    keys = {(random.randrange(-6, 40), random.randrange(-6, 40)) for _ in range(500)} | {(c, r) for c in range(16) for r in range(16)}
    some = {k for k in keys if k[0] % 3} | {(70, 70)}
    frame = lambda ks: spark.createDataFrame(sorted(ks), "col int, row int")
    found = lambda runs: sorted(map(tuple, zcurve.keys_of_runs(runs).collect()))
    runs = zcurve.runs_of_keys(frame(keys))
    assert found(runs) == sorted(keys) and runs.count() < len(keys) / 2
    assert found(zcurve.intersect_runs(runs, zcurve.runs_of_keys(frame(some)))) == sorted(keys & some)
    assert found(zcurve.shift_runs(runs, 2)) == sorted({(c >> 2, r >> 2) for c, r in keys})
    intervals = zcurve.coarse_intervals(runs, 5)
    assert len(intervals) <= 5 and all(any(lo <= r.lo and r.hi <= hi for lo, hi in intervals) for r in runs.collect())
    assert zcurve.coarse_intervals(runs.where("lo < -1")) == []


def test_tiles_at_runs(spark, stored):
    _, layer, z = stored
    keys = [(c, r) for c in range(3, 7) for r in range(2, 9)] + [(15, 15), (99, 1)]
    runs = zcurve.runs_of_keys(spark.createDataFrame(keys, "col int, row int"))
    got = pruning.at_runs(layer, runs)
    assert sorted((r.col, r.row) for r in got.collect()) == sorted(keys[:-1]) and "block" in plan(got).split("PartitionFilters: [")[1].split("]")[0]
    fresh = pruning.at_runs(layer_of(spark, z), runs)
    assert sorted((r.col, r.row) for r in fresh.collect()) == sorted(keys[:-1])


@pytest.mark.parametrize("size", [2, 6, 4, 16])
def test_retile(spark, size):
    z = rough((19, 22), seed=52, holes=0.5)
    got = retile(layer_of(spark, z), size)
    assert got.grid == Grid(size, 0.0, 0.0, 10.0)
    np.testing.assert_array_equal(array_of(got, z.shape), z)
    below = spark.createDataFrame([(int(c) - 9, int(r) - 7, float(z[r, c])) for r, c in np.argwhere(~np.isnan(z))], "c int, r int, z double")
    moved = tiles_to_cells(retile(cells_to_tiles(below, SMALL), size))
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, below.collect()))


@pytest.mark.parametrize("unit", [256, 2])
def test_many_requests_equal_single_ones(spark, monkeypatch, unit):
    """Requests of different reach, crowds among them, against one viewshed each."""
    monkeypatch.setattr("ridgework.operators.viewshed.UNIT_VIEWPOINTS", unit)
    z = rough((22, 25), seed=53)
    layer = layer_of(spark, z)
    rows = [(i % 3, (2.5 + 7 * i) % 25 * 10, -((3.5 + 5 * i) % 22) * 10, 20.0 + i, 0.0, -1.0, float("-inf"), 40.0 + 30 * (i % 3)) for i in range(12)]
    views = spark.createDataFrame(rows, "request bigint, x double, y double, view_height double, angle double, fov double, altitude double, far double")
    for operator in ("DEBUG", "AND"):
        found = viewsheds(layer, views, operator=operator).collect()
        for request in range(3):
            one = viewshed(layer, views.where(f"request = {request}").drop("request", "far"), 40.0 + 30 * request, operator=operator)
            want = {(r.col, r.row): r.cells for r in one.tiles.collect()}
            assert {(r.col, r.row): r.cells for r in found if r.request == request} == want and want


def test_observers_by_one_job(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    catalog.write_layer(layer_of(spark, rough((16, 16), seed=54, holes=0), Grid(4, 0.0, 0.0, 1000.0)), "hills")
    rows = [("a", 2500.0, -2500.0, 120.0, 4000.0), ("b.1", 12500.0, -9500.0, 90.0, None), ("away", 9e7, -9e7, 1.0, 4000.0)]
    requests = spark.createDataFrame(rows, "output string, x double, y double, altitude double, max_distance double")
    workflows.observer_viewsheds(catalog, "hills", 3, requests)
    for name, x, y, altitude, far in rows[:2]:
        workflows.observer_viewshed(catalog, "hills", f"{name}-alone", 3, x, y, altitude, far or workflows.MAX_DISTANCE)
        for zoom, side in ((3, 16), (2, 8), (1, 4)):
            both = [array_of(catalog.read_layer(n, zoom), (side, side)) for n in (name, f"{name}-alone")]
            np.testing.assert_array_equal(*both)
        keys = [sorted(map(tuple, catalog.read_keys(n, 0, "touched").collect())) for n in (name, f"{name}-alone")]
        assert keys[0] == keys[1] and keys[0]
        assert catalog.layer_done(name) == "ok" and catalog.read_attribute(name, 0, "altitude") == altitude
    assert catalog.read_layer("away", 3).tiles.count() == 0 and catalog.layer_done("away") == "ok"
    with pytest.raises(ValueError, match="stored"):
        workflows.observer_viewsheds(catalog, "hills", 3, requests)
    for bad in (["x", "x"], ["../x"]):
        with pytest.raises(ValueError):
            workflows.observer_viewsheds(catalog, "hills", 3, spark.createDataFrame([(n, 2500.0, -2500.0, 1.0) for n in bad], "output string, x double, y double, altitude double"))


def test_sketch_brackets_are_certain(monkeypatch):
    monkeypatch.setattr(sketch, "GATHERED", 500)
    rng = np.random.default_rng(5)
    for z in (rng.standard_cauchy(20000), np.floor(rng.random(20000) * 50), np.append(np.full(15000, 3.0), rng.random(5000))):
        own = sketch.Growing(200)
        for part in np.array_split(z, 37):
            own.add(part)
        groups, order = own.whole(), np.sort(z)
        assert groups.shape[1] <= 200 and groups[sketch.COUNT].sum() == len(z)
        ranks = list(range(1, len(z) + 1, 97)) + [len(z)]
        assert all(low <= order[rank - 1] <= high for rank, (low, high) in zip(ranks, sketch.brackets(groups, ranks)))
        # The rank of a bracketed value is unsure by the groups that reach over it, each about one share per squeeze.
        wide = groups[:, groups[sketch.LEAST] < groups[sketch.MOST]]
        for x in np.quantile(z, [0.01, 0.3, 0.5, 0.9]):
            over = (wide[sketch.LEAST] <= x) & (x <= wide[sketch.MOST])
            assert wide[sketch.COUNT][over].sum() <= 0.08 * len(z)


def test_breaks_in_two_scans(spark, monkeypatch):
    """A coarse sketch leaves wide brackets; the cells are scanned twice all the same."""
    monkeypatch.setattr(sketch, "SKETCH", 16)
    z = np.random.default_rng(6).standard_normal(900).reshape(30, 30)
    scans = []
    monkeypatch.setattr(stats, "_inside", lambda *args, own=stats._inside: scans.append(1) or own(*args))
    order = np.sort(z.ravel())
    assert stats.exact_breaks(layer_of(spark, z), 50) == tuple(order[-(-i * 900 // 50) - 1] for i in range(1, 51)) and len(scans) == 1
    bins = stats.histogram(layer_of(spark, np.array([[1.0, np.inf], [-np.inf, 1.0]]))).first().bins
    assert [(b.x, b.y) for b in bins] == [(-np.inf, 1.0), (1.0, 2.0), (np.inf, 1.0)]


def in_many_tasks(spark, z):
    """A layer whose tiles lie in more tasks than sketches are merged at once."""
    layer = layer_of(spark, z)
    return layer.with_tiles(layer.tiles.repartition(2 * sketch.FAN_IN + 5, "col", "row"))


def test_histogram_of_many_tasks(spark):
    z = np.floor(np.random.default_rng(8).random((40, 40)) * 30)
    bins = stats.histogram(in_many_tasks(spark, z)).first().bins
    assert [(b.x, b.y) for b in bins] == [(v, float(n)) for v, n in zip(*np.unique(z, return_counts=True))]


def test_exact_breaks_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sketch, "SKETCH", 64)
    z = np.random.default_rng(9).standard_normal((40, 40))
    order = np.sort(z.ravel())
    assert stats.exact_breaks(in_many_tasks(spark, z), 50) == tuple(order[-(-i * z.size // 50) - 1] for i in range(1, 51))


def test_approximate_breaks_of_many_tasks(spark):
    z = np.random.default_rng(10).standard_normal((40, 40))
    order = np.sort(z.ravel())
    breaks = stats.quantile_breaks(in_many_tasks(spark, z), 50).first().breaks
    assert breaks == [order[-(-i * z.size // 50) - 1] for i in range(1, 51)]


def test_samples_are_reduced_without_sorted_aggregation(spark, monkeypatch):
    monkeypatch.setattr("ridgework.sources.ingest.SAMPLES_AT_ONCE", 50)
    grid, rng = Grid.zoomed(4, 8), np.random.default_rng(7)
    rows = [(float(a), float(b), float(v)) for a, b, v in zip(rng.choice(np.linspace(-60, 60, 90), 3000), rng.choice(np.linspace(-60, 60, 90), 3000), np.floor(rng.random(3000) * 9))]
    samples = spark.createDataFrame(rows, "lon double, lat double, z double").repartition(7)
    found = nearest_samples(samples, grid)
    assert "SortAggregate" not in plan(found)
    best = {}
    for lon, lat, z in rows:
        x, y = lon * np.pi * 6378137.0 / 180, 6378137.0 * np.log(np.tan(np.radians(45 + lat / 2)))
        c, r = int((x - grid.xmin) // grid.res), int((grid.ymax - y) // grid.res)
        d2 = round((x - grid.xmin - (c + 0.5) * grid.res) ** 2 + (grid.ymax - (r + 0.5) * grid.res - y) ** 2, 3)
        best[c, r] = min(best.get((c, r), (d2, lon, lat, z)), (d2, lon, lat, z))
    assert {(r.c, r.r): r.z for r in found.collect()} == {k: v[3] for k, v in best.items()}
