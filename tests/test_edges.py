"""Inputs at the edge of what the operators promise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grids import SMALL, array_of, layer_of, points_at, rough
from ridgework import Grid, session
from ridgework.operators.masking import mask_layer
from ridgework.operators.pyramid import ensure_partitions
from ridgework.operators.stats import exact_breaks
from ridgework.operators.tiling import cells_to_tiles, tiles_to_cells
from ridgework.operators.travel_cost import travel_cost
from ridgework.operators.viewshed import viewshed
from ridgework.sources.ingest import nearest_samples
from ridgework.sources.vectors import parse_geojson, read_points
from test_travel_cost import dijkstra


@pytest.mark.parametrize("starts", [[(3, 2)], [(14, 17)], [(3, 17), (14, 2)]])
def test_travel_cost_across_zero(spark, starts):
    """The same search on a layer whose cells lie on both sides of zero in x and y."""
    f, off = rough((20, 18), seed=8, holes=0.15), 9
    rows = [(int(c) - off, int(r) - off, float(z)) for (r, c), z in np.ndenumerate(f) if not np.isnan(z)]
    layer = cells_to_tiles(spark.createDataFrame(rows, "c int, r int, z double"), SMALL, 3)
    found = travel_cost(layer, points_at(spark, [(c - off, r - off) for c, r in starts]), 1e9)
    got = np.full(f.shape, np.nan)
    for row in tiles_to_cells(found).collect():
        got[row.r + off, row.c + off] = row.z
    np.testing.assert_allclose(got, dijkstra(f, starts, 1e9, SMALL.res), rtol=1e-12)


def test_partitions_are_not_reduced(spark):
    layer = layer_of(spark, rough((16, 16), seed=1))
    many = layer.with_tiles(layer.keyed.repartition(40, "col", "row"))
    assert ensure_partitions(many, 12).tiles.rdd.getNumPartitions() == 40
    few = layer.with_tiles(layer.keyed.coalesce(1))
    assert ensure_partitions(few, 12).tiles.rdd.getNumPartitions() == 12


@pytest.mark.parametrize("coordinates", ['"oops"', '[[[0, 0], ["a", 1], [1, 1]]]', "null", "[[[0, 0], [1], [1, 1]]]", "[[[0, 0], null, [1, 1]]]"])
def test_broken_geojson_raises(spark, coordinates):
    text = f'{{"type": "Polygon", "coordinates": {coordinates}}}'
    with pytest.raises(Exception, match="malformed coordinates"):
        parse_geojson(spark.createDataFrame([("a", text)], "geom_id string, value string")).collect()


def test_broken_points_raise(spark, tmp_path):
    path = tmp_path / "points.csv"
    path.write_text("point_id,x,y\n1,abc,2.0\n")
    with pytest.raises(Exception):
        read_points(spark, str(path), "csv").collect()


@pytest.mark.parametrize("size", [4, 8])
def test_overlapping_areas_unite(spark, size):
    array = np.arange(144.0).reshape(12, 12)
    squares = [("a", 0, 0), ("b", size // 2, size // 2), ("c", 0, 0)]
    rows = []
    for geom, c, r in squares:
        ring = [(c, r), (c + size, r), (c + size, r + size), (c, r + size), (c, r)]
        rows += [(geom, 0, 0, i, x * 10.0, -y * 10.0) for i, (x, y) in enumerate(ring)]
    vertices = spark.createDataFrame(rows, "geom_id string, part int, ring int, seq int, x double, y double")
    wanted = np.full(array.shape, np.nan)
    for _, c, r in squares:
        wanted[r:r + size, c:c + size] = array[r:r + size, c:c + size]
    np.testing.assert_array_equal(array_of(mask_layer(layer_of(spark, array), vertices), array.shape), wanted)


def test_samples_that_are_nan_lose(spark):
    grid = Grid.zoomed(3, 4)
    samples = spark.createDataFrame([(10.0, 10.0, float("nan")), (10.1, 10.1, 5.0), (50.0, 50.0, float("nan"))], "lon double, lat double, z double")
    assert [r.z for r in nearest_samples(samples, grid).collect()] == [5.0]


def test_viewpoints_without_ground_are_ignored(spark):
    layer = layer_of(spark, np.zeros((4, 4)))
    eyes = spark.createDataFrame([(15.0, -15.0, 5.0, 0.0, -1.0, float("-inf")), (9e5, -9e5, 5.0, 0.0, -1.0, float("-inf"))],
                                 "x double, y double, view_height double, angle double, fov double, altitude double")
    seen = array_of(viewshed(layer, eyes, 1000.0, operator="AND"), (4, 4))
    alone = array_of(viewshed(layer, eyes.where("x < 100"), 1000.0, operator="AND"), (4, 4))
    assert np.nansum(alone) == 16
    np.testing.assert_array_equal(seen, alone)


@pytest.mark.parametrize("odd", [{3: np.inf}, {3: -np.inf, 5: np.inf}, {i: np.inf for i in range(16)}])
def test_breaks_with_infinities(spark, odd):
    values = np.arange(16.0)
    for i, z in odd.items():
        values[i] = z
    ranked = np.sort(values)
    wanted = tuple(ranked[-(-i * 16 // 4) - 1] for i in range(1, 5))
    assert exact_breaks(layer_of(spark, values.reshape(4, 4)), 4) == wanted


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_heavy_sides_are_sorted_not_hashed(spark):
    a, b = (spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias(n)) for n in "ab")
    assert "SortMergeJoin" in plan(session.merge_join(a, b, ["k"], "left", is_small=False))
    assert "BroadcastHashJoin" in plan(session.merge_join(a, b, ["k"], "left", is_small=True))
