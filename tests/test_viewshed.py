import math

import numpy as np
import pyarrow as pa
import pytest

from grids import SMALL, array_of, layer_of, rough
from ridgework import Grid
from ridgework.grid import EARTH_RADIUS
from ridgework.operators import viewshed as operator
from ridgework.operators.viewshed import touched_keys, viewshed

FIELDS = "x double, y double, view_height double, angle double, fov double, altitude double"
ANY = float("-inf")


def seers(spark, rows, grid=SMALL):
    """Viewpoints from ``(c, r, height)`` and optionally angle, fov and altitude."""
    whole = [(*row, *(0.0, -1.0, ANY)[len(row) - 3:]) for row in rows]
    return spark.createDataFrame([((c + 0.5) * grid.res, -(r + 0.5) * grid.res, *map(float, rest)) for c, r, *rest in whole], FIELDS)


def brute(z, rows, reach, res, curvature=True, absolute=False):
    """Number of viewpoints seeing each cell and number reaching it, one ray at a time."""
    seen, reached = np.zeros(z.shape), np.zeros(z.shape, dtype=bool)
    for row in rows:
        c, r, height, angle, fov, altitude = (*row, *(0.0, -1.0, ANY)[len(row) - 3:])
        on_map = 0 <= r < z.shape[0] and 0 <= c < z.shape[1] and not np.isnan(z[r, c])
        if not absolute and not on_map:
            continue
        eye = height if absolute else z[r, c] + height
        mine, met = np.zeros(z.shape, dtype=bool), np.zeros(z.shape, dtype=bool)
        if on_map:
            mine[r, c] = met[r, c] = True
        rim = {(i, s) for i in range(-reach, reach + 1) for s in (-reach, reach)}
        for dx, dy in rim | {(b, a) for a, b in rim}:
            if fov > -1 and (dx * math.cos(angle) - dy * math.sin(angle)) / math.hypot(dx, dy) < fov:
                continue
            top = -math.inf
            for k in range(1, reach + 1):
                dc, dr = math.floor((2 * k * dx + reach) / (2 * reach)), math.floor((2 * k * dy + reach) / (2 * reach))
                cc, rr, d = c + dc, r + dr, math.sqrt(dc * dc + dr * dr) * res
                if d > reach * res or not (0 <= rr < z.shape[0] and 0 <= cc < z.shape[1]) or np.isnan(z[rr, cc]):
                    continue
                drop = d * d / (2 * EARTH_RADIUS) if curvature else 0.0
                met[rr, cc] = True
                if (max(z[rr, cc], altitude) - drop - eye) / d >= top:
                    mine[rr, cc] = True
                top = max(top, (z[rr, cc] - drop - eye) / d)
        seen += mine
        reached |= met
    return np.where(reached, seen, np.nan)


CROWD = [(3, 3, 20), (9, 8, 5), (9, 8, 5), (9, 8, 5), (10, 8, 40), (14, 2, 0, 0.7, 0.2), (5, 11, 10, 2.5, -0.4, 60), (0, 0, 3), (40, 40, 1)]


@pytest.mark.parametrize("reach", [1, 5, 12])
@pytest.mark.parametrize("curvature", [True, False])
def test_counts_equal_brute_force(spark, reach, curvature):
    z = rough((15, 17), seed=11)
    got = viewshed(layer_of(spark, z), seers(spark, CROWD), reach * SMALL.res, curvature, "DEBUG")
    np.testing.assert_array_equal(array_of(got, z.shape), brute(z, CROWD, reach, SMALL.res, curvature))


def test_absolute_height_stands_on_nodata_too(spark):
    z = rough((12, 12), seed=12)
    z[5, 5] = np.nan
    rows = [(5, 5, 120), (-3, 4, 150)]
    got = viewshed(layer_of(spark, z), seers(spark, rows), 80.0, operator="DEBUG", height_mode="absolute")
    np.testing.assert_array_equal(array_of(got, z.shape), brute(z, rows, 8, SMALL.res, absolute=True))
    assert viewshed(layer_of(spark, z), seers(spark, [(5, 5, 120)]), 80.0).tiles.count() == 0


@pytest.mark.parametrize("fan_in", [2, 64])
def test_crowded_tiles_are_cut_into_units(spark, monkeypatch, fan_in):
    monkeypatch.setattr("ridgework.operators.viewshed.UNIT_VIEWPOINTS", 2)
    monkeypatch.setattr("ridgework.operators.viewshed.FAN_IN", fan_in)
    z = rough((13, 13), seed=13)
    rows = [(c, r, 10 + c) for c in range(2, 8) for r in range(2, 6)]
    got = viewshed(layer_of(spark, z), seers(spark, rows), 60.0, operator="DEBUG")
    np.testing.assert_array_equal(array_of(got, z.shape), brute(z, rows, 6, SMALL.res))


@pytest.mark.parametrize("unit", [2, 256])
def test_when_nothing_fits(spark, nothing_fits, monkeypatch, unit):
    monkeypatch.setattr("ridgework.operators.viewshed.UNIT_VIEWPOINTS", unit)
    z = rough((12, 14), seed=14)
    got = viewshed(layer_of(spark, z), seers(spark, CROWD), 70.0, operator="DEBUG")
    np.testing.assert_array_equal(array_of(got, z.shape), brute(z, CROWD, 7, SMALL.res))


def test_operators_agree(spark):
    z, rows = rough((12, 12), seed=15), [(3, 3, 30), (4, 4, 30), (4, 4, 30)]
    layer = layer_of(spark, z)
    count, any_, all_ = (array_of(viewshed(layer, seers(spark, rows), 90.0, operator=op), z.shape) for op in ("DEBUG", "OR", "AND"))
    data = ~np.isnan(count)
    np.testing.assert_array_equal(any_[data], (count[data] > 0).astype(float))
    np.testing.assert_array_equal(all_[data], (count[data] == 3).astype(float))
    assert 0 < all_[data].sum() < any_[data].sum()


def test_flat_ground_is_seen_whole(spark):
    flat = np.zeros((16, 16))
    got = array_of(viewshed(layer_of(spark, flat), seers(spark, [(8, 8, 1)]), 60.0, curvature=False), flat.shape)
    r, c = np.mgrid[0:16, 0:16]
    np.testing.assert_array_equal(got, np.where(np.hypot(r - 8, c - 8) <= 6, 1.0, np.nan))


def test_tile_size_does_not_matter(spark):
    z, big = rough((20, 20), seed=16), Grid(32, 0.0, 0.0, 10.0)
    a, b = (viewshed(layer_of(spark, z, g), seers(spark, CROWD), 110.0, operator="DEBUG") for g in (SMALL, big))
    np.testing.assert_array_equal(array_of(a, z.shape), array_of(b, z.shape))


def test_touched_keys_cover_the_reach(spark):
    flat = np.zeros((16, 16))
    seen = viewshed(layer_of(spark, flat), seers(spark, [(1, 1, 1)]), 50.0)
    assert {tuple(k) for k in touched_keys(seen).collect()} == {(0, 0), (1, 0), (0, 1), (1, 1)}


def test_bad_words_are_refused(spark):
    layer = layer_of(spark, np.zeros((4, 4)))
    for options in ({"operator": "XOR"}, {"height_mode": "sea"}):
        with pytest.raises(ValueError):
            viewshed(layer, seers(spark, [(1, 1, 1)]), 40.0, **options)
    with pytest.raises(ValueError):
        viewshed(layer, seers(spark, [(1, 1, 1)]), 4.0)


def test_viewpoints_of_a_tile_share_kernel_calls(spark, monkeypatch):
    """Reports travel a row per viewpoint and tile, and the rays of a tile's viewpoints are handled together."""
    rows, blocks = [], []
    kernel, gradients = operator._reports, operator._gradients
    monkeypatch.setattr(operator, "_gradients", lambda *args: blocks.append(1) or gradients(*args))
    crew = [{"vp": v, "c": v % 4, "r": v // 4, "eye": 9.0, "n": 1, "angle": 0.0, "fov": -1.0, "altitude": -np.inf, "far": 80.0, "reach": 8} for v in range(16)]
    kind = pa.struct([(n, pa.int64()) for n in ("vp", "c", "r", "n", "reach")] + [(n, pa.float64()) for n in ("eye", "angle", "fov", "altitude", "far")])
    one = pa.RecordBatch.from_arrays(
        [pa.array([1], pa.int32()), pa.array([0], pa.int32()), pa.array([[1.0] * 16]), pa.array([crew], pa.list_(kind))], ["col", "row", "cells", "crew"])
    for batch in kernel(["col", "row"], SMALL, True)([one]):
        rows += batch.to_pylist()
    assert len(blocks) == 1 and [row["vp"] for row in rows] == list(range(16))


def test_reports_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(operator, "REPORT_RAYS", 5)
    monkeypatch.setattr(operator, "REPORTS_AT_ONCE", 40)
    z, rows = rough((13, 14), seed=77), [(3, 4, 30.0), (9, 9, 5.0), (9, 9, 5.0)]
    got = array_of(viewshed(layer_of(spark, z), seers(spark, rows), 60.0, operator="DEBUG"), z.shape)
    np.testing.assert_array_equal(got, brute(z, rows, 6, SMALL.res))
