import numpy as np
import pytest

from grids import SMALL, array_of, layer_of, rough
from ridgework.operators.focal import boundary_cells, slope


def brute_slope(z, res):
    out = np.full(z.shape, np.nan)
    for r, c in np.argwhere(~np.isnan(z)):
        w = np.full((3, 3), z[r, c])
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                rr, cc = r + dr, c + dc
                if 0 <= rr < z.shape[0] and 0 <= cc < z.shape[1] and not np.isnan(z[rr, cc]):
                    w[dr + 1, dc + 1] = z[rr, cc]
        k = np.array([1, 2, 1])
        gx, gy = (k @ (w[:, 2] - w[:, 0])) / (8 * res), ((w[2] - w[0]) @ k) / (8 * res)
        out[r, c] = np.degrees(np.arctan(np.hypot(gx, gy)))
    return out


def test_slope_of_rough_ground_across_tiles(spark):
    z = rough((11, 14), seed=1)
    np.testing.assert_allclose(array_of(slope(layer_of(spark, z)), z.shape), brute_slope(z, SMALL.res), atol=1e-9)


def test_slope_of_a_plane_is_constant(spark):
    r, c = np.mgrid[0:10, 0:10]
    steep = array_of(slope(layer_of(spark, 3.0 * c + 4.0 * r)), (10, 10))
    np.testing.assert_allclose(steep[1:-1, 1:-1], np.degrees(np.arctan(0.5)))


def test_slope_scales_with_z_factor(spark):
    r, c = np.mgrid[0:6, 0:6]
    steep = array_of(slope(layer_of(spark, 1.0 * c), z_factor=10.0), (6, 6))
    np.testing.assert_allclose(steep[1:-1, 1:-1], 45.0)


@pytest.mark.parametrize("across", [False, True])
def test_boundary_cells(spark, across):
    z = rough((10, 9), seed=2) - 30
    ts, found = SMALL.tile_size, set()
    for r, c in np.argwhere(np.floor(np.nan_to_num(z, nan=-1)) > 0):
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                rr, cc = r + dr, c + dc
                if not across and (rr // ts, cc // ts) != (r // ts, c // ts):
                    continue
                outside = not (0 <= rr < z.shape[0] and 0 <= cc < z.shape[1])
                if outside or np.isnan(z[rr, cc]) or np.floor(z[rr, cc]) <= 0:
                    found.add((c, r))
    got = boundary_cells(layer_of(spark, z), across).collect()
    assert len(got) == len(found) and {(row.c, row.r) for row in got} == found
