"""Masks, pyramids, statistics, colours and ingest."""

import numpy as np
import pytest

from grids import SMALL, array_of, layer_of, rough
from ridgework import Grid
from ridgework.functions.ramps import RAMPS, ramp_stops
from ridgework.functions.values import class_index
from ridgework.operators import masking, pyramid, render, stats
from ridgework.sources.catalog import Catalog
from ridgework.sources.ingest import ingest_samples


def ring_rows(spark, *rings, grid=SMALL):
    """Vertex rows from rings of ``(u, v)`` in cell units."""
    rows = [(0, 0, i, j, grid.xmin + u * grid.res, grid.ymax - v * grid.res) for i, ring in enumerate(rings) for j, (u, v) in enumerate([*ring, ring[0]])]
    return spark.createDataFrame(rows, "geom_id int, part int, ring int, seq int, x double, y double")


def inside(shape, *rings):
    out = np.zeros(shape, dtype=bool)
    for r, c in np.ndindex(shape):
        cx, cy, n = c + 0.5, r + 0.5, 0
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
                n += (ay > cy) != (by > cy) and cx < (bx - ax) * (cy - ay) / (by - ay) + ax
        out[r, c] = n % 2
    return out


STAR = [(1.0, -3.0), (9.5, 6.0), (25.0, 7.5), (12.0, 11.0), (14.5, 22.0), (7.0, 13.0), (-4.0, 16.0), (3.5, 8.5)]
HOLE = [(6.0, 7.0), (10.5, 7.5), (9.0, 12.0)]


@pytest.mark.parametrize("rings", [[STAR], [STAR, HOLE], [[(50.0, 50.0), (60.0, 50.0), (55.0, 60.0)]]])
def test_mask(spark, rings):
    z = rough((17, 18), seed=31)
    got = array_of(masking.mask_layer(layer_of(spark, z), ring_rows(spark, *rings)), z.shape)
    np.testing.assert_array_equal(got, np.where(inside(z.shape, *rings), z, np.nan))


def test_mask_when_spans_do_not_fit(spark, nothing_fits):
    z = rough((17, 18), seed=32)
    got = array_of(masking.mask_layer(layer_of(spark, z), ring_rows(spark, STAR, HOLE)), z.shape)
    np.testing.assert_array_equal(got, np.where(inside(z.shape, STAR, HOLE), z, np.nan))


# Wider than one piece of tile columns, with level edges inside tiles, a hole, and a corner on a tile border.
WIDE = [(2.0, 1.0), (560.0, 2.25), (592.0, 12.0), (570.5, 21.75), (300.0, 21.75), (300.0, 18.0), (280.0, 18.0), (280.0, 21.75), (-9.0, 21.75)]
SLOT = [(40.0, 8.0), (420.3, 8.0), (420.3, 15.0), (40.0, 15.0)]


@pytest.mark.parametrize("big,stored", [(False, False), (False, True), (True, True)])
def test_mask_keeps_whole_tiles_within_the_outline(spark, tmp_path, monkeypatch, big, stored):
    if big:
        monkeypatch.setattr("ridgework.session.BROADCAST_BYTES", 0)
    z = rough((24, 600), seed=33, holes=0.0)
    layer = layer_of(spark, z)
    if stored:
        catalog = Catalog(spark, str(tmp_path / "catalog"), block_bits=4)
        catalog.write_layer(layer, "hills")
        layer = catalog.read_layer("hills", 3)
    got = array_of(masking.mask_layer(layer, ring_rows(spark, WIDE, SLOT)), z.shape)
    np.testing.assert_array_equal(got, np.where(inside(z.shape, WIDE, SLOT), z, np.nan))


def test_mask_looks_at_cells_along_the_outline_only(spark):
    ring = [(1.0, 1.0), (4001.0, 1.0), (4001.0, 4001.0), (1.0, 4001.0)]
    lines = masking.outline_lines(ring_rows(spark, ring), SMALL).cache()
    border = {(t, s) for t in range(1001) for s in (0, 1000)} | {(s, t) for t in range(1001) for s in (0, 1000)}
    got = {(r["row"], r["col"]) for r in lines.select("row", "col").distinct().collect()}
    assert border <= got and len(got) <= 2 * len(border)
    cover = masking.covered_keys(masking.inner_cover(lines))
    spans = masking.outline_spans(lines, SMALL.tile_size)
    assert cover.join(spans, ["col", "row"], "left_semi").isEmpty()
    assert cover.where("col not between 1 and 999 or row not between 1 and 999").isEmpty()
    assert cover.unionByName(spans.where("whole").select("col", "row")).distinct().count() == 999 * 999
    lines.unpersist()


@pytest.mark.parametrize("big", [False, True])
def test_filter_keys(spark, big, monkeypatch):
    if big:
        monkeypatch.setattr("ridgework.session.BROADCAST_BYTES", 0)
    z = rough((12, 12), seed=33, holes=0)
    keys = spark.createDataFrame([(0, 1), (0, 1), (2, 2), (7, 7)], "col int, row int")
    got = array_of(masking.filter_keys(layer_of(spark, z), keys), z.shape)
    kept = np.zeros(z.shape, dtype=bool)
    kept[4:8, 0:4] = kept[8:12, 8:12] = True
    np.testing.assert_array_equal(got, np.where(kept, z, np.nan))


@pytest.mark.parametrize("method", pyramid.METHODS)
def test_coarsen(spark, method):
    z = rough((11, 18), seed=34, holes=0.4)
    whole = np.full((12, 18), np.nan)
    whole[:11] = z
    fours = whole.reshape(6, 2, 9, 2).transpose(0, 2, 1, 3).reshape(6, 9, 4)
    with np.testing.suppress_warnings() as quiet:
        quiet.filter(RuntimeWarning)
        wanted = {"nearest": fours[:, :, 3], "mean": np.nanmean(fours, 2), "max": np.nanmax(fours, 2), "min": np.nanmin(fours, 2)}[method]
    up = pyramid.coarsen(layer_of(spark, z), method)
    assert up.zoom == 2 and up.grid.res == 20.0
    np.testing.assert_allclose(array_of(up, (6, 9)), wanted)


def test_pyramid_of_a_constant(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    layer = layer_of(spark, np.full((16, 16), 7.0))
    assert [level.zoom for level in pyramid.pyramid(layer)] == [3, 2, 1]
    pyramid.store_pyramid(catalog, layer, "flat")
    for zoom, side in ((3, 16), (2, 8), (1, 4)):
        np.testing.assert_array_equal(array_of(catalog.read_layer("flat", zoom), (side, side)), 7.0)


def test_pyramid_refusals(spark):
    with pytest.raises(ValueError):
        pyramid.coarsen(layer_of(spark, np.ones((4, 4))), "cubic")
    with pytest.raises(ValueError):
        pyramid.coarsen(layer_of(spark, np.ones((3, 3)), Grid(3, 0.0, 0.0, 1.0)))


def test_ensure_partitions(spark, tmp_path):
    layer = layer_of(spark, np.ones((20, 20)))
    assert pyramid.ensure_partitions(layer, 13).tiles.rdd.getNumPartitions() == 13
    catalog = Catalog(spark, str(tmp_path))
    catalog.write_layer(layer, "flat")
    stored = catalog.read_layer("flat", 3)
    assert pyramid.ensure_partitions(stored, 1) is stored


@pytest.mark.parametrize("kind", ["spread", "repeated", "constant", "single", "skewed"])
@pytest.mark.parametrize("n", [1, 7, 256])
def test_exact_breaks(spark, kind, n):
    rng = np.random.default_rng(35)
    z = {"spread": rng.standard_cauchy(400), "repeated": np.floor(rng.random(400) * 4), "constant": np.full(400, 2.5),
         "single": np.array([3.25]), "skewed": np.concatenate([np.full(300, 1e-9), rng.random(100) * 1e12])}[kind]
    layer = layer_of(spark, z.reshape(-1, 20) if len(z) > 1 else z.reshape(1, 1))
    order = np.sort(z)
    assert stats.exact_breaks(layer, n) == tuple(order[-(-i * len(z) // n) - 1] for i in range(1, n + 1))


def test_histograms(spark):
    z = rough((20, 20), seed=36)
    layer = layer_of(spark, z)
    data = z[~np.isnan(z)]
    bins = stats.histogram(layer, 10).first().bins
    assert len(bins) == 10 and sum(b.y for b in bins) == len(data)
    got = {r.bin: r.n for r in stats.fixed_width_histogram(layer, 5.0).collect()}
    want = dict(zip(*np.unique(np.floor(data / 5), return_counts=True)))
    assert got == want
    breaks = stats.quantile_breaks(layer, 4).first().breaks
    assert breaks[-1] == data.max() and breaks == sorted(breaks)


def test_breaks_come_from_histogram_then_points_then_default(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    assert stats.layer_classes(catalog, "a") == stats.Classes(breaks=(0.0, 1.0))
    catalog.write_attribute("a", 0, "points", 3)
    assert stats.layer_classes(catalog, "a") == stats.Classes(upto=3)
    catalog.write_attribute("a", 0, "histogram", [{"x": 1.0, "y": 3.0}, {"x": 5.0, "y": 1.0}])
    assert stats.layer_classes(catalog, "a", 4) == stats.Classes(breaks=(1.0, 1.0, 1.0, 5.0))
    stats.store_histogram(catalog, layer_of(spark, np.array([[1.0, 1.0], [2.0, 9.0]])), "b")
    assert stats.layer_classes(catalog, "b", 2).breaks == (1.0, 9.0)


def class_colors(name, classes):
    """One colour per class, blended linearly between the ramp's stops and rounded half up."""
    stops, colors = ramp_stops(name), []
    for i in range(classes):
        at = i * (len(stops) - 1) / max(classes - 1, 1)
        left = min(int(at), len(stops) - 2)
        colors.append(tuple(int(a + (b - a) * (at - left) + 0.5) for a, b in zip(stops[left], stops[left + 1])))
    return colors


def test_class_index(spark):
    zs = [(v,) for v in (-5.0, 0.0, 0.1, 1.0, 1.5, 2.0, 9.0, float("nan"), None)]
    df = spark.createDataFrame(zs, "z double")
    listed = [r[0] for r in df.select(class_index("z", [0.0, 1.0, 1.0, 2.0])).collect()]
    assert listed == [0, 0, 1, 1, 3, 3, 3, None, None]
    counted = [r[0] for r in df.select(stats.Classes(upto=2).index("z")).collect()]
    assert counted == [0, 0, 1, 1, 2, 2, 2, None, None]
    with pytest.raises(ValueError):
        class_index("z", [2.0, 1.0])


def test_colours(spark):
    assert len(RAMPS) == 12 and ramp_stops("no such ramp") == ramp_stops("blue-to-red")
    z = np.array([[0.5, 2.0], [np.nan, 99.0]])
    classes = stats.Classes(breaks=(1.0, 2.0, 3.0))
    got = {(r.c, r.r): tuple(r)[2:] for r in render.render_layer(layer_of(spark, z), classes, "light-to-dark-green").collect()}
    colors = class_colors("light-to-dark-green", 3)
    assert got[(0, 0)] == (*colors[0], 255) and got[(1, 0)] == (*colors[1], 255) and got[(1, 1)] == (*colors[2], 255)
    assert got[(0, 1)] == (0, 0, 0, 0) and len(got) == 16


def test_counting_classes_colour_alike(spark):
    z = np.array([[0.0, 0.4], [1.0, 7.0]])
    layer = layer_of(spark, z)
    listed, counted = (
        sorted(map(tuple, render.render_layer(layer, c).collect())) for c in (stats.Classes(breaks=(0.0, 1.0, 2.0)), stats.Classes(upto=2))
    )
    assert listed == counted


@pytest.mark.parametrize("name", sorted(RAMPS))
def test_every_ramp_runs_from_first_to_last_stop(spark, name):
    layer = layer_of(spark, np.arange(4.0).reshape(2, 2))
    for classes in (4, 1):
        got = render.render_layer(layer, stats.Classes(breaks=tuple(range(classes))), name).where("alpha > 0").orderBy("r", "c").collect()
        wanted = class_colors(name, classes)
        assert [tuple(p)[2:5] for p in got] == [wanted[min(i, classes - 1)] for i in range(4)]
    assert wanted == [RAMPS[name][0]]


def test_ingest_takes_the_nearest_sample(spark):
    grid = Grid.zoomed(2, 4)
    deg = 360 / 16
    rows = [(0.4 * deg, 1.0, 5.0), (0.52 * deg, 1.0, 6.0), (0.9 * deg, 1.0, 7.0), (1.5 * deg, 1.0, 8.0), (1.5 * deg, 2.0, None)]
    layer = ingest_samples(spark.createDataFrame(rows, "lon double, lat double, z double"), 2, 4)
    assert layer.grid == grid
    got = array_of(layer, (16, 16))
    assert got[7, 8] == 6.0 and got[7, 9] == 8.0 and np.isnan(got).sum() == 254
