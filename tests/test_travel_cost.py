import heapq

import numpy as np
import pyarrow as pa
import pytest

from grids import SMALL, array_of, layer_of, points_at, rough
from ridgework import Grid
from ridgework.operators import travel_cost as operator
from ridgework.operators.travel_cost import travel_cost
from ridgework.session import scratch_dir
from ridgework.sources.catalog import Catalog


def dijkstra(f, starts, max_cost, res):
    cost = np.full(f.shape, np.inf)
    heap = []
    for c, r in starts:
        if 0 <= r < f.shape[0] and 0 <= c < f.shape[1] and f[r, c] >= 0:
            cost[r, c] = 0.0
            heap.append((0.0, r, c))
    heapq.heapify(heap)
    while heap:
        d, r, c = heapq.heappop(heap)
        if d > cost[r, c]:
            continue
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                rr, cc = r + dr, c + dc
                if (dr or dc) and 0 <= rr < f.shape[0] and 0 <= cc < f.shape[1] and f[rr, cc] >= 0:
                    new = d + (f[r, c] + f[rr, cc]) / 2 * (2**0.5 if dr and dc else 1.0) * res
                    if new <= max_cost and new < cost[rr, cc]:
                        cost[rr, cc] = new
                        heapq.heappush(heap, (new, rr, cc))
    return np.where(np.isinf(cost), np.nan, cost)


STARTS = [(2, 3), (2, 3), (15, 12), (400, 3), (0, 0)]


@pytest.mark.parametrize("max_cost", [0.0, 800.0, 1e9])
def test_equals_dijkstra(spark, max_cost):
    f = rough((18, 21), seed=3, holes=0.2)
    f[f > 80] *= -1
    got = array_of(travel_cost(layer_of(spark, f), points_at(spark, STARTS), max_cost), f.shape)
    np.testing.assert_allclose(got, dijkstra(f, STARTS, max_cost, SMALL.res), rtol=1e-12)


def test_path_that_leaves_a_tile_and_returns(spark):
    f = np.full((8, 8), 1.0)
    f[0:4, 1] = np.nan
    f[4, 0:3] = [1.0, 50.0, 1.0]
    f[5, :] = np.nan
    got = array_of(travel_cost(layer_of(spark, f), points_at(spark, [(0, 0)]), 1e9), f.shape)
    np.testing.assert_allclose(got, dijkstra(f, [(0, 0)], 1e9, SMALL.res))


def test_when_neither_mail_nor_keys_fit_and_the_front_is_wide(spark, nothing_fits, monkeypatch):
    monkeypatch.setattr("ridgework.operators.travel_cost.SETTLE_CELLS", 64)
    f = rough((14, 13), seed=4, holes=0.1)
    got = array_of(travel_cost(layer_of(spark, f), points_at(spark, [(1, 1)]), 1e9), f.shape)
    np.testing.assert_allclose(got, dijkstra(f, [(1, 1)], 1e9, SMALL.res), rtol=1e-12)


@pytest.mark.parametrize("cells", [1, 64])
def test_blocks_of_any_size_settle_alike(spark, monkeypatch, cells):
    """Many rounds over blocks of one to sixty-four tiles, whose history is merged on the way."""
    monkeypatch.setattr("ridgework.operators.travel_cost.SETTLE_CELLS", cells)
    monkeypatch.setattr("ridgework.operators.travel_cost.FAN", 2)
    f = rough((21, 18), seed=9, holes=0.25)
    got = array_of(travel_cost(layer_of(spark, f), points_at(spark, [(1, 1), (17, 20)]), 1e9), f.shape)
    np.testing.assert_allclose(got, dijkstra(f, [(1, 1), (17, 20)], 1e9, SMALL.res), rtol=1e-12)


def test_history_stays_short(spark, monkeypatch):
    """Of any number of rounds a few folders are left, and each block is found in the last round that settled it."""
    monkeypatch.setattr(operator, "FAN", 3)
    history = operator.History(spark, scratch_dir(spark, "history"))
    for i in range(20):
        rows = [(0, 0, [float(i)]), (i, 1, [float(i)]), (i % 5, 2, [float(i)])]
        stored = history.append(spark.createDataFrame([(*r, []) for r in rows], operator._ROUND))
        assert stored.count() == 3
    assert sum(map(len, history.levels)) <= 8
    want = {(0, 0): 19.0} | {(i, 1): float(i) for i in range(20)} | {(i, 2): 15.0 + i for i in range(5)}
    assert {(r.hc, r.hr): r.cost[0] for r in history.last().collect()} == want
    keys = spark.createDataFrame([(0, 0), (7, 1), (3, 2), (90, 90)], "hc int, hr int")
    assert {(r.hc, r.hr): r.cost[0] for r in history.last(keys, True).collect()} == {(0, 0): 19.0, (7, 1): 7.0, (3, 2): 18.0}


def test_rounds_read_the_folders_of_the_front(spark, tmp_path, monkeypatch):
    """One start on a stored layer of many blocks: few blocks' folders are read in any round."""
    monkeypatch.setattr(operator, "SETTLE_CELLS", 64)
    catalog = Catalog(spark, str(tmp_path), block_bits=2)
    catalog.write_layer(layer_of(spark, np.ones((64, 64))), "flat")
    plans = []
    appended = operator.History.append
    monkeypatch.setattr(operator.History, "append", lambda self, rows: plans.append(rows) or appended(self, rows))
    found = travel_cost(catalog.read_layer("flat", 3), points_at(spark, [(4, 4)]), 150.0)
    assert found.tiles.count() > 4 and len(plans) <= 6
    scans = [line for p in plans for line in p._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line and "block#" in line and "cells#" in line]
    assert scans and all("PartitionFilters: [isnotnull(block" in line and "dynamicpruning" in line for line in scans)


def test_scans_narrowed_to_blocks(spark, monkeypatch):
    monkeypatch.setattr("ridgework.sources.catalog.BLOCK_BYTES", 8 * 16 * 2)
    f = rough((30, 30), seed=5, holes=0.1)
    got = array_of(travel_cost(layer_of(spark, f), points_at(spark, [(1, 1), (28, 3)]), 1e9), f.shape)
    np.testing.assert_allclose(got, dijkstra(f, [(1, 1), (28, 3)], 1e9, SMALL.res), rtol=1e-12)


def test_no_start_on_passable_ground(spark):
    f = rough((6, 6), seed=6)
    assert travel_cost(layer_of(spark, f), points_at(spark, [(90, 90)]), 10.0).tiles.count() == 0
    assert travel_cost(layer_of(spark, f), points_at(spark, []), 10.0).tiles.count() == 0


def test_result_does_not_depend_on_the_tiling(spark):
    f = rough((20, 20), seed=7)
    starts = points_at(spark, [(3, 3)])
    a = travel_cost(layer_of(spark, f), starts, 2000.0)
    b = travel_cost(layer_of(spark, f, Grid(32, 0.0, 0.0, 10.0)), starts, 2000.0)
    np.testing.assert_array_equal(array_of(a, f.shape), array_of(b, f.shape))


def test_a_round_stores_reached_tiles_and_takes_a_block_at_a_time(spark, monkeypatch):
    """Narrow ground in wide blocks: the log holds the tiles that were reached, and a batch of many blocks is settled one by one."""
    stored, laid = [], []
    appended = operator.History.append
    monkeypatch.setattr(operator.History, "append", lambda self, rows: stored.append(appended(self, rows)) or stored[-1])
    monkeypatch.setattr(operator, "SETTLE_CELLS", 32 * 32)
    ground = np.ones((70, 6))
    ground[:, 3] = np.nan
    ground[35, 3] = 2.0
    layer = layer_of(spark, ground)
    got = array_of(travel_cost(layer, points_at(spark, [(0, 0), (5, 69)]), 1e9), ground.shape)
    np.testing.assert_allclose(got, dijkstra(ground, [(0, 0), (5, 69)], 1e9, SMALL.res))
    assert all(len(row.cost) <= 2 * 8 * 17 for rows in stored for row in rows.select("cost").collect())

    cells = pa.array([[1.0] * 16], pa.list_(pa.float64()))
    tiles = pa.ListArray.from_arrays([0, 1], pa.StructArray.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), cells], ["col", "row", "cells"]))
    letters = pa.array([[{"c": 0, "r": 0, "cost": 0.0, "f": None}]], pa.list_(pa.struct([("c", pa.int32()), ("r", pa.int32()), ("cost", pa.float64()), ("f", pa.float64())])))
    one = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), tiles, letters, pa.array([None], pa.list_(pa.float64()))], ["hc", "hr", "tiles", "mail", "cost"])
    many = pa.Table.from_batches([one] * 3).combine_chunks().to_batches()
    found = list(operator._relax(SMALL, 2, 1e9)(many))
    assert [batch.num_rows for batch in found] == [1, 1, 1] and len(found[0].column(2)[0]) == 17
