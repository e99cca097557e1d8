from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from grids import SMALL, array_of, layer_of, rough
from ridgework import Grid, Layer
from ridgework.functions.keys import zorder_key
from ridgework.operators.focal import slope
from ridgework.session import scratch_dir, stage
from ridgework.sources.catalog import Catalog


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"))


def test_layer_comes_back_whole_with_its_grid(spark, catalog):
    z = rough((11, 10), seed=21)
    catalog.write_layer(layer_of(spark, z), "hills")
    back = catalog.read_layer("hills", 3)
    assert back.grid == SMALL and back.zoom == 3 and back.stored
    np.testing.assert_array_equal(array_of(back, z.shape), z)


def test_existing_layer_is_refused_unless_overwritten(spark, catalog):
    a, b = rough((5, 5), seed=22), rough((5, 5), seed=23)
    catalog.write_layer(layer_of(spark, a), "hills")
    with pytest.raises(AnalysisException):
        catalog.write_layer(layer_of(spark, b), "hills")
    np.testing.assert_array_equal(array_of(catalog.read_layer("hills", 3), a.shape), a)
    catalog.write_layer(layer_of(spark, b), "hills", overwrite=True)
    np.testing.assert_array_equal(array_of(catalog.read_layer("hills", 3), b.shape), b)


def test_zooms_and_names_are_kept_apart(spark, catalog):
    a, b = rough((5, 5), seed=24), rough((5, 5), seed=25)
    catalog.write_layer(layer_of(spark, a), "hills", zoom=3)
    catalog.write_layer(layer_of(spark, b), "hills", zoom=4)
    catalog.copy_layer("hills", "hills-copy", 4)
    np.testing.assert_array_equal(array_of(catalog.read_layer("hills", 3), a.shape), a)
    np.testing.assert_array_equal(array_of(catalog.read_layer("hills-copy", 4), b.shape), b)
    with pytest.raises(ValueError):
        catalog.read_layer("../elsewhere", 3)


def test_files_follow_the_z_curve(spark, catalog, monkeypatch):
    monkeypatch.setattr("ridgework.sources.catalog.BLOCK_BYTES", 8 * 16 * 4)
    catalog.write_layer(layer_of(spark, np.ones((40, 40))), "hills")
    tiles = catalog.read_layer("hills", 3).tiles.withColumn("file", F.input_file_name())
    assert tiles.where(F.col("zkey") != zorder_key("col", "row")).count() == 0
    per_file = tiles.rdd.map(lambda r: (r.file, r.zkey)).groupByKey().mapValues(list).collect()
    assert all(keys == sorted(keys) for _, keys in per_file)


def test_read_tile(spark, catalog):
    z = rough((12, 12), seed=26)
    catalog.write_layer(layer_of(spark, z), "hills")
    tile = catalog.read_tile("hills", 3, 2, 1)
    np.testing.assert_array_equal(array_of(Layer(tile, SMALL), z.shape)[4:8, 8:12], z[4:8, 8:12])
    assert catalog.read_tile("hills", 3, 9, 9).count() == 0
    assert "EqualTo(zkey" in tile._jdf.queryExecution().executedPlan().toString()


def test_dump_writes_one_folder_per_tile(spark, catalog, tmp_path):
    catalog.write_layer(layer_of(spark, np.arange(64.0).reshape(8, 8)), "hills")
    catalog.dump_layer("hills", 3, str(tmp_path / "dump"))
    folders = {p.name: list(p.glob("*.csv")) for p in (tmp_path / "dump").iterdir() if p.is_dir()}
    assert sorted(folders) == [f"tile=hills-{c}-{r}" for c in (0, 1) for r in (0, 1)]
    assert all(len(files) == 1 for files in folders.values())
    first = folders["tile=hills-1-0"][0].read_text().splitlines()
    assert first[:2] == ["x,y,z", "45.0,-5.0,4.0"] and len(first) == 17


def test_attributes_keep_the_last_value(catalog):
    assert catalog.read_attribute("hills", 0, "altitude") is None
    catalog.write_attribute("hills", 0, "altitude", 5.5)
    catalog.write_attribute("hills", 0, "altitude", 2.5)
    catalog.write_attribute("hills", 1, "altitude", 9)
    catalog.write_attribute("hills", 0, "note", {"a": [1]})
    assert catalog.read_attribute("hills", 0, "altitude") == 2.5
    assert catalog.read_attribute("hills", 1, "altitude") == 9
    assert catalog.read_attribute("hills", 0, "note") == {"a": [1]}
    assert catalog.read_attribute("dales", 0, "note") is None


def test_layer_done(catalog):
    assert catalog.layer_done("seen") == "no"
    catalog.write_attribute("seen", 0, "altitude", 1)
    assert catalog.layer_done("seen") == "no"
    catalog.write_attribute("seen", 0, "millis", -1)
    assert catalog.layer_done("seen") == "no"
    catalog.write_attribute("seen", 0, "millis", 0)
    assert catalog.layer_done("seen") == "ok"
    now = datetime.now()
    assert catalog.layer_done("seen", since=now - timedelta(days=2)) == "ok"
    assert catalog.layer_done("seen", since=now + timedelta(days=2)) == "no"


def test_zorder_key_interleaves_bits(spark):
    rng = np.random.default_rng(27)
    keys = [(int(c), int(r)) for c, r in rng.integers(0, 2**31 - 1, (50, 2))]
    got = spark.createDataFrame(keys, "col int, row int").select("col", "row", zorder_key("col", "row").alias("k")).collect()
    for col, row, key in got:
        assert key == sum(((col >> b) & 1) << (2 * b) | ((row >> b) & 1) << (2 * b + 1) for b in range(31))


def test_zoomed_grid_covers_the_world():
    grid = Grid.zoomed(9)
    assert grid.tile_size == 256 and abs(grid.res - 305.748) < 1e-3
    assert grid.xmin + grid.res * 256 * 2**9 == pytest.approx(-grid.xmin)
    assert grid.coarser().res == Grid.zoomed(8).res


def test_copy_keeps_rims_for_slope(spark, catalog):
    z = rough((11, 13), seed=28)
    catalog.write_layer(layer_of(spark, z), "hills")
    catalog.copy_layer("hills", "copy", 3)
    fresh, stored = slope(layer_of(spark, z)), slope(catalog.read_layer("copy", 3))
    np.testing.assert_array_equal(array_of(stored, z.shape), array_of(fresh, z.shape))
    plan = stored.tiles._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and sum("cells#" in line.split("Batched")[0] for line in scans) == 1


def test_scratch_space_without_a_named_folder(tmp_path):
    def session(master, named=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: named)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)

    assert scratch_dir(session("local[2]"), "x").rsplit("/", 1)[0] == scratch_dir(session("local[2]"), "y").rsplit("/", 1)[0]
    assert scratch_dir(session("yarn", "hdfs:///shared"), "x").startswith("hdfs:///shared/x-")
    with pytest.raises(RuntimeError):
        scratch_dir(session("yarn"), "x")


def test_scratch_space_is_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(named)
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
    staged = stage(spark.range(5).withColumn("id", F.col("id") * 2), "numbers")
    assert "Range" not in staged._jdf.queryExecution().optimizedPlan().toString()
    assert [r.id for r in staged.orderBy("id").collect()] == [0, 2, 4, 6, 8]


def test_dump_is_written_by_many_tasks(spark, tmp_path):
    """One stored file of many tiles is dumped by more than one task."""
    catalog, z = Catalog(spark, str(tmp_path / "catalog")), rough((24, 24), seed=12)
    catalog.write_layer(layer_of(spark, z), "flat")
    assert len(list((tmp_path / "catalog").rglob("block=*/*.parquet"))) == 1
    catalog.dump_layer("flat", 3, str(tmp_path / "dump"))
    files = list((tmp_path / "dump").rglob("*.csv"))
    assert len({file.name.split("-")[1] for file in files}) > 1 and len(files) == 36
    rows = spark.read.option("header", True).csv(str(tmp_path / "dump"), schema="x double, y double, z double, tile string").collect()
    assert sorted((int(r.x // SMALL.res), int(-r.y // SMALL.res), r.z) for r in rows) == sorted((c, r, v) for (r, c), v in np.ndenumerate(z) if not np.isnan(v))


def test_dump_is_written_and_read_in_pieces(spark, catalog, tmp_path, monkeypatch):
    """No scan or write has more folders than the limit, and all rows come back; a tile without data has no folder."""
    z = rough((40, 28), seed=13)
    z[:4, :4] = np.nan
    layer = layer_of(spark, z)
    empty = spark.createDataFrame([(0, 0, [None] * 16)], layer.tiles.schema)
    catalog.write_layer(layer.with_tiles(layer.tiles.unionByName(empty)), "flat")
    assert catalog.read_layer("flat", 3).tiles.count() == 70
    read, folder = [], str(tmp_path / "dump")
    monkeypatch.setattr("ridgework.sources.catalog.DUMP_FOLDERS", 10)
    opened = Catalog._read_csv
    monkeypatch.setattr(Catalog, "_read_csv", lambda self, at, folders: read.append(folders) or opened(self, at, folders))
    catalog.dump_layer("flat", 3, folder)
    rows = catalog.read_dump("flat", 3, folder).collect()
    assert sorted((int(r.x // SMALL.res), int(-r.y // SMALL.res), r.z) for r in rows) == sorted((c, r, v) for (r, c), v in np.ndenumerate(z) if not np.isnan(v))
    assert all(r.tile == f"flat-{int(r.x // SMALL.res) // 4}-{int(-r.y // SMALL.res) // 4}" for r in rows)
    assert len(read) == 7 and all(len(folders) <= 10 for folders in read)
    assert len(list((tmp_path / "dump").glob("tile=*"))) == len({name for folders in read for name in folders}) == 69
    with pytest.raises(AnalysisException):
        catalog.dump_layer("flat", 3, folder)


def test_dump_of_a_layer_without_tiles(spark, catalog, tmp_path):
    catalog.write_layer(layer_of(spark, np.full((4, 4), np.nan)), "none")
    catalog.dump_layer("none", 3, str(tmp_path / "dump"))
    assert catalog.read_dump("none", 3, str(tmp_path / "dump")).count() == 0
