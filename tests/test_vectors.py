import json
import math

import pytest
from pyspark.errors import PySparkException

from ridgework.operators.outline import outline_cells, rasterize_boundary
from ridgework.sources import vectors

RING = [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 0.0]]
POLYGON = {"type": "Polygon", "coordinates": [RING]}
MULTI = {"type": "MultiPolygon", "coordinates": [[RING], [RING, RING]]}


def parse(spark, *docs):
    rows = [(i, json.dumps(doc)) for i, doc in enumerate(docs)]
    return vectors.parse_geojson(spark.createDataFrame(rows, "geom_id int, value string"))


def feature(geometry):
    return {"type": "Feature", "properties": {}, "geometry": geometry}


def test_geometries_and_features(spark):
    got = parse(spark, POLYGON, MULTI, feature(POLYGON)).orderBy("geom_id", "part", "ring", "seq").collect()
    assert [r[3:] for r in got if r.geom_id == 0] == [(i, *map(float, p)) for i, p in enumerate(RING)]
    assert {(r.part, r.ring) for r in got if r.geom_id == 1} == {(0, 0), (1, 0), (1, 1)}
    assert [r[3:] for r in got if r.geom_id == 2] == [r[3:] for r in got if r.geom_id == 0]


def test_first_multipolygon_of_a_collection(spark):
    other = {"type": "MultiPolygon", "coordinates": [[[[9, 9], [8, 8], [9, 9]]]]}
    point = {"type": "Point", "coordinates": [1, 2]}
    doc = {"type": "FeatureCollection", "features": [feature(g) for g in (point, POLYGON, MULTI, other)]}
    assert {(r.part, r.ring) for r in parse(spark, doc).collect()} == {(0, 0), (1, 0), (1, 1)}


@pytest.mark.parametrize("doc", [
    {"type": "Point", "coordinates": [1, 2]}, feature({"type": "LineString", "coordinates": [[1, 2], [3, 4]]}),
    {"type": "FeatureCollection", "features": []},
])
def test_other_geometries_are_refused(spark, doc):
    with pytest.raises(PySparkException, match="no Polygon or MultiPolygon"):
        parse(spark, doc).collect()


def test_file_on_many_lines(spark, tmp_path):
    path = tmp_path / "area.json"
    path.write_text(json.dumps(feature(POLYGON), indent=4))
    assert vectors.read_geojson(spark, str(path)).count() == 4


def test_edges_follow_each_ring(spark):
    edges = vectors.polygon_edges(parse(spark, MULTI)).collect()
    assert len(edges) == 9
    assert {tuple(e)[1:] for e in edges} == {(0, 0, 4, 0), (4, 0, 4, 2), (4, 2, 0, 0)}


def test_points_from_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("point_id,x,y\n1,2.5,-3\n2,0,1e3\n")
    got = vectors.read_points(spark, str(tmp_path / "p.csv"), "csv").orderBy("point_id").collect()
    assert [tuple(r) for r in got] == [(1, 2.5, -3.0), (2, 0.0, 1000.0)]


def test_viewpoint_arguments(spark):
    args = [-10877415, 4448309, 4000, 0, -1, 0, 1, 2, 3, 4, 5, 6]
    got = vectors.viewpoints_from_args(vectors.argument_rows(spark, args)).orderBy("vp_id").collect()
    assert tuple(got[0]) == (0, -10877415.0, 4448309.0, 4000.0, 0.0, -1.0, -math.inf)
    assert tuple(got[1]) == (1, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
    with pytest.raises(PySparkException, match="without six numbers"):
        vectors.viewpoints_from_args(vectors.argument_rows(spark, args[:-1])).collect()


def test_outline_of_a_square(spark):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [80, 0], [80, 80], [0, 80], [0, 0]]]}
    got = {(r.gc, r.gr) for r in outline_cells(parse(spark, square), cells=8).collect()}
    assert got == {(c, r) for c in range(8) for r in range(8) if c in (0, 7) or r in (0, 7)}
    points = rasterize_boundary(parse(spark, square), 500.0, cells=8).collect()
    assert {(p.x, p.y) for p in points} == {(c * 10 + 5.0, 75.0 - r * 10) for c, r in got}
    assert {tuple(p)[3:] for p in points} == {(500.0, 0.0, -1.0, -math.inf)}
    assert len({p.vp_id for p in points}) == len(points)


def test_outline_without_width(spark):
    line = {"type": "Polygon", "coordinates": [[[5, 0], [5, 80], [5, 0]]]}
    assert {(r.gc, r.gr) for r in outline_cells(parse(spark, line), cells=8).collect()} == {(0, r) for r in range(8)}
