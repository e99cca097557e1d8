"""Points, polygons and viewpoints as tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ridgework.functions.geo import to_web_mercator

POINTS = "point_id bigint, x double, y double"

_GEOMETRY = "struct<type: string, coordinates: string>"
_DOCUMENT = (
    f"struct<type: string, coordinates: string, geometry: {_GEOMETRY}, "
    f"features: array<struct<geometry: {_GEOMETRY}>>>"
)
_RINGS = "array<array<array<double>>>"


def read_points(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    """Start points from a Parquet or CSV point table; text that is no number raises."""
    reader = spark.read.schema(POINTS)
    if source == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    return reader.format(source).load(path)


def _first_area(geometries: Column) -> Column:
    """The first MultiPolygon, or failing that the first Polygon."""
    def of(kind: str) -> Column:
        return F.get(F.filter(geometries, lambda g: g["type"] == kind), 0)

    return F.coalesce(of("MultiPolygon"), of("Polygon"))


def _whole(parts: Column) -> Column:
    """Whether nothing is missing at any level; what does not parse comes out as NULL."""
    def every(values: Column, test) -> Column:
        return values.isNotNull() & F.coalesce(F.forall(values, test), F.lit(False))

    at = lambda vertex: vertex.isNotNull() & (F.size(vertex) >= 2) & every(vertex, lambda x: x.isNotNull())
    return every(parts, lambda rings: every(rings, lambda ring: every(ring, at)))


def parse_geojson(documents: DataFrame, text: str = "value", geom_id: str = "geom_id") -> DataFrame:
    """Vertex rows ``geom_id, part, ring, seq, x, y`` of the area geometry in each document.

    Accepts a bare geometry, a Feature or a FeatureCollection; one without a Polygon or
    MultiPolygon raises, and so do coordinates that are no numbers.
    """
    doc = F.from_json(text, _DOCUMENT)
    geometries = (
        F.when(doc["type"] == "FeatureCollection", F.transform(doc["features"], lambda f: f["geometry"]))
        .when(doc["type"] == "Feature", F.array(doc["geometry"]))
        .otherwise(F.array(F.struct(doc["type"].alias("type"), doc["coordinates"].alias("coordinates"))))
    )
    problem = F.raise_error(F.concat(F.lit("no Polygon or MultiPolygon in document "), F.col(geom_id).cast("string")))
    area = documents.select(geom_id, _first_area(geometries).alias("area"))
    parts = F.when(
        F.col("area.type") == "MultiPolygon", F.from_json("area.coordinates", f"array<{_RINGS}>")
    ).when(
        F.col("area.type") == "Polygon", F.array(F.from_json("area.coordinates", _RINGS))
    ).otherwise(problem.cast(f"array<{_RINGS}>"))
    broken = F.raise_error(F.concat(F.lit("malformed coordinates in document "), F.col(geom_id).cast("string")))
    parts = F.when(_whole(parts), parts).otherwise(broken.cast(f"array<{_RINGS}>"))
    return (
        area.select(geom_id, F.posexplode(parts).alias("part", "rings"))
        .select(geom_id, "part", F.posexplode("rings").alias("ring", "vertices"))
        .select(geom_id, "part", "ring", F.posexplode("vertices").alias("seq", "at"))
        .select(geom_id, "part", "ring", "seq", F.get("at", 0).alias("x"), F.get("at", 1).alias("y"))
    )


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Vertex rows of the first area geometry of each GeoJSON file at ``path``."""
    files = spark.read.text(path, wholetext=True)
    return parse_geojson(files.select(F.input_file_name().alias("geom_id"), "value"))


def project_vertices(vertices: DataFrame) -> DataFrame:
    """Vertex rows in degrees moved to Web Mercator."""
    x, y = to_web_mercator("x", "y")
    return vertices.withColumns({"x": x, "y": y})


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Edge rows ``geom_id, ax, ay, bx, by`` joining each vertex of a ring to the next one.

    Successive vertices meet by an equi-join on the sequence number, so a ring of any length is
    spread over all tasks. An open ring is left open, as in the input.
    """
    ring = ["geom_id", "part", "ring"]
    ends = vertices.select(*ring, (F.col("seq") - 1).alias("seq"), F.col("x").alias("bx"), F.col("y").alias("by"))
    starts = vertices.select(*ring, "seq", F.col("x").alias("ax"), F.col("y").alias("ay"))
    return starts.join(ends, [*ring, "seq"]).select("geom_id", "ax", "ay", "bx", "by")


VIEWPOINT_FIELDS = ("x", "y", "view_height", "angle", "fov", "altitude")


def viewpoints_from_args(args: DataFrame) -> DataFrame:
    """Viewpoints from a flat argument list held as rows ``pos, v`` (``pos`` from 0).

    Six numbers make one viewpoint. A sixth number of 0 asks for the ground itself. A group that
    is not complete raises.
    """
    slot = F.pmod(F.col("pos"), F.lit(6))
    grouped = args.groupBy(F.expr("pos div 6").alias("vp_id")).agg(
        F.count("v").alias("given"),
        *[F.max(F.when(slot == i, F.col("v"))).alias(name) for i, name in enumerate(VIEWPOINT_FIELDS)],
    )
    whole = F.when(F.col("given") == 6, F.col("vp_id")).otherwise(
        F.raise_error(F.concat(F.lit("viewpoint without six numbers: "), F.col("vp_id").cast("string"))).cast("bigint")
    )
    ground = F.when(F.col("altitude") == 0, F.lit(float("-inf"))).otherwise(F.col("altitude"))
    return grouped.select(
        whole.alias("vp_id"), *VIEWPOINT_FIELDS[:-1], ground.alias("altitude")
    )


def argument_rows(spark: SparkSession, values: Iterable[float]) -> DataFrame:
    """A command-line argument list as ``pos, v`` rows."""
    rows = [(i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "pos bigint, v double")
