"""Polygon layers from GeoJSON as vertex tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormshift.functions.albers import Albers

_SCHEMA = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def read_geojson(spark: SparkSession, path: str, layer: str | None = None, projection: Albers | None = None, layer_property: str | None = None) -> DataFrame:
    """layer, part, ring, seq, x, y of all Polygons and MultiPolygons of a FeatureCollection, holes included.

    projection: longitude and latitude are projected. A layer is named by `layer`, or by a property of each
    feature, so that many watersheds come from one file.
    """
    found = spark.read.schema(_SCHEMA).json(path, multiLine=True).select(F.posexplode("features").alias("feature", "f"))
    polygon = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(polygon)).when(F.col("f.geometry.type") == "MultiPolygon", many)
    name = F.col("f.properties")[layer_property] if layer_property else F.lit(layer or "layer")
    rings = found.select(name.alias("layer"), "feature", F.posexplode(parts).alias("part", "rings"))
    points = rings.select("layer", (F.col("feature") * 65536 + F.col("part")).alias("part"), F.posexplode("rings").alias("ring", "points"))
    points = points.select("layer", "part", "ring", F.posexplode("points").alias("seq", "p")).select("layer", "part", "ring", "seq", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))
    x, y = (projection.columns("lon", "lat")) if projection else (F.col("lon"), F.col("lat"))
    return points.select("layer", "part", "ring", "seq", x.alias("x"), y.alias("y"))
