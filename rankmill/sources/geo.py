"""Map features in and out: GeoJSON, parquet, one JSON feature per row.

A geometry is always a MultiPolygon: polygons of rings of [lon, lat] points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankmill.functions.text import strip, zero_fill
from rankmill.sources.features import feature_objects, read_pieces

GEOMETRY = "array<array<array<array<double>>>>"
_FEATURE = "struct<id:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>"


def _multi_polygon(geometry: Column) -> Column:
    many = F.from_json(geometry["coordinates"], GEOMETRY)
    one = F.array(F.from_json(geometry["coordinates"], "array<array<array<double>>>"))
    other = F.raise_error(F.concat(F.lit("not a polygon: "), geometry["type"])).cast(GEOMETRY)
    none = F.lit(None).cast(GEOMETRY)
    return (
        F.when(geometry["type"].isNull(), none)
        .when(geometry["type"] == "Polygon", one)
        .when(geometry["type"] == "MultiPolygon", many)
        .otherwise(other)
    )


def read_geojson(spark: SparkSession, path: str, properties: Sequence[str], collection: bool = True) -> DataFrame:
    """Named properties (as text) and geometry of each feature; a geometry of another kind is an error.

    With ``collection=False`` the file holds one feature per line, as written below. Both kinds of files split into
    blocks that tasks read by themselves.
    """
    text = feature_objects(read_pieces(spark, path)) if collection else spark.read.text(path).withColumnRenamed("value", "feature")
    return parse_features(text, properties)


def parse_features(text: DataFrame, properties: Sequence[str]) -> DataFrame:
    """Named properties and geometry of the features whose JSON is in the column ``feature``."""
    return text.select(F.from_json("feature", _FEATURE).alias("f")).select(
        *[F.col("f.properties")[p].alias(p) for p in properties], _multi_polygon(F.col("f.geometry")).alias("geometry")
    )


def geojson_properties(spark: SparkSession, path: str) -> list[str]:
    """Names of all properties of a FeatureCollection, in the order in which features first have them."""
    features = feature_objects(read_pieces(spark, path)).select("source_file", "at", F.from_json("feature", _FEATURE).alias("f"))
    names = features.select("source_file", "at", F.posexplode(F.map_keys("f.properties")).alias("place", "name"))
    first = names.groupBy("name").agg(F.min(F.struct("source_file", "at", "place")).alias("first")).orderBy("first")
    return [row.name for row in first.collect()]


def read_features(
    spark: SparkSession, path: str, name: str = "kommun", code: str = "kommun_kod", width: int = 4
) -> DataFrame:
    """(name, code, geometry) from parquet, name stripped and code zero-filled; other columns ignored."""
    df = spark.read.parquet(path)
    missing = {name, code, "geometry"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}, found {df.columns}")
    return df.select(
        strip(F.col(name).cast("string")).alias(name), zero_fill(code, width).alias(code), "geometry"
    )


def feature_json(df: DataFrame, column: str = "feature") -> DataFrame:
    """One GeoJSON Feature per row; all columns but the geometry become properties."""
    properties = F.struct(*[c for c in df.columns if c != "geometry"])
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.col("geometry").alias("coordinates"))
    feature = F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")
    )
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias(column))


def write_features(df: DataFrame, parquet: str, geojson: str | None = None) -> dict:
    """Write parquet and, if asked, one JSON feature per line; returns path, feature count and columns."""
    df.write.mode("overwrite").parquet(parquet)
    written = df.sparkSession.read.parquet(parquet)
    if geojson is not None:
        feature_json(written, "value").write.mode("overwrite").text(geojson)
    return {"path": parquet, "features": written.count(), "columns": written.columns}
