"""GeoJSON feature collections as a DataFrame: one row for each feature with a geometry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "struct<features: array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>>"


def parse_collection(text: Column) -> Column:
    """Array of features; coordinates stay text, as their nesting differs by type."""
    return F.from_json(text, SCHEMA)["features"]


def features(texts: DataFrame, text: str = "value") -> DataFrame:
    """(other columns, type, coordinates, properties) of the features; those without geometry are left out."""
    own = [c for c in texts.columns if c != text]
    rows = texts.select(*own, F.explode(parse_collection(F.col(text))).alias("f"))
    return rows.where("f.geometry.type is not null").select(*own, F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Files of one collection each, by Spark's reader; a glob that matches nothing raises as usual."""
    return features(spark.read.text(path, wholetext=True))


def line_points(coordinates: Column) -> Column:
    """A LineString's points as an array of (x, y)."""
    return F.transform(F.from_json(coordinates, "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def bounds(points: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def to_feature_json(geometry_type: Column, points: Column, properties: Column, digits: int = 7) -> Column:
    """A feature as text, coordinates rounded."""
    rounded = F.transform(points, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits)))
    geometry = F.struct(geometry_type.alias("type"), rounded.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def write_features(rows: DataFrame, path: str, digits: int = 7) -> None:
    """Rows (type, points, properties) as newline-delimited features, by Spark's writer."""
    rows.select(to_feature_json(F.col("type"), F.col("points"), F.col("properties"), digits).alias("value")).write.text(path)


#: An innermost array that begins with two numbers, which is a position, but for bounding boxes.
POSITION = r'(?<!"bbox"\s{0,9}:\s{0,9})\[\s*(-?[0-9][0-9.eE+-]*)\s*,\s*(-?[0-9][0-9.eE+-]*)\s*(?:,[^\[\]{}"]*)?\]'


def transformed(rows: DataFrame, geometry: str, shift: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with every position in the geometry column, GeoJSON text of any type and depth, collections of collections
    too, moved by `shift`, which takes rows with lng, lat and replaces these two.

    Positions become rows, so `shift` works on columns as it does on tables, and return to the gaps between them. A third
    number goes; bounding boxes stay, as they are not positions. Null, empty and other text without positions stays as it is."""
    from footreach.operators.graph import written

    own = written(rows.withColumn("__row", F.monotonically_increasing_id()))  # the ids must be the same in both readings
    found = F.transform(F.regexp_extract_all(geometry, F.lit(POSITION), F.lit(0)), lambda p: F.struct(F.regexp_extract(p, POSITION, 1).cast("double").alias("lng"), F.regexp_extract(p, POSITION, 2).cast("double").alias("lat")))
    points = own.select("__row", F.posexplode(found).alias("__k", "p")).select("__row", "__k", "p.lng", "p.lat")
    moved = shift(points).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__k", "lng", "lat"))).alias("__at"))
    gaps = F.split(geometry, POSITION, -1)
    text = lambda p: F.concat(F.lit("["), p["lng"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit("]"))
    whole = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size("__at")), "__at", lambda gap, p: F.concat(gap, text(p))), ""), F.element_at(gaps, -1))
    out = own.join(moved, "__row", "left").withColumn(geometry, F.when(F.col("__at").isNull(), F.col(geometry)).otherwise(whole))
    return out.drop("__row", "__at")
