"""The scalar functions under names of their own in Spark SQL: `register(spark)`, then `SELECT haversine(...)`.

They are temporary SQL functions whose bodies are the column expressions' own texts, so that SQL and DataFrames share one
definition and Catalyst puts the body in place of the call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from footreach.functions import geo, text

PAIR = "lng1 DOUBLE, lat1 DOUBLE, lng2 DOUBLE, lat2 DOUBLE"
POINT = "lng DOUBLE, lat DOUBLE"
#: Name, parameters, column function.
FUNCTIONS: list[tuple[str, str, Callable[..., Column]]] = [
    ("haversine", PAIR, geo.haversine), ("planar_distance", PAIR, geo.planar_distance), ("out_of_china", POINT, geo.out_of_china), ("overseas", POINT, geo.overseas),
    ("zoom_step", "minutes INT", geo.zoom_step), ("proximity_score", "nearest DOUBLE, minutes INT", geo.proximity_score), ("tile_row", POINT, lambda *p: geo.tile_of(*p)[0]), ("tile_col", POINT, lambda *p: geo.tile_of(*p)[1]),
    ("name_norm", "name STRING", text.name_norm), ("station_base", "name STRING", text.station_base), ("park_base", "name STRING", text.park_base), ("clinic_base", "name STRING", text.clinic_base),
    ("edu_stage", "edu_kind STRING, name STRING", text.edu_stage), ("blind_group", "category STRING, name STRING", text.blind_group), ("is_noise", "category STRING, name STRING, tag STRING", text.is_noise),
]


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for the session and returns their names."""
    for name, parameters, function in FUNCTIONS:
        fields = [p.split() for p in parameters.split(", ")]
        row = spark.range(1).select(*(F.lit(None).cast(kind).alias(p) for p, kind in fields)).select(function(*(F.col(p) for p, _ in fields)).alias("r"))
        body = row._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {row.schema['r'].dataType.simpleString()} RETURN {body}")
    return [name for name, _, _ in FUNCTIONS]
