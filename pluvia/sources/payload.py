"""Landed API payloads (nested JSON) to daily rows.

A payload is {"messages": [...], "properties": {"parameter": {measure:
{yyyymmdd: value}}}}.  Flattening explodes the dates of one payload and looks
every measure up in its own map: a narrow transformation, no shuffle, equally
valid on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia import constants as C

PAYLOAD_SCHEMA = T.StructType([
    T.StructField("messages", T.ArrayType(T.StringType())),
    T.StructField("properties", T.StructType([
        T.StructField(
            "parameter", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
        ),
    ])),
])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD_SCHEMA).option("multiLine", True).json(path)


def parse_payloads(df: DataFrame, text_col: str) -> DataFrame:
    parsed = F.from_json(F.col(text_col), PAYLOAD_SCHEMA)
    return df.withColumn("_p", parsed).select("*", "_p.*").drop("_p")


def payload_problem(measures_limit: int = C.MAX_PAYLOAD_MEASURES) -> Column:
    """Reason a payload cannot be used, NULL for a good one."""
    parameter = F.col("properties.parameter")
    return (
        F.when(F.coalesce(F.size("messages"), F.lit(0)) > 0, "api_error")
        .when(parameter.isNull() | (F.size(parameter) <= 0), "no_data")
        .when(F.size(parameter) > measures_limit, "too_many_measures")
    )


def split_payloads(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good payloads, quarantined payloads with their reason)."""
    judged = df.withColumn("problem", payload_problem())
    return judged.filter("problem IS NULL").drop("problem"), judged.filter("problem IS NOT NULL")


def flatten_payloads(
    df: DataFrame,
    measures: list[str] | None = None,
    carry: tuple[str, ...] = (),
    latitude: float = C.DEFAULT_LATITUDE,
    longitude: float = C.DEFAULT_LONGITUDE,
) -> DataFrame:
    """One row per payload and day, one column per measure, DATE and coordinates."""
    measures = measures or C.MEASURES
    parameter = F.col("properties.parameter")
    days = F.array_distinct(F.flatten(F.transform(F.map_values(parameter), F.map_keys)))
    rows = df.select(*carry, parameter.alias("_m"), F.explode(days).alias("_day"))
    return rows.select(
        *carry,
        *[F.try_element_at(F.try_element_at("_m", F.lit(m)), F.col("_day")).alias(m) for m in measures],
        F.to_date("_day", "yyyyMMdd").alias("DATE"),
        F.lit(latitude).alias("LATITUDE"),
        F.lit(longitude).alias("LONGITUDE"),
    )
