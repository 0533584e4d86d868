"""Data quality checks: shape, missing cells, duplicates, types, target, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia import constants as C


def basic_info(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"),
        F.concat_ws(",", *[F.lit(c) for c in df.columns]).alias("columns"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column, missing) for every column that misses something."""
    counts = F.array(*[
        F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing"))
        for c in df.columns
    ])
    return df.agg(counts.alias("_a")).select(F.inline("_a")).filter(F.col("missing") > 0)


def missing_overall(df: DataFrame) -> DataFrame:
    """(total_missing, missing_percentage of all cells)."""
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    cells = F.count(F.lit(1)) * len(df.columns)
    return df.agg(
        F.coalesce(F.sum(nulls), F.lit(0).cast("long")).alias("total_missing"),
        F.round(F.coalesce(F.try_divide(F.sum(nulls) * 100.0, cells), F.lit(0.0)), 2)
        .alias("missing_percentage"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier full row: rows - distinct rows.

    Copies combine map-side, so a row repeated very often stays small."""
    distinct = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    n = F.coalesce(F.sum("_copies"), F.lit(0))
    return distinct.agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0).cast("long")).alias("duplicate_rows"),
        F.round(F.coalesce(F.try_divide(F.sum(F.col("_copies") - 1) * 100.0, n), F.lit(0.0)), 2)
        .alias("duplicate_percentage"),
    )


def type_counts(df: DataFrame) -> DataFrame:
    """Number of columns per type; works on the schema alone."""
    types = [(f.dataType.simpleString(),) for f in df.schema]
    return df.sparkSession.createDataFrame(types, "type string").groupBy("type").agg(
        F.count(F.lit(1)).alias("n_columns")
    )


def target_check(df: DataFrame, target: str) -> DataFrame:
    """One row; percentages are over all rows."""
    if target not in df.columns:
        return df.limit(1).agg(F.lit(False).alias("target_exists"))
    t = F.col(target).cast("double")
    n = F.count(F.lit(1))
    missing, zero = F.count_if(t.isNull()), F.count_if(t == 0)

    def share(c):
        return F.round(F.coalesce(F.try_divide(c * 100.0, n), F.lit(0.0)), 2)

    return df.agg(
        F.lit(True).alias("target_exists"),
        missing.alias("missing_count"), share(missing).alias("target_missing_percentage"),
        F.min(t).alias("min_value"), F.max(t).alias("max_value"),
        F.round(F.avg(t), 2).alias("mean_value"),
        zero.alias("zero_days"), share(zero).alias("zero_percentage"),
    )


def quality_score(df: DataFrame, target: str = C.TARGET_LABEL) -> DataFrame:
    """0-100 score from missing cells, duplicates and the target, in one row.

    The three one-row checks meet in a union and one aggregate."""
    parts = missing_overall(df).unionByName(
        duplicate_rows(df), allowMissingColumns=True
    ).unionByName(target_check(df, target), allowMissingColumns=True)
    if "target_missing_percentage" not in parts.columns:
        parts = parts.withColumn("target_missing_percentage", F.lit(None).cast("double"))
    one = parts.agg(
        F.max("missing_percentage").alias("missing_percentage"),
        F.max("duplicate_percentage").alias("duplicate_percentage"),
        F.max("target_exists").alias("target_exists"),
        F.max("target_missing_percentage").alias("target_missing_percentage"),
    )
    penalty = (
        F.least(F.col("missing_percentage") * 2, F.lit(30.0))
        + F.least(F.col("duplicate_percentage") * 3, F.lit(20.0))
        + F.when(F.col("target_exists"), F.least(F.col("target_missing_percentage") * 2, F.lit(15.0)))
        .otherwise(50.0)
    )
    score = F.greatest((F.lit(100.0) - penalty).cast("int"), F.lit(0))
    return one.withColumn("overall_score", score)


def assess_quality(df: DataFrame, target: str = C.TARGET_LABEL) -> dict[str, DataFrame]:
    return {
        "basic_info": basic_info(df),
        "missing_overall": missing_overall(df),
        "missing_by_column": missing_by_column(df),
        "duplicates": duplicate_rows(df),
        "data_types": type_counts(df),
        "target_variable": target_check(df, target),
        "score": quality_score(df, target),
    }
