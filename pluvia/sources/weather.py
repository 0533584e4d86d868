"""CSV scan, date parsing, renaming, range filter, sentinel clean-up, sink."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia import constants as C
from pluvia.functions.storage import materialise
from pluvia.functions.stats import clean_number

FILE_SCHEMA = T.StructType(
    [T.StructField(m, T.DoubleType()) for m in C.MEASURES]
    + [
        T.StructField("DATE", T.StringType()),
        T.StructField("LATITUDE", T.DoubleType()),
        T.StructField("LONGITUDE", T.DoubleType()),
    ]
)


def read_weather_csv(
    spark: SparkSession,
    path: str,
    start_date: str | None = None,
    end_date: str | None = None,
    rename_columns: bool = True,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Scan header CSV files, clean, rename; with bounds (YYYYMMDD) keep [start_date, end_date] only.

    Rows whose date cannot be read keep a NULL date unless bounds are given; ``unreadable_dates`` lists them.
    Columns are matched to the schema by their header names, so files may
    order or omit columns freely.
    """
    schema = schema or FILE_SCHEMA
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    present = set(raw.columns)
    cast = raw.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType))
        .alias(f.name)
        for f in schema.fields
    ])
    dated = parse_dates(cast, "DATE")
    clean = null_sentinels(between_dates(dated, "DATE", start_date, end_date))
    return rename_to_labels(clean) if rename_columns else clean


def parse_dates(df: DataFrame, date_col: str | None = None, strict: bool = False) -> DataFrame:
    """Date column to DATE; unreadable text becomes NULL unless ``strict``."""
    name = date_col or (C.DATE_LABEL if C.DATE_LABEL in df.columns else "DATE")
    if name not in df.columns:
        return df
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return df
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(name, F.col(name).cast("date"))
    text = F.col(name).cast("string")
    if strict:
        return df.withColumn(name, F.to_date(text))
    compact = F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")
    return df.withColumn(
        name, F.when(text.rlike(r"^\d{8}$"), compact).otherwise(text.try_cast("date"))
    )


def rename_to_labels(df: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed(labels or C.COLUMN_LABELS)


def _as_date(text: str) -> dt.date:
    return dt.datetime.strptime(text, "%Y%m%d").date()


def between_dates(df: DataFrame, date_col: str, start_date: str | None, end_date: str | None) -> DataFrame:
    """Literal bounds on the bare column, so partitions and row groups are pruned; no bound, no filter."""
    if start_date:
        df = df.filter(F.col(date_col) >= F.lit(_as_date(start_date)))
    if end_date:
        df = df.filter(F.col(date_col) <= F.lit(_as_date(end_date)))
    return df


def unreadable_dates(df: DataFrame, date_col: str = "DATE") -> DataFrame:
    """Rows with a date text that ``parse_dates`` cannot read, as they are."""
    parsed = parse_dates(df.withColumn("_raw", F.col(date_col)), date_col)
    return parsed.filter(F.col("_raw").isNotNull() & F.col(date_col).isNull()).withColumn(date_col, F.col("_raw")).drop("_raw")


def null_sentinels(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """-999 and NaN become NULL in every floating column."""
    names = columns or [
        f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: clean_number(F.col(c), C.MISSING_SENTINEL) for c in names})


def write_daily(
    df: DataFrame, path: str, date_col: str, fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    """Daily table partitioned by year, so a date range reads only its years.

    Rows are range-partitioned by year, day and a hash of the row, so each task
    writes few years and no day of very many sites lands in one task.
    """
    rows = df.withColumn("year", F.year(date_col))
    writer = (
        rows.repartitionByRange("year", F.col(date_col), F.xxhash64(*df.columns))
        .write.mode(mode).partitionBy("year")
    )
    if fmt == "csv":
        writer.option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        writer.format(fmt).save(path)


def _month_number() -> Column:
    return F.col("year") * 12 + F.col("month")


def write_date_range(df: DataFrame, path: str, date_col: str, start_date: str, end_date: str) -> int:
    """Puts the rows of a date range into the daily table at ``path``, in place of what the table had in that range; returns
    their number.

    The table is partitioned by year and month.  Only months that the range touches are written again (dynamic partition
    overwrite), with their rows outside of the range kept, so a repeated range changes nothing and a late one costs its
    own months.  Touched months without any row left are removed.  Each call adds a line to ``_ranges`` below the path.
    """
    spark = df.sparkSession
    a, b = _as_date(start_date), _as_date(end_date)
    touched = _month_number().between(a.year * 12 + a.month, b.year * 12 + b.month)
    month_of = {"year": F.year(date_col), "month": F.month(date_col)}
    rows = materialise(between_dates(df, date_col, start_date, end_date).withColumns(month_of))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    count, before = rows.count(), []
    if files.exists(folder):
        old = spark.read.parquet(path).filter(touched)
        before = [(r["year"], r["month"]) for r in old.select("year", "month").distinct().collect()]  # months of the range
        kept = old.filter(~F.col(date_col).between(F.lit(a), F.lit(b)) | F.col(date_col).isNull())
        rows = materialise(rows.unionByName(kept.select(rows.columns)))
    left = {(r["year"], r["month"]) for r in rows.select("year", "month").distinct().collect()}
    if left:
        rows.repartitionByRange("year", "month", F.col(date_col), F.xxhash64(*df.columns)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)
    for year, month in set(before) - left:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/year={year}/month={month}"), True)
    spark.createDataFrame([(start_date, end_date, count, dt.datetime.now(dt.timezone.utc).isoformat())],
                          "start_date string, end_date string, written long, at string").coalesce(1).write.mode("append").json(f"{path}/_ranges")
    return count


def read_daily(
    spark: SparkSession, path: str, date_col: str, start_date: str, end_date: str
) -> DataFrame:
    """Read a ``write_daily`` or ``write_date_range`` table; the year filter prunes folders."""
    a, b = _as_date(start_date), _as_date(end_date)
    table = spark.read.parquet(path)
    pruned = table.filter(F.col("year").between(a.year, b.year))
    return between_dates(pruned, date_col, start_date, end_date).drop("year", "month")
