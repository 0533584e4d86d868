"""Weather-like panel built from the star-schema tables.

Site = supplier nation (or supplier), day = ship date, gap-free calendar.  The
panel is one row per site and calendar day, so a site never has more than
``CALENDAR_DAYS`` rows: that is the proven bound the windows rely on, whatever
the size of ``lineitem``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvia.functions.ordering import Series, series

FIRST_DAY, LAST_DAY = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
CALENDAR_DAYS = (LAST_DAY - FIRST_DAY).days + 1
MEASURES = ["rain", "temp", "humidity", "pressure", "wind"]
PREDICTORS = MEASURES[1:]


# Declared schemas: opening a table then reads no file footers.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, site: str = "s_nationkey") -> DataFrame:
    """Daily site measurements.  The join side is left to the size-checked
    planner; the aggregate combines map-side to one row per (site, day)."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").cast("date").alias("day"),
        "l_quantity", "l_discount", "l_tax", "l_extendedprice",
    )
    if site == "l_suppkey":
        joined = lines.withColumn("site", F.col("l_suppkey"))
    else:
        suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col(site).alias("site"))
        joined = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
    return joined.groupBy("site", "day").agg(
        F.round(F.sum(F.col("l_quantity") * F.col("l_discount") * 10), 4).alias("rain"),
        F.round(F.avg("l_quantity"), 6).alias("temp"),
        F.round(F.avg(F.col("l_tax") * 100), 6).alias("humidity"),
        F.round(F.avg("l_extendedprice"), 6).alias("pressure"),
        F.round(F.avg(F.col("l_discount") * 100), 6).alias("wind"),
        F.count(F.lit(1)).alias("n_obs"),
    )


def on_calendar(obs: DataFrame, first_day: dt.date = FIRST_DAY, last_day: dt.date = LAST_DAY) -> DataFrame:
    """Every site gets every calendar day; days without lines have rain 0.

    An observation outside the calendar fails the query, as it would be lost.

    Each observed day also opens the empty days up to the next one, so the gaps
    are filled in one pass, without a join and without reading ``obs`` twice.
    The result stays distributed by site, which later windows by site reuse.
    """
    by_day = Window.partitionBy("site").orderBy("day")
    first, last = F.lit(first_day), F.lit(last_day)
    outside = F.raise_error(F.concat(F.lit("observation outside the calendar: "), F.col("day").cast("string"))).cast("date")
    obs = obs.withColumn("day", F.when(F.col("day").between(first, last), F.col("day")).otherwise(outside))
    opens = F.when(F.row_number().over(by_day) == 1, first).otherwise(F.greatest("day", first))
    closes = F.least(F.coalesce(F.date_sub(F.lead("day").over(by_day), 1), last), last)
    spans = obs.withColumns({"_from": opens, "_to": closes}).filter(F.col("_from") <= F.col("_to"))
    rows = spans.withColumn("_d", F.explode(F.sequence("_from", "_to", F.expr("interval 1 day"))))
    seen = F.col("_d") == F.col("day")
    return rows.select(
        "site", F.col("_d").alias("day"), F.when(seen, F.col("rain")).otherwise(0.0).alias("rain"),
        *[F.when(seen, F.col(c)).alias(c) for c in PREDICTORS],
        F.when(seen, F.col("n_obs")).otherwise(F.lit(0).cast("long")).alias("n_obs"),
    )


def panel(spark: SparkSession, sf_dir: str, site: str = "s_nationkey") -> DataFrame:
    return on_calendar(observations(spark, sf_dir, site))


def daily_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single-site series of the same calendar: (site = 0, day, rain)."""
    return panel(spark, sf_dir).groupBy("day").agg(
        F.round(F.sum("rain"), 4).alias("rain")
    ).select(F.lit(0).alias("site"), "day", "rain")


def site_series(**options) -> Series:
    return series("site", "day", rows_bound=CALENDAR_DAYS, **options)
