"""Scans, parsing, payloads, range filters, cleaning of the input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.functions.storage import shared_folder
from pluvia.plans.catalog.registry import PANEL, query
from pluvia.sources import payload, weather
from pluvia.sources.panel import panel, table


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1997-02-28'
""")
def date_range_scan(spark, sf_dir):
    rows = weather.between_dates(table(spark, sf_dir, "orders"), "o_orderdate", "19960301", "19970228")
    return rows.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")


@query("""
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS "DATE" FROM orders
""")
def date_parse(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    text = (
        F.when(F.col("o_orderstatus") == "P", "not a date")
        .when(F.col("o_orderstatus") == "O", F.date_format(day, "yyyyMMdd"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("DATE"))
    return weather.parse_dates(rows, "DATE")


@query("""
SELECT event_id, CASE WHEN event_type = 'click' OR value > 100 THEN NULL ELSE value END AS value FROM events
""")
def sentinel_to_null(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    raw = (
        F.when(F.col("event_type") == "click", F.lit(-999.0))
        .when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.col("value"))
    )
    return weather.null_sentinels(events.select("event_id", raw.alias("value")))


@query(PANEL + """
SELECT day AS "Ngày", rain AS "Lượng mưa", temp AS "Nhiệt độ 2m", humidity AS "Độ ẩm tương đối 2m",
       pressure AS "Áp suất bề mặt", wind AS "Tốc độ gió 10m", site FROM panel
""")
def column_labels(spark, sf_dir):
    coded = panel(spark, sf_dir).select(
        F.col("day").alias("DATE"), F.col("rain").alias("PRECTOTCORR"), F.col("temp").alias("T2M"),
        F.col("humidity").alias("RH2M"), F.col("pressure").alias("PS"), F.col("wind").alias("WS10M"), "site",
    )
    return weather.rename_to_labels(coded)


CSV_SCHEMA = T.StructType([
    T.StructField("DATE", T.StringType()), T.StructField("PRECTOTCORR", T.DoubleType()),
    T.StructField("T2M", T.DoubleType()),
])


@query(PANEL + """
SELECT site, day AS "DATE", rain AS "PRECTOTCORR", temp AS "T2M" FROM panel
""")
def csv_lines(spark, sf_dir):
    """The panel written as CSV text (-999 where nothing was measured) and scanned back."""
    text = F.to_csv(F.struct(
        F.date_format("day", "yyyy-MM-dd").alias("DATE"), F.col("rain").alias("PRECTOTCORR"),
        F.coalesce("temp", F.lit(-999.0)).alias("T2M"),
    ))
    lines = panel(spark, sf_dir).select("site", text.alias("line"))
    parsed = lines.select("site", F.from_csv("line", CSV_SCHEMA.simpleString()[7:-1].replace(":", " ")).alias("r"))
    return weather.null_sentinels(weather.parse_dates(parsed.select("site", "r.*"), "DATE"))


@query(PANEL + """
SELECT site, rain AS "PRECTOTCORR", temp AS "T2M", day AS "DATE" FROM panel
""")
def csv_scan(spark, sf_dir):
    """CSV files with a header and -999 for what is missing, written and scanned back whole."""
    schema = T.StructType([T.StructField("site", T.IntegerType()), *CSV_SCHEMA.fields[1:], CSV_SCHEMA.fields[0]])
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    panel(spark, sf_dir).select(
        F.date_format("day", "yyyyMMdd").alias("DATE"), F.coalesce("temp", F.lit(-999.0)).alias("T2M"),
        F.col("rain").alias("PRECTOTCORR"), "site",
    ).write.option("header", True).csv(folder)
    return weather.read_weather_csv(spark, folder, rename_columns=False, schema=schema)


@query(PANEL + "SELECT site, day, rain, temp FROM panel WHERE day BETWEEN DATE '1996-11-15' AND DATE '1999-02-03'")
def daily_sink(spark, sf_dir):
    """The year-partitioned table written and a date range of it read back."""
    folder = f"{shared_folder(spark)}/daily-{uuid.uuid4().hex}"
    weather.write_daily(panel(spark, sf_dir).select("site", "day", "rain", "temp"), folder, "day")
    return weather.read_daily(spark, folder, "day", "19961115", "19990203")


@query(PANEL + """
SELECT site, day, CASE WHEN day BETWEEN DATE '1997-03-10' AND DATE '1998-02-01' THEN rain * 2 ELSE rain END AS rain FROM panel
WHERE day BETWEEN DATE '1996-01-05' AND DATE '1998-02-01' AND NOT day BETWEEN DATE '1996-05-01' AND DATE '1996-05-31'
""")
def overlapping_ranges(spark, sf_dir):
    """A date range saved, a later one with corrected values over its end, a month without rows, and one range once more."""
    folder = f"{shared_folder(spark)}/ranges-{uuid.uuid4().hex}"
    rows = panel(spark, sf_dir).select("site", "day", "rain")
    doubled = rows.withColumn("rain", F.col("rain") * 2)
    weather.write_date_range(rows, folder, "day", "19960105", "19970620")
    weather.write_date_range(doubled, folder, "day", "19970310", "19980201")
    weather.write_date_range(rows.limit(0), folder, "day", "19960501", "19960531")
    weather.write_date_range(doubled, folder, "day", "19970310", "19980201")
    return weather.read_daily(spark, folder, "day", "19950101", "20011231")


@query("""
SELECT o_orderkey, 'not a date' AS "DATE" FROM orders WHERE o_orderstatus = 'P'
""")
def unreadable_dates(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "P", "not a date").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("DATE"))
    return weather.unreadable_dates(rows)


def monthly_payloads(spark, sf_dir):
    """JSON payloads of at most 31 days, one per site and month; beside every
    good one arrive an error message and an empty answer."""
    rows = panel(spark, sf_dir).withColumn("month", F.date_format("day", "yyyyMM"))

    def series(c):
        present = F.when(F.col(c).isNotNull(), F.struct(F.date_format("day", "yyyyMMdd").alias("k"), F.col(c).alias("v")))
        return F.map_from_entries(F.collect_list(present))

    maps = rows.groupBy("site", "month").agg(series("rain").alias("rain"), series("temp").alias("temp"))
    parameter = F.create_map(F.lit("PRECTOTCORR"), F.col("rain"), F.lit("T2M"), F.col("temp"))
    nothing = F.map_from_entries(F.array().cast("array<struct<k:string,v:map<string,double>>>"))
    silent = F.array().cast("array<string>")

    def body(messages, measures):
        return F.to_json(F.struct(
            messages.alias("messages"), F.struct(measures.alias("parameter")).alias("properties")
        ))

    answers = F.explode(F.array(
        body(silent, parameter), body(F.array(F.lit("quota exceeded")), parameter), body(silent, nothing)
    ))
    return maps.select("site", "month", answers.alias("body"))


@query(PANEL + """
SELECT site, rain AS "PRECTOTCORR", temp AS "T2M", day AS "DATE", 10.78 AS "LATITUDE", 106.7 AS "LONGITUDE" FROM panel
""")
def payload_flatten(spark, sf_dir):
    parsed = payload.parse_payloads(monthly_payloads(spark, sf_dir), "body")
    good, _ = payload.split_payloads(parsed)
    return payload.flatten_payloads(good, ["PRECTOTCORR", "T2M"], carry=("site",))


@query(PANEL + """
, m AS (SELECT DISTINCT site, strftime(day, '%Y%m') AS month FROM panel)
SELECT problem, COUNT(*) AS payloads FROM m CROSS JOIN (VALUES ('api_error'), ('no_data')) p(problem) GROUP BY 1
""")
def payload_quarantine(spark, sf_dir):
    parsed = payload.parse_payloads(monthly_payloads(spark, sf_dir), "body")
    _, bad = payload.split_payloads(parsed)
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("payloads"))


@query(PANEL + "SELECT * FROM panel")
def weather_panel(spark, sf_dir):
    return panel(spark, sf_dir)
