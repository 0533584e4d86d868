"""Landed payload files as a stream of daily rows.

Checking and flattening payloads and the row-wise feature steps are stateless,
so the batch functions run unchanged on a streaming DataFrame; the file source
and the parquet sink keep the bookkeeping in their checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pluvia.sources.payload import PAYLOAD_SCHEMA, flatten_payloads, split_payloads
from pluvia.sources.weather import null_sentinels


def stream_payloads(spark: SparkSession, folder: str, measures: list[str] | None = None) -> DataFrame:
    landed = spark.readStream.schema(PAYLOAD_SCHEMA).option("multiLine", True).json(folder)
    good, _ = split_payloads(landed)
    return null_sentinels(flatten_payloads(good, measures))


def append_daily(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
