"""Cutting lineage for jobs that read an intermediate result several times.

Such a result is written once, as a columnar table, to the shared folder the
session names in ``spark.checkpoint.dir``; it survives lost executors.  Where
that is unset the session's warehouse directory is used, which executors share
as well.  The folder of a run is removed when its driver ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The run's own folder below the shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    key = f"{spark.sparkContext.applicationId} {base}"
    if key not in _folders:
        _folders[key] = f"{base.rstrip('/')}/pluvia-{spark.sparkContext.applicationId}"
        atexit.register(_remove, spark, _folders[key])
    return _folders[key]


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes the run's folder through Spark's file system, if the session still lives."""
    if spark.sparkContext._jsc is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Writes the rows once and returns a scan of what was written."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
